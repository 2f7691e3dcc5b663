"""Passages that an earlier document also has: seeds, extension, maximal repeats.

1. Seeds. Every run of ``length`` words contains an anchor: the run of ``SEED`` words
   with the least hash (winnowing). Which one depends on the words alone, so two
   documents that share a passage share its anchors. Anchors met in one document only
   are dropped.
2. Extension. Each shared anchor is extended both ways to all runs of ``length`` words
   that hold it. Equal runs meet by their 64-bit hash; the least document id of a run
   owns it, and every later document that has it is told where.
3. Maximal repeats. The runs told to a document are merged where they overlap.

Documents are not compared pair by pair, so a passage in n documents costs n rows.
Within a batch equal keys are grouped before they are shuffled, so a passage that a
third of all documents share sends few rows with long lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlab.llm.words import chunks, cut, mix, windows

LENGTH = 13
SEED = 5


def anchors(hashes: np.ndarray, text: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the seed at each word, marks of the anchors among them)."""
    run, _ = windows(hashes, text, seed)
    n = max(len(hashes) - length + 1, 0)
    marks = np.zeros(len(run), bool)
    if n:
        whole = text[:n] == text[length - 1 :]
        least = run[:n].copy()
        for j in range(1, length - seed + 1):
            np.minimum(least, run[j : j + n], out=least)
        for j in range(length - seed + 1):
            marks[j : j + n] |= whole & (run[j : j + n] == least)
    return run, marks


_PLACES = "key long, doc_id long, more array<long>"
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _grouped(keys: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """One row for each key: its least document, and a list of the others if there are any."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    keys, docs = keys[fresh], docs[fresh]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    others = np.diff(np.append(at, len(keys))) - 1
    ends = np.concatenate([[0], np.cumsum(others)]).astype(np.int32)
    alone = np.append(others == 0, False)
    more = pa.ListArray.from_arrays(pa.array(ends, mask=alone), pa.array(docs[~first]))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[at].view(np.int64)), pa.array(docs[at]), more], ["key", "doc_id", "more"]
    )


def _shared(places: DataFrame) -> DataFrame:
    """(key, owner, doc_id) of the keys that more than one document has."""
    same = Window.partitionBy("key")
    last = F.coalesce(F.array_max("more"), F.col("doc_id"))
    found = places.withColumn("owner", F.min("doc_id").over(same)).withColumn("last", F.max(last).over(same)).where("owner < last")
    every = F.concat(F.array("doc_id"), F.coalesce("more", F.array().cast("array<long>")))
    return found.select("key", "owner", F.explode(every).alias("doc_id"))


def _seeds(rows: DataFrame, length: int, seed: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            part = part.filter(part.column("doc_id").is_valid())
            words = cut(part.column("text"))
            run, marks = anchors(words.hashes(), words.text, length, seed)
            at = np.flatnonzero(marks)
            if len(at):
                yield _grouped(run[at], part.column("doc_id").to_numpy()[words.text[at]])

    return rows.mapInArrow(task, _PLACES)


def _listed(keys: np.ndarray, text: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which of the keys are in their own text's list."""
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    owner = np.repeat(np.arange(len(lists)), sizes).astype(np.uint64)
    wanted = mix(lists.flatten().to_numpy().view(np.uint64) + owner * _SALT)
    out = np.zeros(len(keys), bool)
    at = np.flatnonzero(sizes[text] > 0)
    out[at] = np.isin(mix(keys[at] + text[at].astype(np.uint64) * _SALT), wanted)
    return out


def _extended(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """All runs of ``length`` words around the anchors listed in ``keys``."""

    def task(batches):
        for part in chunks(batches, "text"):
            part = part.filter(part.column("keys").is_valid())
            words = cut(part.column("text"))
            hashes, text = words.hashes(), words.text
            run, marks = anchors(hashes, text, length, seed)
            at = np.flatnonzero(marks)
            at = at[_listed(run[at], text[at], part.column("keys"))]
            whole, valid = windows(hashes, text, length)
            here = np.zeros(len(whole) + length, bool)
            for j in range(length - seed + 1):
                here[(at - j)[at >= j]] = True
            start = np.flatnonzero(here[: len(whole)] & valid)
            if len(start):
                yield _grouped(whole[start], part.column("doc_id").to_numpy()[text[start]])

    return rows.mapInArrow(task, _PLACES)


def _kept_text(words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, one space between them."""
    start, end, text = words.start[kept], words.end[kept], words.text[kept]
    lead = np.ones(len(start), np.int64)
    lead[np.flatnonzero(np.diff(text, prepend=-1))] = 0
    size = end - start + lead
    stop = np.cumsum(size)
    out = words.data[np.repeat(start - lead - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
    out[(stop - size)[lead == 1]] = 0x20
    per_text = np.bincount(text, weights=size, minlength=words.texts).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(per_text)])
    return pa.LargeStringArray.from_buffers(words.texts, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def _without(rows: DataFrame, length: int) -> DataFrame:
    def task(batches):
        for part in chunks(batches, "text"):
            words = cut(part.column("text"))
            first, counts = words.firsts(), words.counts()
            whole, valid = windows(words.hashes(), words.text, length)
            at = np.flatnonzero(valid)
            at = at[_listed(whole[at], words.text[at], part.column("keys"))]
            steps = np.zeros(len(words) + length + 1, np.int64)
            steps[at] += 1
            steps[at + length] -= 1
            gone = np.cumsum(steps)[: len(words)] > 0
            edge = np.zeros(len(words) + 1, bool)
            edge[first[:-1]] = True
            before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
            after = np.concatenate([gone[1:], [False]]) if len(gone) else gone
            opens = np.flatnonzero(gone & (~before | edge[:-1]))
            closes = np.flatnonzero(gone & (~after | edge[1:])) + 1
            owner = words.text[opens] if len(opens) else np.zeros(0, np.int64)
            spans = pa.StructArray.from_arrays(
                [pa.array(opens - first[owner]), pa.array(closes - first[owner])], ["start", "end"]
            )
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=words.texts))]).astype(np.int32)
            removed = np.bincount(words.text, weights=gone, minlength=words.texts).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(counts), pa.array(removed),
                    pa.ListArray.from_arrays(pa.array(ends), spans), _kept_text(words, ~gone),
                ],
                ["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    return rows.mapInArrow(task, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, seed: int = SEED
) -> DataFrame:
    """One row for each document without the passages that a document with a smaller id has.

    Columns: ``doc_id, n_words, n_removed, spans`` (maximal repeats as word ranges) and
    ``kept`` (the other words, one space between them). Passages are judged on the
    input, not on what is left of it. Texts under ``length`` words and null or empty
    texts lose nothing. Rows with the same id do not judge each other, but lose the same
    passages. A row without id is left whole and judges nobody. Extra columns are ignored.
    """
    if not 0 < seed <= length:
        raise ValueError("a seed must fit into a passage")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    seeds = _shared(_seeds(rows, length, seed)).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    runs = _shared(_extended(rows.join(seeds, "doc_id", "left"), length, seed)).where("doc_id > owner")
    gone = runs.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    return _without(rows.join(gone, "doc_id", "left"), length)
