"""Bigram language model with modified Kneser-Ney smoothing, interpolated.

Counting runs in Spark in three rounds of sums by key (``counting``): words; pairs of
word ids; and for each word what its contexts and its left neighbours add up to. The
model is kept as sorted hash arrays that workers map into memory (``storage``):

* ``words``: hash of the word; its count, what follows it (total, kinds that follow it
  once, twice, three times or more) and how many different words precede it;
* ``pairs``: hash of the two word ids; count.

A word's id is its place in the hash order, so ids stay below 2**32 distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlab.llm.counting import BLOB_SCHEMA, blobs, by_shard, shard_bits, summed_blobs, tally, total
from matchlab.llm.kneser_ney import discounts, off
from matchlab.llm.storage import HashArrays, pair_key, shard_of
from matchlab.llm.words import chunks, cut, mix, unmix
from matchlab.session import drop_durable, durable

END = mix(np.array([0x5EED], np.uint64))
MOST_COUNT = 0xFFFFFFFF
_STATS = ("total", "once", "twice", "often", "before")


@dataclass
class Bigrams:
    """A fitted model: where its arrays lie, and the sums that concern all of it."""

    words: HashArrays
    pairs: HashArrays
    tokens: int
    distinct: int
    kinds: int
    pair_off: np.ndarray
    word_off: np.ndarray
    spare: float

    def word_parts(self, hashes: np.ndarray) -> dict[str, np.ndarray]:
        """For sorted distinct word hashes: count, id, unigram probability, back-off weight."""
        found, got = self.words.find(hashes)
        follows = got["total"].astype(float)
        back = self.pair_off[1] * got["once"] + self.pair_off[2] * got["twice"] + self.pair_off[3] * got["often"]
        alone = off(got["before"], self.word_off) / max(self.kinds, 1) + self.spare / (self.distinct + 1)
        return {
            "known": found, "count": got["count"], "id": got["id"], "follows": follows, "alone": alone,
            "back": np.where(follows > 0, back / np.maximum(follows, 1), 1.0),
        }

    def pair_probability(self, parts: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """p(right | left) for pairs of places in ``parts``."""
        keys = pair_key(parts["id"][left], parts["id"][right])
        both = np.flatnonzero(parts["known"][left] & parts["known"][right])
        distinct, which = np.unique(keys[both], return_inverse=True)
        _, got = self.pairs.find(distinct)
        kept = np.zeros(len(left))
        kept[both] = off(got["count"].astype(np.int64), self.pair_off)[which]
        return kept / np.maximum(parts["follows"][left], 1) + parts["back"][left] * parts["alone"][right]


def _sequence(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct word hashes with the end, their places in all texts' tokens, texts' first places)."""
    words = cut(part.column("text"), lower=True)
    hashes = np.insert(words.hashes(), words.firsts()[1:], END[0])
    distinct, places = np.unique(hashes, return_inverse=True)
    return distinct, places, words.firsts() + np.arange(words.texts + 1)


def _word_counts(rows: DataFrame, folder: str, bits: int) -> tuple[HashArrays, np.ndarray, int]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for part in chunks(batches, "text"):
                distinct, places, _ = _sequence(part)
                yield distinct, [np.bincount(places, minlength=len(distinct)).astype(np.int64)]

        yield from summed_blobs(parts(), bits)

    arrays = HashArrays(f"{folder}/vocabulary", bits, {"count": "<i8"})

    def store(shard, keys, columns):
        arrays.write(shard, keys, {"count": columns[0]})
        return pd.DataFrame({"shard": [shard], "n": [len(keys)], "tokens": [int(columns[0].sum())]})

    sizes = by_shard(rows.mapInArrow(task, BLOB_SCHEMA), store, "shard int, n long, tokens long").collect()  # one row a shard
    n = np.zeros((1 << bits) + 1, np.int64)
    for row in sizes:
        n[row["shard"] + 1] = row["n"]
    return arrays, np.cumsum(n), sum(row["tokens"] for row in sizes)


def _ids(arrays: HashArrays, base: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    _, got = arrays.find(hashes, ())
    return base[shard_of(hashes, arrays.bits)] + got["place"]


def _hashes(arrays: HashArrays, base: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The word hashes of sorted ids."""
    out = np.empty(len(ids), np.uint64)
    shard = np.searchsorted(base, ids, side="right") - 1
    for number in np.unique(shard):
        mine = shard == number
        out[mine] = arrays.shard(int(number))[0][ids[mine] - base[number]]
    return out


def fit(docs: DataFrame, folder: str, text_column: str = "text") -> Bigrams:
    """Count all of ``docs`` and write the model into ``folder`` on the shared store.

    A token is a word after lower-casing A-Z; each text, also a null or empty one, adds
    one end token, which is also the context of its first word. Raises beyond 2**32
    distinct words, or for a pair that occurs 2**32 times.
    """
    rows = docs.select(F.col(text_column).alias("text"))
    bits = shard_bits(docs.sparkSession)
    # Every shard of pairs tells every group of word shards; few groups keep that small.
    coarse = min(bits, bits // 2 + 2)
    vocabulary, base, tokens = _word_counts(rows, folder, bits)
    distinct = int(base[-1])
    if distinct >= 1 << 32:
        raise ValueError(f"{distinct} distinct words do not fit into ids of 32 bits")

    def count_pairs(batches):
        def parts():
            for part in chunks(batches, "text"):
                words, places, _ = _sequence(part)
                ids = _ids(vocabulary, base, words)[places]
                before = np.concatenate([_ids(vocabulary, base, END), ids[:-1]])
                yield tally(pair_key(before, ids))

        yield from summed_blobs(parts(), bits)

    pairs = HashArrays(f"{folder}/pairs", bits, {"count": "<u4"})
    low = np.uint64(0xFFFFFFFF)

    def store_pairs(shard, keys, columns):
        counts = columns[0]
        if counts.max(initial=0) > MOST_COUNT:
            raise OverflowError(f"a pair of words occurs {counts.max()} times, more than {MOST_COUNT}")
        pairs.write(shard, keys, {"count": counts})
        ids = unmix(keys)
        left, right = (ids >> np.uint64(32)).astype(np.int64), (ids & low).astype(np.int64)
        ones, none = np.ones(len(keys), np.int64), np.zeros(len(keys), np.int64)
        kinds = [(counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64)]
        l_ids, l_sums = total(left.astype(np.uint64), [counts, *kinds])
        r_ids, r_sums = total(right.astype(np.uint64), [ones])
        both = total(
            np.concatenate([l_ids, r_ids]),
            [np.concatenate([c, none[: len(r_ids)]]) for c in l_sums] + [np.concatenate([none[: len(l_ids)], r_sums[0]])],
        )
        sent = blobs(_hashes(vocabulary, base, both[0].astype(np.int64)), both[1], coarse).to_pandas()
        for k in range(1, 5):
            sent[f"c{k}"] = 0
            sent.loc[0, f"c{k}"] = int(np.count_nonzero(counts == k))
        return sent

    schema = "shard int, payload binary, c1 long, c2 long, c3 long, c4 long"
    sums = durable(by_shard(rows.mapInArrow(count_pairs, BLOB_SCHEMA), store_pairs, schema))
    of_pairs = sums.agg(*(F.sum(f"c{k}") for k in range(1, 5))).first()
    words = HashArrays(f"{folder}/words", bits, {"count": "<i8", "id": "<i8", **dict.fromkeys(_STATS, "<i8")})

    def store_words(group, keys, columns):
        low, high = group << (bits - coarse), (group + 1) << (bits - coarse)
        edges = np.searchsorted(shard_of(keys, bits), np.arange(low, high + 1))
        for shard, a, b in zip(range(low, high), edges, edges[1:]):
            known, counted = vocabulary.shard(shard)
            if not np.array_equal(known, keys[a:b]):
                raise ValueError("a word of the vocabulary is missing from the pairs")
            own = {name: c[a:b] for name, c in zip(_STATS, columns)}
            words.write(shard, keys[a:b], {"count": counted["count"], "id": base[shard] + np.arange(b - a), **own})
        before = columns[_STATS.index("before")]
        return pd.DataFrame({f"c{k}": [int(np.count_nonzero(before == k))] for k in range(1, 5)} | {"c5": [int(np.count_nonzero(before > 2))], "kinds": [int(before.sum())]})

    of_words = by_shard(sums.select("shard", "payload"), store_words, "c1 long, c2 long, c3 long, c4 long, c5 long, kinds long")
    c1, c2, c3, c4, more, kinds = (int(x or 0) for x in of_words.agg(*(F.sum(c) for c in of_words.columns)).first())
    drop_durable(sums)
    word_off = discounts((c1, c2, c3, c4))
    spare = (word_off[1] * c1 + word_off[2] * c2 + word_off[3] * more) / kinds if kinds else 1.0
    return Bigrams(words, pairs, tokens, distinct, kinds, discounts(of_pairs), word_off, float(spare))


def score(docs: DataFrame, model: Bigrams, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, n_tokens, n_known, base_score, score``.

    Scores are log10 probabilities of the whole text and its end: ``base_score`` under
    add-a-half single words, ``score`` under the model. A null or empty text is scored
    as its end alone. Equal rows give equal rows; extra columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            distinct, places, first = _sequence(part)
            parts = model.word_parts(distinct)
            end = int(np.searchsorted(distinct, END[0]))
            before = np.concatenate([[end], places[:-1]])
            code, which = np.unique(before * len(distinct) + places, return_inverse=True)
            logs = np.log10(model.pair_probability(parts, code // len(distinct), code % len(distinct)))[which]
            plain = np.log10((parts["count"] + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))[places]
            sums = lambda values: np.add.reduceat(values, first[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(np.diff(first)), pa.array(sums((parts["count"] > 0)[places].astype(np.int64))),
                    pa.array(sums(plain)), pa.array(sums(logs)),
                ],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return rows.mapInArrow(task, "doc_id long, n_tokens long, n_known long, base_score double, score double")
