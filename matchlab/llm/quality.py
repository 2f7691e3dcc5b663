"""Quality rules: repetition counts, and perplexity bands of each language.

Perplexity comes from a modified Kneser-Ney model over the bytes of words, ``ORDER``
bytes long, one model for each language. Its n-grams are counted in Spark and its
weights are kept as sorted hash arrays that workers map into memory. Byte n-grams are
few whatever the size of the corpus, and copies of one text hardly move them, so a
text is not found odd, or plain, for being copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlab.llm.counting import merge, shard_bits, tally, total
from matchlab.llm.storage import HashArrays, shard_of
from matchlab.llm.words import Words, chunks, cut, mix, windows
from matchlab.session import drop_durable, durable

ORDER = 5
END = 0x20
BAND = 8.0
LEAST_SPREAD = 0.05
RUN = 5

_TAG_BITS = 8 * ORDER
_U = np.uint64
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _tags(languages: pa.Array) -> np.ndarray:
    """A 22-bit tag for each row's language; no language is one of its own."""
    coded = languages.cast(pa.string()).fill_null("").dictionary_encode()
    names = cut(pa.array(["_".join(x.split()) or "_" for x in coded.dictionary.to_pylist()], pa.string()))
    return (names.hashes() >> _U(42))[coded.indices.to_numpy()] if len(coded) else np.zeros(0, _U)


def _spelling(words: Words, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct (language, word) pairs' n-grams, first n-gram of each, pair of each word).

    A word's n-grams end at each of its bytes and at the end mark after it; before its
    first byte stand zeros. The language's tag is above the n-gram's bytes.
    """
    tag = tags[words.text]
    _, example, which = np.unique(words.hashes() ^ mix(tag), return_index=True, return_inverse=True)
    start, size = words.start[example], words.end[example] - words.start[example] + 1
    stop = np.cumsum(size)
    place = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size, size)
    at = np.repeat(start, size) + place
    code = np.append(words.data, np.uint8(END))[at].astype(np.uint64)
    code[stop - 1] = END
    gram = np.zeros(len(code), np.uint64)
    for j in range(ORDER):
        shifted = np.zeros(len(code), np.uint64)
        shifted[j:] = code[: len(code) - j]
        gram |= np.where(place >= j, shifted, _U(0)) << _U(8 * j)
    return gram | (np.repeat(tag[example], size) << _U(_TAG_BITS)), stop - size, which


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, c): how often each language's n-gram of full order occurs; columns text, lang."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def out():
            keys, (counts,) = merge(held)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["gram", "c"])

        for part in chunks(batches, "text"):
            words = cut(part.column("text"))
            if not len(words):
                continue
            grams, first, which = _spelling(words, _tags(part.column("lang")))
            often = np.bincount(which).astype(np.int64)
            held.append(total(grams, [np.repeat(often, np.diff(np.append(first, len(grams))))]))
            if sum(len(k) for k, _ in held) > 2_000_000:
                held = [merge(held)]
                if len(held[0][0]) > 1_000_000:
                    yield out()
                    held = []
        if held:
            yield out()

    return docs.select("text", "lang").mapInArrow(task, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _level(n: int) -> Column:
    """The last n bytes of a gram, with its language's tag."""
    return F.expr(f"(gram & {~((1 << _TAG_BITS) - 1)}) | (gram & {(1 << 8 * n) - 1})")


def _levels(top: DataFrame) -> DataFrame:
    """(n, gram, c) of all lengths: a shorter gram counts the different bytes before it."""
    each = F.array(
        *(F.struct(F.lit(n).alias("n"), _level(n).alias("gram"), _level(n + 1).alias("longer")) for n in range(1, ORDER))
    )
    shorter = top.select(F.explode(each).alias("x")).select("x.*").distinct().groupBy("n", "gram").agg(F.count("*").alias("c"))
    return shorter.union(top.select(F.lit(ORDER), "gram", "c"))


def _weights(grams: DataFrame) -> DataFrame:
    """(key, level, weight): what is left of each gram's share, and each context's spare share."""
    seen = grams.groupBy("n", F.shiftright("gram", _TAG_BITS).alias("tag")).agg(
        *(F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in range(1, 5))
    )
    y = F.expr("if(n1 > 0, n1 / (n1 + 2 * n2), 0D)")

    def cut_of(k: int) -> Column:
        raw = F.lit(float(k)) - F.try_divide(F.lit(float(k + 1)) * y * F.col(f"n{k + 1}"), F.col(f"n{k}"))
        return F.when((y > 0) & (raw > 0) & (raw <= k), raw).otherwise(0.5).alias(f"d{k}")

    cuts = seen.select("n", "tag", *(cut_of(k) for k in (1, 2, 3)))
    low = (1 << _TAG_BITS) - 1
    context = grams.withColumn("context", F.expr(f"(gram & {~low}) | shiftright(gram & {low}, 8)"))
    sums = context.groupBy("n", "context").agg(
        F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("k1"), F.count_if(F.col("c") == 2).alias("k2"), F.count_if(F.col("c") > 2).alias("k3")
    ).withColumn("tag", F.shiftright("context", _TAG_BITS)).join(cuts, ["n", "tag"])
    sums = durable(sums)
    spare = sums.select(F.col("context").alias("key"), F.expr("2 * n + 1").alias("level"), F.expr("(d1 * k1 + d2 * k2 + d3 * k3) / total").alias("weight"))
    share = context.join(sums.select("n", "context", "total", "d1", "d2", "d3"), ["n", "context"]).select(
        F.col("gram").alias("key"), F.expr("2 * n").alias("level"),
        F.expr("greatest(c - case c when 1 then d1 when 2 then d2 else d3 end, 0D) / total").alias("weight"),
    )
    return share.union(spare)


def _hashed(keys: np.ndarray, level) -> np.ndarray:
    return mix(mix(keys.astype(np.uint64)) + np.asarray(level).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def fit(docs: DataFrame, folder: str, text_column: str = "text", language_column: str = "lang") -> HashArrays:
    """Count all texts and write the model's arrays into ``folder`` on the shared store."""
    rows = docs.select(F.col(text_column).alias("text"), F.col(language_column).cast("string").alias("lang"))
    bits = shard_bits(docs.sparkSession)
    arrays = HashArrays(folder, bits, {"weight": "<f8"})
    full = durable(count_grams(rows))
    levels = durable(_levels(full))
    weights = _weights(levels)

    def shards(batches):
        for batch in batches:
            keys = _hashed(batch.column("key").to_numpy(), batch.column("level").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard_of(keys, bits), pa.int32()), pa.array(keys.view(np.int64)), batch.column("weight")], ["shard", "key", "weight"]
            )

    def store(key, rows):
        order = np.argsort(rows["key"].to_numpy().view(np.uint64))
        arrays.write(int(key[0]), rows["key"].to_numpy().view(np.uint64)[order], {"weight": rows["weight"].to_numpy()[order]})
        return pd.DataFrame({"n": [len(rows)]})

    spread = weights.mapInArrow(shards, "shard int, key long, weight double")
    spread.groupBy("shard").applyInPandas(store, "n long").agg(F.sum("n")).collect()
    drop_durable(full)
    drop_durable(levels)
    return arrays


def _log_probabilities(arrays: HashArrays, grams: np.ndarray) -> np.ndarray:
    """log10 of each gram's last byte after the bytes before it."""
    distinct, which = np.unique(grams, return_inverse=True)
    tag, low = distinct & ~_U((1 << _TAG_BITS) - 1), distinct & _U((1 << _TAG_BITS) - 1)

    def weight(keys, level, missing):
        some, back = np.unique(_hashed(keys, level), return_inverse=True)
        found, got = arrays.find(some)
        return np.where(found, got["weight"], missing)[back]

    p = np.full(len(distinct), 1 / 257)
    for n in range(1, ORDER + 1):
        gram = low & _U((1 << 8 * n) - 1)
        p = weight(tag | gram, 2 * n, 0.0) + weight(tag | (gram >> _U(8)), 2 * n + 1, 1.0) * p
    return np.log10(p)[which]


def _line_repeats(words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, for each text."""
    data, offsets = words.data, words.offsets
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < n]
    if not len(starts):
        return np.zeros(words.texts, np.int64)
    text = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], n), offsets[text + 1])
    has_break = np.isin(ends - 1, breaks) & (ends > starts)
    ends = ends - has_break
    whole = Words(data, offsets, text, starts, ends).hashes()
    with_word = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    text, whole = text[with_word], whole[with_word]
    order = np.lexsort((whole, text))
    same = (text[order][1:] == text[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    return np.bincount(text[order][1:][same], minlength=words.texts).astype(np.int64)


def _word_repeats(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Words in runs of five that occur twice or more in their text, for each text."""
    run, valid = windows(hashes, words.text, RUN)
    at = np.flatnonzero(valid)
    order = at[np.lexsort((run[at], words.text[at]))]
    same = (run[order][1:] == run[order][:-1]) & (words.text[order][1:] == words.text[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    steps = np.zeros(len(words) + RUN + 1, np.int64)
    steps[order[twice]] += 1
    steps[order[twice] + RUN] -= 1
    covered = np.cumsum(steps)[: len(words)] > 0
    return np.bincount(words.text, weights=covered, minlength=words.texts).astype(np.int64)


_RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


def _measured(docs: DataFrame, arrays: HashArrays, text_column: str, language_column: str) -> DataFrame:
    """``docs`` in the struct ``own`` with what the rules look at."""
    rows = docs.select(
        F.struct(*docs.columns).alias("own"), F.col(text_column).alias("text"), F.col(language_column).cast("string").alias("lang")
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            words = cut(part.column("text"))
            hashes, counts = words.hashes(), words.counts()
            upto = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
            per_text = lambda values: np.bincount(words.text, weights=values, minlength=words.texts)
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[words.data])])
            logs = np.zeros(words.texts)
            if len(words):
                grams, first, which = _spelling(words, _tags(part.column("lang")))
                logs = per_text(np.add.reduceat(_log_probabilities(arrays, grams), first)[which])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("own"), part.column("lang"), pa.array(counts), pa.array(per_text(upto[words.end] - upto[words.start]).astype(np.int64)),
                    pa.array(symbols[words.offsets[1:]] - symbols[words.offsets[:-1]]), pa.array(_line_repeats(words)),
                    pa.array(_word_repeats(words, hashes)), pa.array(-logs / np.maximum(counts, 1)),
                ],
                ["own", "lang", *(c.split()[0] for c in _RULES.split(", "))],
            )

    own = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.mapInArrow(task, f"own struct<{own}>, lang string, {_RULES}")


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def bands(measured: DataFrame, width: float = BAND) -> DataFrame:
    """(band, lower, upper): the log10 perplexities a word that each language's texts may have.

    The middle is the median of the texts that pass the counting rules; the spread is
    the distance between the quartiles, at least ``LEAST_SPREAD`` on either side.
    """
    quartiles = F.percentile_approx("log_perplexity", F.array(*map(F.lit, (0.25, 0.5, 0.75))), 10000)
    found = measured.where(f"not ({BASE_FAILED})").groupBy("lang").agg(quartiles.alias("q"))
    return found.select(
        F.coalesce("lang", F.lit("")).alias("band"),
        (F.col("q")[1] - width * F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_SPREAD))).alias("lower"),
        (F.col("q")[1] + width * F.greatest(F.col("q")[2] - F.col("q")[1], F.lit(LEAST_SPREAD))).alias("upper"),
    )


MOST_BROADCAST = 50_000


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity", "base_failed"]


def _judged(docs: DataFrame, folder: str, text_column: str, language_column: str, width: float) -> DataFrame:
    """``docs`` in the struct ``own``, the counts, ``base_failed`` and ``kept``."""
    arrays = fit(docs, folder, text_column, language_column)
    bare = _measured(docs.select(text_column, language_column), arrays, text_column, language_column).drop("own")
    limits = durable(bands(bare, width))
    if limits.count() <= MOST_BROADCAST:
        limits = F.broadcast(limits)
    full = _measured(docs, arrays, text_column, language_column).withColumn("band", F.coalesce("lang", F.lit("")))
    joined = full.join(limits, "band", "left").withColumn("base_failed", F.expr(BASE_FAILED))
    # A mean over n words strays with one over the square root of n.
    slack = F.expr("1 + sqrt(100D / greatest(n_words, 1))")
    middle, half = (F.col("lower") + F.col("upper")) / 2, (F.col("upper") - F.col("lower")) / 2
    inside = F.abs(F.col("log_perplexity") - middle) <= half * slack
    return joined.select("own", *_NAMES, (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))


def judge(
    docs: DataFrame, folder: str, text_column: str = "text", language_column: str = "lang", width: float = BAND
) -> DataFrame:
    """All columns of ``docs``, what the rules count, ``base_failed`` and ``kept``.

    Every row is judged by itself and stays, also repeated rows. ``base_failed`` holds
    for fewer than ten words, or more than a fifth of the words in repeated runs of
    five. Other texts are kept if their log10 perplexity a word lies in their language's
    band; short texts get a wider one, as their mean is less certain. A null or empty
    text has no words and fails; a null language is one of its own. Columns of ``docs``
    that have the name of a new one are replaced.
    """
    judged = _judged(docs, folder, text_column, language_column, width)
    own = [c for c in docs.columns if c not in [*_NAMES, "kept"]]
    return judged.select(*(F.col("own")[c].alias(c) for c in own), *_NAMES, "kept")


def passing(
    docs: DataFrame, folder: str, text_column: str = "text", language_column: str = "lang", width: float = BAND
) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they were."""
    judged = _judged(docs, folder, text_column, language_column, width).where("kept")
    return judged.select(*(F.col("own")[c].alias(c) for c in docs.columns))
