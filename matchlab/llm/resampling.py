"""Documents drawn by how much their words look like a target's, with line deduplication.

Features are runs of up to n words, hashed to buckets. The corpus' bucket counts need
every text's features, but texts share lines. So texts are cut at line breaks, each
distinct line's features are found once and counted as often as the line occurs; runs
that cross a line break belong to one text and are counted beside them. Weights go the
same way back: a line's weight is computed once and joined to the texts that hold it.

A document is drawn by its weight plus Gumbel noise from its id, which is a draw without
replacement in proportion to the exponential of the weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlab.llm.crc import add_byte, crc32
from matchlab.llm.words import chunks, text_buffers
from matchlab.session import drop_durable, durable

NGRAM = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Lines of more than one in so many are joined by broadcast: there are no more of them than this.
FREQUENT = 4096
_COPIES = 1000

_KEPT = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _KEPT[_b] = _b
for _b in range(0x41, 0x5B):
    _KEPT[_b] = _b + 32


@dataclass
class Runs:
    """Word counts of texts, and every run of words: its text, bucket, and if it crosses a line break."""

    words: np.ndarray
    text: np.ndarray
    bucket: np.ndarray
    crosses: np.ndarray

    def only(self, keep: np.ndarray) -> Runs:
        return Runs(self.words, self.text[keep], self.bucket[keep], self.crosses[keep])

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=len(self.words)).astype(np.int64)


def runs(texts: pa.Array, n: int, buckets: int) -> Runs:
    """All runs of 1 to n words of each text; words are letters, digits and bytes beyond ASCII, A-Z lowered."""
    raw, offsets = text_buffers(texts)
    data = _KEPT[raw]
    inside = data != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    line = np.cumsum(raw == 0x0A)[start] if len(start) else np.zeros(0, np.int64)
    value = crc32(data, start, end)
    owners, found, crosses = [text], [value], [np.zeros(len(start), bool)]
    for k in range(1, n):
        m = len(start) - k
        if m <= 0:
            break
        same = text[:m] == text[k:]
        value = crc32(data, start[k:], end[k:], add_byte(value[:m], 0x20))
        owners.append(text[:m][same])
        found.append(value[same])
        crosses.append((line[:m] != line[k:])[same])
    bucket = np.concatenate(found) % np.uint32(buckets)
    words = np.bincount(text, minlength=len(offsets) - 1).astype(np.int64)
    return Runs(words, np.concatenate(owners), bucket.astype(np.int64), np.concatenate(crosses))


def _lines(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """(k1, k2, times, n_words, n_features, buckets): each distinct line's features, found once."""
    cut = docs.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    distinct = cut.groupBy("line").agg(F.count("*").alias("times"))
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "line"):
            found = runs(part.column("line"), n, buckets)
            order = np.argsort(found.text, kind="stable")
            packed = found.bucket[order].astype(kind).tobytes()
            ends = np.concatenate([[0], np.cumsum(found.counts())])
            ends *= np.dtype(kind).itemsize
            bodies = pa.array([packed[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("k1", "k2", "times")), pa.array(found.words), pa.array(found.counts()), bodies],
                ["k1", "k2", "times", "n_words", "n_features", "buckets"],
            )

    keyed = distinct.select("line", "times", *_keys("line", "k1", "k2"))
    return durable(keyed.mapInArrow(task, "k1 long, k2 long, times long, n_words long, n_features long, buckets binary"))


def _keys(column: str, first: str, second: str) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(column).alias(first), F.xxhash64(F.lit("2"), column).alias(second)]


def _sums(totals: np.ndarray) -> Iterator[pa.RecordBatch]:
    used = np.flatnonzero(totals)
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], ["bucket", "n"])


def _unpacked(part: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all features of stored lines."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    size = part.column("n_features").to_numpy()
    flat = np.frombuffer(b"".join(part.column("buckets").to_pylist()), kind).astype(np.int64)
    return np.repeat(np.arange(len(size)), size), flat


def bucket_counts(docs: DataFrame, lines: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts: lines times their occurrences, and runs across lines."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for part in batches:
            row, bucket = _unpacked(part, buckets)
            np.add.at(totals, bucket, part.column("times").to_numpy()[row])
        yield from _sums(totals)

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for part in chunks(batches, "text"):
            found = runs(part.column("text"), n, buckets)
            totals += np.bincount(found.bucket[found.crosses], minlength=buckets)
        yield from _sums(totals)

    counts = lines.select("times", "n_features", "buckets").mapInArrow(stored, "bucket long, n long")
    if n > 1:
        counts = counts.union(docs.select("text").mapInArrow(crossing, "bucket long, n long"))
    out = np.zeros(buckets, np.int64)
    for bucket, total in counts.groupBy("bucket").agg(F.sum("n")).collect():  # one row a bucket
        out[bucket] = total
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: the smoothed log ratio of its share in the target and in the corpus."""
    buckets, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((y + 1.0) * (s + buckets) / ((x + 1.0) * (t + buckets))))
            for x, y in zip(corpus.astype(float).tolist(), target.astype(float).tolist())
        ],
        np.int64,
    )


def _weights(docs: DataFrame, lines: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """(id, h1, h2, copies, n_words, n_features, weight) of each distinct pair of id and text."""
    buckets = len(gain)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            row, bucket = _unpacked(part, buckets)
            weight = np.zeros(part.num_rows, np.int64)
            np.add.at(weight, row, gain[bucket])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("k1", "k2", "times", "n_words", "n_features")), pa.array(weight)],
                ["k1", "k2", "times", "n_words", "n_features", "weight"],
            )

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            found = runs(part.column("text"), n, buckets)
            found = found.only(found.crosses)
            weight = np.zeros(part.num_rows, np.int64)
            np.add.at(weight, found.text, gain[found.bucket])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("id", "h1", "h2")), pa.array(found.counts()), pa.array(weight)],
                ["id", "h1", "h2", "n_features", "weight"],
            )

    values = ("n_words", "n_features", "weight")
    told = lines.mapInArrow(stored, "k1 long, k2 long, times long, n_words long, n_features long, weight long")
    told = durable(told)
    least = (told.agg(F.sum("times")).first()[0] or 0) / FREQUENT
    often = told.where(F.col("times") > least)  # fewer than FREQUENT rows
    seldom = told.where(F.col("times") <= least)
    held = docs.select("id", *_keys("text", "h1", "h2"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    held = held.select("id", "h1", "h2", (F.col("pos") == 0).cast("long").alias("copies"), *_keys("line", "k1", "k2"))
    held = held.join(F.broadcast(often.select("k1", "k2", F.struct(*values).alias("often"))), ["k1", "k2"], "left")
    # A row that has its line already is sent by its text, to no line: frequent lines meet nowhere.
    met = F.col("often").isNotNull()
    held = held.withColumns({"k1": F.when(met, F.col("h1")).otherwise(F.col("k1")), "k2": F.when(~met, F.col("k2"))})
    held = held.join(seldom.select("k1", "k2", F.struct(*values).alias("seldom")), ["k1", "k2"], "left")
    one = F.coalesce("often", "seldom")
    rows = held.select("id", "h1", "h2", "copies", *[F.coalesce(one[c], F.lit(0)).alias(c) for c in values])
    if n > 1:
        more = docs.select("id", "text", *_keys("text", "h1", "h2"))
        kind = more.schema["id"].dataType.simpleString()
        more = more.mapInArrow(crossing, f"id {kind}, h1 long, h2 long, n_features long, weight long")
        rows = rows.unionByName(more.withColumns({"copies": F.lit(0).cast("long"), "n_words": F.lit(0).cast("long")}))
    # Copies of a row add up; each has its share.
    summed = rows.groupBy("id", "h1", "h2").agg(F.sum("copies").alias("copies"), *[F.sum(c).alias(c) for c in values])
    return summed.withColumns({c: F.expr(f"{c} div copies") for c in values})


def _each_copy(rows: DataFrame) -> DataFrame:
    """A row for each copy, numbered from 0, in blocks of bounded size."""
    blocks = rows.withColumn("_block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {_COPIES})")))
    numbers = F.expr(f"sequence(_block * {_COPIES}, least(copies, (_block + 1) * {_COPIES}) - 1)")
    return blocks.withColumn("_copy", F.explode(numbers)).drop("_block")


def _ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored`` with ``rank`` for each copy that is drawn, else null."""
    enough = (F.col("n_words") >= least_words) & F.col("id").isNotNull()
    order = [F.col("score").desc(), F.col("id"), F.col("h1"), F.col("h2")]
    cut = scored.where(enough).repartitionByRange(*order).withColumn("bin", F.spark_partition_id())
    cut = durable(cut)
    sizes = dict(cut.groupBy("bin").agg(F.sum("copies")).collect())  # one row a partition
    draw = sum(sizes.values()) * percent // 100
    before, offsets = 0, []
    for number in sorted(sizes):
        offsets.append((number, before))
        before += sizes[number]
    starts = scored.sparkSession.createDataFrame(offsets, "bin int, _before long")
    above = F.sum("copies").over(Window.partitionBy("bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = cut.withColumn("_above", above - F.col("copies")).join(F.broadcast(starts), "bin")
    placed = _each_copy(placed).withColumn("rank", F.col("_before") + F.col("_above") + F.col("_copy") + 1)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    others = _each_copy(scored.where(~F.coalesce(enough, F.lit(False)))).withColumn("rank", F.lit(None).cast("long"))
    keep = ["id", "n_words", "n_features", "weight", "score", "rank"]
    return placed.select(keep).unionByName(others.select(keep))


def resample(
    docs: DataFrame, target: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: ``id, n_words, n_features, weight, score, rank``.

    ``percent`` of the rows with ``least_words`` words or more are drawn and have a rank from
    1, the highest score first, equal scores by smaller id. The score is the weight plus
    noise from ``seed`` and the id, in thousandths. A null or empty text has no features and
    weight 0; a row without id has no score, is never drawn and does not count as one to draw
    from. Repeated rows have equal scores and ranks of their own. An empty target leaves all
    gains to the corpus alone; an empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).alias("text")
    docs = docs.select(F.col(id_column).alias("id"), text)
    target = target.select(F.coalesce(F.col(target_text), F.lit("")).alias("text"))
    counted = []
    for texts in (docs, target):
        lines = _lines(texts, n, buckets)
        counted.append((lines, bucket_counts(texts, lines, n, buckets)))
    gain = gains(counted[0][1], counted[1][1])
    drop_durable(counted[1][0])
    weights = _weights(docs, counted[0][0], gain, n)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = durable(weights.withColumn("score", F.col("weight") + noise))
    drop_durable(counted[0][0])
    out = _ranked(scored, percent, least_words)
    return out.select(F.col("id").alias(id_column), "n_words", "n_features", "weight", "score", "rank")
