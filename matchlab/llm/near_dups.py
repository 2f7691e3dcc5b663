"""Near duplicates by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlab.llm.shingles import bands, digests, shingle_sets, signatures
from matchlab.llm.words import chunks
from matchlab.operators.components import connected_components
from matchlab.session import drop_durable, durable

PERCENT = 75


def _sketches(docs: DataFrame) -> DataFrame:
    """Size, digest and band keys of each document's shingle set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            shingle, offsets = shingle_sets(part.column("text"))
            d1, d2 = digests(shingle, offsets)
            n = np.diff(offsets)
            keys = bands(signatures(shingle, offsets))
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, keys.shape[1], 0))]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1), pa.array(d2), keys],
                ["doc_id", "n", "d1", "d2", "bands"],
            )

    return docs.mapInArrow(task, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(id, digest, n, shingles): each document's different sets of shingles, as sorted hashes in bytes.

    ``docs`` says in ``repeated`` whether its id has several rows; only those are compared.
    """

    def task(batches):
        for part in chunks(batches, "text"):
            shingle, offsets = shingle_sets(part.column("text"))
            raw, at = shingle.tobytes(), (8 * offsets).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("repeated"), pa.array(digests(shingle, offsets)[0]), pa.array(np.diff(offsets), pa.int64()),
                    pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary()),
                ],
                ["id", "repeated", "digest", "n", "shingles"],
            )

    made = durable(docs.mapInArrow(task, "id long, repeated boolean, digest long, n long, shingles binary"))
    columns = ["id", "digest", "n", "shingles"]
    several = made.where("repeated").select(columns).dropDuplicates(["id", "digest", "n"])
    return made.where("not repeated").select(columns).union(several)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))

    def task(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(x) + len(y)
                # Both are sorted sets: what occurs twice in the union of lists is shared.
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int(np.count_nonzero(merged[1:] == merged[:-1]))
                keep.append(shared > 0 and 100 * shared >= percent * (both - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(task, "a long, b long").distinct()


def _alike_in_size(x: str, y: str, percent: int) -> F.Column:
    return F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})")


def _rest_pairs(open_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components among ``open_rows`` (id, component).

    Shingles are ordered from rare to frequent. Two sets that reach the similarity
    share ``P / (100 + P)`` of both sizes added; so their first common shingle lies
    among the first quarter of the larger one and the first seventh of the smaller one
    (at 75), and enough shingles follow it in both. Rare shingles first keeps apart
    documents that only have a frequent passage in common.
    """
    rows = sets.join(open_rows, "id")

    def task(batches):
        for batch in batches:
            raw = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column("shingles")]
            sizes = [len(x) for x in raw]
            rows = np.repeat(np.arange(len(raw)), sizes)
            one = batch.select(own).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*one.columns, pa.array(np.concatenate(raw), pa.int64())], [*own, "shingle"])

    own = ["id", "digest", "component", "n"]
    spread = rows.select(*own, "shingles").mapInArrow(task, "id long, digest long, component long, n long, shingle long")
    often = spread.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    # One id may have several sets, also of equal size: each is ranked by itself.
    order = Window.partitionBy("id", "digest", "n").orderBy(F.coalesce("often", F.lit(1)), "shingle")
    first = (
        spread.join(often, "shingle", "left")
        .withColumn("rank", F.row_number().over(order))
        .where(f"rank <= n - ceil({percent} * n / 100D) + 1 and often is not null")
        .select("shingle", "id", "component", "n", "rank")
    )
    mixed = first.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    first = durable(first.join(mixed.select("shingle"), "shingle"))
    small = first.where(f"rank <= n - ceil({2 * percent} * n / {100 + percent}D) + 1")
    large = first.select("shingle", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("rank").alias("rb"))
    fits = F.expr(
        "component != cb and (n < nb or n = nb and id < b)"
        f" and {100 + percent} * (least(n - rank, nb - rb) + 1) >= {percent} * (n + nb)"
    )
    return (
        small.join(large, (small["shingle"] == large["shingle"]) & fits & _alike_in_size("n", "nb", percent))
        .select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    )


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT
) -> DataFrame:
    """One row for each document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if their sets of distinct five-word shingles have a Jaccard
    similarity of at least ``percent`` / 100; ``component_id`` is the least id that
    links lead to, and the document with that id is kept.

    1. Documents with equal sets are one class; only its least id goes on.
    2. Circulant MinHash gives 96 coordinates; four at a time they are 24 band keys.
       A pair of similarity 0.75 misses all bands once in 9,000 times, one of 0.8 once
       in 300,000, and then only matters if nothing else links the two.
    3. Within a band bucket each member is compared with the bucket's least member,
       not with all others, so a bucket of n gives n - 1 pairs.
    4. Buckets whose other members then belong to different components are resolved
       exactly by ``_rest_pairs``; members of one component need no further pairs.

    All links are confirmed on full sets. A null or empty text has no shingles and no
    links. Rows with the same id are one node, linked by any of their texts. A row
    without id has no component and is kept. Extra columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    sketch = durable(_sketches(rows))
    classes = (
        sketch.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    )
    spread = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    least = spread.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("least"), F.count("*").alias("size")).where("size > 1")
    members = durable(
        spread.join(least, "bucket").select("bucket", "rep", "n", F.col("least.rep").alias("pivot"), F.col("least.n").alias("np"), "size")
        .where("rep != pivot")
    )
    involved = members.select(F.col("rep").alias("doc_id")).union(members.select("pivot")).distinct()
    several = sketch.where("doc_id is not null").groupBy("doc_id").agg((F.count("*") > 1).alias("repeated"))
    sets = _sets(rows.join(involved.join(several, "doc_id"), "doc_id"))
    first = members.where(_alike_in_size("n", "np", percent)).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    links = durable(_linked(first, sets, percent))
    joined = connected_components(links, "a", "b")
    placed = (
        members.where("size > 2").select("bucket", "rep").join(joined, F.col("rep") == F.col("node"), "left")
        .select("bucket", F.col("rep").alias("id"), F.coalesce("component", "rep").alias("component"))
    )
    unsettled = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    open_rows = durable(placed.join(unsettled.select("bucket"), "bucket").select("id", "component").distinct())
    more = durable(_linked(_rest_pairs(open_rows, sets, percent), sets, percent))
    # Several texts under one id tie their classes together.
    owned = durable(sketch.select("doc_id", "n", "d1", "d2").join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"], "left"))
    low = owned.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a < hi").select("doc_id", "a")
    tied = owned.join(low, "doc_id").select("a", F.col("rep").alias("b")).where("a != b")
    final = connected_components(links.union(more).union(tied), "a", "b")
    out = owned.join(final, F.col("rep") == F.col("node"), "left")
    best = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), best.alias("component_id"))
    drop_durable(members)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of ``docs``, all columns, for each component; rows without id stay."""
    found = near_duplicates(docs, id_column, text_column, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    own = docs.select(F.struct(*docs.columns).alias("own"), F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("body"))
    left = own.join(found, F.col("id") == F.col("gone"), "left_anti")
    # Rows with the same id are one document: the first by text stands for it. Each row without id is its own.
    left = left.withColumn("alone", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
    first = F.row_number().over(Window.partitionBy("id", "alone").orderBy("body"))
    left = left.withColumn("nth", first).where("nth = 1")
    return left.select(*(F.col("own")[c].alias(c) for c in docs.columns))
