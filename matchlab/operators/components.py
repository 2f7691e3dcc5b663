"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlab.session import drop_durable, durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them; ``a > b`` holds."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): each node of a pair with the least node it can reach.

    Alternates large and small stars until every component is one star around its
    least node; the number of rounds is logarithmic in a component's length. A hub
    with very many links only meets aggregates and joins that split. Pairs with a
    null end are ignored, a node paired with itself is its own component.
    """
    ends = pairs.select(F.col(left).alias("l"), F.col(right).alias("r")).where("l is not null and r is not null")
    lone = ends.where("l = r").select(F.col("l").alias("node"))
    edges = durable(
        ends.where("l != r").select(F.greatest("l", "r").alias("a"), F.least("l", "r").alias("b")).distinct()
    )
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    last = print_of(edges)
    while last[0]:
        stars = durable(_small_star(_large_star(edges)))
        drop_durable(edges)
        edges, now = stars, print_of(stars)
        if now == last:
            break
        last = now
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return out.union(roots).union(lone.select("node", F.col("node").alias("component"))).groupBy("node").agg(
        F.min("component").alias("component")
    )
