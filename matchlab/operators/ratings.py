"""Pairwise ratings carried through an ordered scan.

A match needs the ratings every earlier match of both sides left behind, so the
scan is sequential inside a pool of teams that meet each other, and parallel
over pools.  Spark partitions by pool and sorts (spilling where needed); a task
holds one Arrow batch and one number per team, never the pool's matches.

Pools that no column names are found as the connected components of the teams
that have met.  With ``rows_per_task`` a pool too long for one task is cut into
date slices: each slice starts from the ratings the one before it left, and both
the ratings and the scanned rows of a slice are written out, so a lost executor
costs one slice and no task reads much more than that many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlab import constants as C
from matchlab.functions.metrics import competition_k, rating_1x2
from matchlab.operators.components import connected_components
from matchlab.session import durable

_SCAN_SCHEMA = (
    "pool string, src int, match_id bigint, day int, home_team string, away_team string, "
    "elo_home_pre double, elo_away_pre double, elo_home_post double, elo_away_post double"
)


def decayed(rating: float, gap: int) -> float:
    """A rating after ``gap`` days without a match."""
    if gap > C.INACTIVITY_DAYS:
        rating -= C.INACTIVITY_RATE * (gap / 365.0) * (rating - C.INITIAL_RATING)
    return rating


def updated(own: float, other: float, bonus: float, score: float, k: float) -> tuple[float, float]:
    """Both ratings after a match that the first side entered with ``bonus`` and scored ``score`` in."""
    expected = 1.0 / (1.0 + 10.0 ** ((other - (own + bonus)) / C.RATING_SCALE))
    return own + k * (score - expected), other + k * ((1.0 - score) - (1.0 - expected))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk rows sorted by (pool, day, match_id); rows without a match id seed the state."""
    pool, rating, last = None, {}, {}

    def current(team: str, day: int) -> float:
        return decayed(rating[team], day - last[team]) if team in rating else C.INITIAL_RATING

    for batch in batches:
        out = np.empty((len(batch), 4))
        keep = np.ones(len(batch), dtype=bool)
        columns = [
            batch[c].tolist()
            for c in ("pool", "seed", "day", "home_team", "away_team", "bonus", "score", "k")
        ]
        for i, (p, seed, day, home, away, bonus, score, k) in enumerate(zip(*columns)):
            if p != pool:
                pool, rating, last = p, {}, {}
            if seed == seed and seed is not None:
                rating[home], last[home] = seed, day
                keep[i] = False
                continue
            own, other = current(home, day), current(away, day)
            rating[home], rating[away] = updated(own, other, bonus, score, k)
            last[home] = last[away] = day
            out[i] = own, other, rating[home], rating[away]
        done = batch.loc[keep, ["pool", "src", "match_id", "day", "home_team", "away_team"]].copy()
        names = ["elo_home_pre", "elo_away_pre", "elo_home_post", "elo_away_post"]
        for j, name in enumerate(names):
            done[name] = out[keep, j]
        done["match_id"] = done["match_id"].astype("int64")
        yield done


def _run(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.repartition(parts, "pool")
        .sortWithinPartitions("pool", F.col("seed").isNull(), "day", "src", "match_id")
        .select(
            "pool", "src", "match_id", "seed", "day", "home_team", "away_team", "bonus", "score",
            "k",
        )
        .mapInPandas(_scan, _SCAN_SCHEMA)
    )


def _scan_input(matches: DataFrame, pool: str) -> DataFrame:
    score = (
        F.when(F.col("home_score") > F.col("away_score"), 1.0)
        .when(F.col("home_score") == F.col("away_score"), 0.5)
        .otherwise(0.0)
    )
    return matches.select(
        F.col(pool).cast("string").alias("pool"),
        F.col("match_id").cast("bigint").alias("match_id"),
        F.lit(None).cast("double").alias("seed"),
        F.datediff("match_date", F.lit("1970-01-01").cast("date")).alias("day"),
        (F.col("src") if "src" in matches.columns else F.lit(0)).alias("src"),
        "home_team", "away_team",
        F.when(F.col("neutral"), 0.0).otherwise(C.HOME_ADVANTAGE).alias("bonus"),
        score.alias("score"),
        competition_k(F.col("tournament")).alias("k"),
    )


def _slice_ends(rows: DataFrame, rows_per_task: int) -> list[int]:
    """Last day of each slice such that no pool has many more rows than asked in a slice.

    The driver receives one small row per calendar day.
    """
    per_day = (
        rows.groupBy("pool", "day").count().groupBy("day").agg(F.max("count").alias("n"))
    )
    ends, running = [], 0
    days = sorted((r["day"], r["n"]) for r in per_day.collect())
    for day, n in days:
        if running and running + n > rows_per_task:
            ends.append(previous)
            running = 0
        running += n
        previous = day
    return ends + ([days[-1][0]] if days else [])


def with_pools(matches: DataFrame, out: str) -> DataFrame:
    """Add ``out``, the first team by name of all that a match's teams are linked with by meetings."""
    met = matches.select("home_team", "away_team").distinct()
    found = connected_components(met, "home_team", "away_team")
    return matches.join(found.select(F.col("node").alias("home_team"), F.col("component").alias(out)), "home_team")


def rating_scan(
    matches: DataFrame, pool: str | None = "pool", rows_per_task: int | None = None
) -> DataFrame:
    """Ratings of both sides before and after every match.

    ``matches`` needs match_id, match_date, home_team, away_team, home_score,
    away_score, neutral, tournament and the pool column: teams of different pools
    never meet.  Without a pool column (None) pools are found by ``with_pools``.
    """
    if pool is None:
        matches, pool = with_pools(matches, "_pool"), "_pool"
    rows = _scan_input(matches, pool)
    ends = [] if rows_per_task is None else _slice_ends(rows, rows_per_task)
    if len(ends) <= 1:
        return _run(rows)
    done, state, after = None, None, None
    for end in ends:
        part = rows.filter(F.col("day") <= end)
        if after is not None:
            part = part.filter(F.col("day") > after)
            part = part.unionByName(_seeds(state))
        scanned = durable(_run(part))
        ended = _end_state(scanned)
        if state is not None:
            ended = ended.unionByName(state)
        state = durable(
            ended.groupBy("pool", "team").agg(
                F.max_by("rating", "day").alias("rating"), F.max("day").alias("day")
            )
        )
        done = scanned if done is None else done.unionByName(scanned)
        after = end
    return done


def _seeds(state: DataFrame) -> DataFrame:
    none = F.lit(None)
    return state.select(
        "pool", none.cast("bigint").alias("match_id"), F.col("rating").alias("seed"), "day",
        F.lit(0).alias("src"), F.col("team").alias("home_team"),
        F.col("team").alias("away_team"), F.lit(0.0).alias("bonus"), F.lit(0.0).alias("score"),
        F.lit(0.0).alias("k"),
    )


def _sides(scanned: DataFrame) -> DataFrame:
    def side(name: str) -> Column:
        return F.struct(
            F.col(f"{name}_team").alias("team"), F.col(f"elo_{name}_post").alias("rating")
        )

    both = F.explode(F.array(side("home"), side("away"))).alias("s")
    return scanned.select("pool", "day", "src", "match_id", both).select(
        "pool", "day", "src", "match_id", "s.team", "s.rating"
    )


def _end_state(scanned: DataFrame) -> DataFrame:
    return (
        _sides(scanned)
        .groupBy("pool", "team")
        .agg(
            F.max_by("rating", F.struct("day", "src", "match_id")).alias("rating"),
            F.max("day").alias("day"),
        )
    )


def elo_ratings(matches: DataFrame, pool: str | None = "pool", **options) -> DataFrame:
    """``matches`` with elo_home_pre and elo_away_pre."""
    scanned = rating_scan(matches, pool, **options)
    return matches.join(scanned.select("match_id", "elo_home_pre", "elo_away_pre"), "match_id")


def current_ratings(scanned: DataFrame) -> DataFrame:
    """(pool, team, rating): end state after the last match of each team, not decayed."""
    return _end_state(scanned).select("pool", "team", "rating")


def extend_ratings(
    base: DataFrame, new: DataFrame, pool: str | None = "pool", **options
) -> DataFrame:
    """New matches rated from the end state of ``base``.

    Both are scanned together in date order (base first on a tie), so a new
    match that is older than the end of ``base`` is placed where it belongs.
    """
    columns = [
        "match_id", "match_date", "home_team", "away_team", "home_score", "away_score",
        "neutral", "tournament",
    ] + ([pool] if pool else [])
    both = base.select(*columns, F.lit(0).alias("src")).unionByName(
        new.select(*columns, F.lit(1).alias("src"))
    )
    scanned = rating_scan(both, pool, **options).filter("src = 1").select(
        "match_id", "elo_home_pre", "elo_away_pre"
    )
    rated = new.drop("elo_home_pre", "elo_away_pre", "elo_diff").join(scanned, "match_id")
    return rated.withColumn("elo_diff", F.col("elo_home_pre") - F.col("elo_away_pre"))


def with_latest_rating(
    rows: DataFrame, ratings: DataFrame, default: float = C.INITIAL_RATING
) -> DataFrame:
    """Add elo_home_pre / elo_away_pre, the last known rating of each side or the default.

    Where both tables have a pool, a team is looked up in the pool of the row.
    """
    pooled = "pool" in rows.columns and "pool" in ratings.columns
    out = rows.withColumn("_pool", F.col("pool").cast("string") if pooled else F.lit(""))
    found = ratings.withColumn("_pool", F.col("pool").cast("string") if pooled else F.lit(""))
    for side in ("home", "away"):
        lookup = found.select(
            "_pool", F.col("team").alias(f"{side}_team"), F.col("rating").alias(f"_r_{side}")
        )
        out = out.join(lookup, ["_pool", f"{side}_team"], "left").withColumn(
            f"elo_{side}_pre", F.coalesce(f"_r_{side}", F.lit(default))
        ).drop(f"_r_{side}")
    return out.drop("_pool")


def with_rating_probs(rows: DataFrame) -> DataFrame:
    """Add prob_home, prob_draw, prob_away from elo_home_pre, elo_away_pre and neutral."""
    p = rating_1x2(F.col("elo_home_pre"), F.col("elo_away_pre"), F.col("neutral"))
    return rows.withColumn("_p", p).select(
        *rows.columns, F.col("_p.home").alias("prob_home"), F.col("_p.draw").alias("prob_draw"),
        F.col("_p.away").alias("prob_away"),
    )
