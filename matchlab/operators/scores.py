"""Regulation-time scores from goal events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlab import constants as C

KEYS = ["match_date", "home_team", "away_team"]


def regulation_goals(goals: DataFrame) -> DataFrame:
    """Per match key: goals of each side within regulation time and the last goal minute.

    Goals without a minute count neither way.
    """
    in_time = F.col("goal_minute") <= C.REGULATION_MINUTES
    return goals.groupBy(*KEYS).agg(
        F.count_if(in_time & (F.col("team") == F.col("home_team"))).alias("reg_home"),
        F.count_if(in_time & (F.col("team") == F.col("away_team"))).alias("reg_away"),
        F.max("goal_minute").alias("last_minute"),
    )


def extra_time_correction(matches: DataFrame, goals: DataFrame) -> DataFrame:
    """Replace the score of matches with a goal past regulation time by the regulation score.

    Matches without goal events, or with none past regulation time, stay as they
    are.  ``corrected`` marks replaced scores, ``non_draw`` those a single match
    could hardly have taken into extra time.
    """
    late = regulation_goals(goals).filter(F.col("last_minute") > C.REGULATION_MINUTES)
    joined = matches.join(late, KEYS, "left")
    hit = F.col("last_minute").isNotNull()
    kept = [c for c in matches.columns if c not in ("home_score", "away_score")]
    return joined.select(
        *kept,
        F.when(hit, F.col("reg_home").cast("int")).otherwise(F.col("home_score")).alias("home_score"),
        F.when(hit, F.col("reg_away").cast("int")).otherwise(F.col("away_score")).alias("away_score"),
        hit.alias("corrected"),
        (hit & (F.col("reg_home") != F.col("reg_away"))).alias("non_draw"),
    )
