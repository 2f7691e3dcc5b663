"""Result and goal-event files, cached tables and written outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlab.operators.scores import extra_time_correction

RESULT_COLUMNS = (
    "match_date", "home_team", "away_team", "home_score", "away_score", "tournament",
    "neutral", "country",
)


def _read_strings(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, named by the header; nothing is inferred."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def _number(column: str) -> Column:
    # "2" and "2.0" both occur in score columns.
    return F.col(column).try_cast("double").cast("int")


def scan_goalscorers(spark: SparkSession, path: str) -> DataFrame:
    """Goal events: match key, team, scorer, goal_minute, own_goal, penalty."""
    raw = _read_strings(spark, path)

    def flag(name: str) -> Column:
        return F.lower(F.trim(name)) == "true"

    return raw.select(
        F.col("date").try_cast("date").alias("match_date"), "home_team", "away_team", "team",
        "scorer", _number("minute").alias("goal_minute"), flag("own_goal").alias("own_goal"),
        flag("penalty").alias("penalty"),
    )


def load_results(
    spark: SparkSession, path: str, goalscorers: str | None = None
) -> DataFrame:
    """Typed results; rows without both scores are dropped.

    With a goal-event file, scores that include extra time are set back to
    regulation time.  ``match_id`` is the file's own, else a hash of date and teams
    and of the rank among rows that share them, the same however the file is split.
    Sort with ``operators.context.chronological`` where the order of rows matters.
    """
    raw = _read_strings(spark, path)
    if "match_id" in raw.columns:
        ident = F.col("match_id").cast("bigint")
    else:
        match = ["date", "home_team", "away_team"]
        rest = sorted(c for c in raw.columns if c not in match)
        same = F.row_number().over(Window.partitionBy(*match).orderBy(*rest))
        ident = F.xxhash64(*match, same)
    rows = raw.withColumn("match_id", ident).select(
        "match_id",
        F.to_date("date").alias("match_date"), "home_team", "away_team",
        _number("home_score").alias("home_score"), _number("away_score").alias("away_score"),
        "tournament", (F.lower(F.trim("neutral")) == "true").alias("neutral"), "country",
    ).na.drop(subset=["home_score", "away_score"])
    if goalscorers is not None:
        rows = extra_time_correction(rows, scan_goalscorers(spark, goalscorers))
    return rows.select("match_id", *RESULT_COLUMNS)


def save_cache(df: DataFrame, path: str, partition_by: str | None = "year") -> None:
    """Overwrite a cached table; match tables are partitioned by year.

    Rows are brought together by year first, and split again where a year is large,
    so a year has few files.
    """
    if partition_by == "year" and "year" not in df.columns:
        df = df.withColumn("year", F.year("match_date"))
    if not partition_by:
        df.write.mode("overwrite").parquet(path)
        return
    together = df.hint("rebalance", F.col(partition_by))
    together.write.mode("overwrite").partitionBy(partition_by).parquet(path)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_predictions(predictions: DataFrame, path: str) -> None:
    """date, teams, 1X2, over_2_5, btts_yes as CSV files with a header."""
    predictions.select(
        F.col("match_date").alias("date"), "home_team", "away_team", "prob_home", "prob_draw",
        "prob_away", F.col("markets.over_2_5").alias("over_2_5"),
        F.col("markets.btts_yes").alias("btts_yes"),
    ).write.mode("overwrite").option("header", True).csv(path)


def append_form_log(signals: DataFrame, path: str, logged_at: Column) -> None:
    """Append signal reads to a JSON log partitioned by day."""
    rows = signals.select(
        logged_at.alias("logged_at"), "team", "form_score", "confidence", "key_absences",
        "performance_context", "n_articles",
    )
    rows.withColumn("log_date", F.to_date("logged_at")).write.mode("append").partitionBy(
        "log_date"
    ).json(path)
