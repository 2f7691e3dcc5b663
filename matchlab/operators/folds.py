"""Walk-forward folds.

Folds follow from two dates, so the list is at most as long as the calendar has
months.  Rows meet folds by an equality on the date (a fold is spelled out into
its days), never by a range condition.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlab import constants as C

_SCHEMA = "fold_idx int, train_start date, val_start date, val_end date, train_end date"


def add_months(day: dt.date, months: int) -> dt.date:
    year, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return dt.date(year, month + 1, min(day.day, last))


def fold_list(
    first: dt.date,
    last: dt.date,
    min_train: int = C.FIRST_TRAIN_MONTHS,
    validation: int = C.VALIDATION_MONTHS,
    step: int = C.STEP_MONTHS,
) -> list[tuple[int, dt.date, dt.date, dt.date, dt.date]]:
    """(fold, train start, validation start, validation end, train end).

    Starts advance one step at a time, so a clipped month end stays clipped.
    """
    folds = []
    start = add_months(first, min_train)
    while add_months(start, validation) <= last:
        folds.append((len(folds) + 1, first, start, add_months(start, validation), start))
        start = add_months(start, step)
    return folds


def walk_forward_folds(matches: DataFrame, **months: int) -> DataFrame:
    """(fold_idx, train_start, val_start, val_end, train_end) for a match table."""
    span = matches.agg(F.min("match_date").alias("a"), F.max("match_date").alias("b")).first()
    folds = fold_list(span["a"], span["b"], **months) if span["a"] else []
    spark: SparkSession = matches.sparkSession
    return spark.createDataFrame(folds, _SCHEMA).coalesce(1)


def validation_days(folds: DataFrame) -> DataFrame:
    """The fold columns and match_date, one row per fold and day."""
    days = F.explode(F.sequence("val_start", F.date_sub("val_end", 1)))
    return folds.select("*", days.alias("match_date"))


def validation_rows(matches: DataFrame, folds: DataFrame) -> DataFrame:
    """Matches of each fold's validation window."""
    # The day table is bounded by the calendar, so it is always small enough to broadcast.
    return matches.join(F.broadcast(validation_days(folds)), "match_date")


def training_period(matches: DataFrame, folds: DataFrame) -> DataFrame:
    """Add ``period``, the first fold that trains on the match.

    Training windows only grow, so this one number says which folds see a match;
    matches after the last training window drop out.
    """
    previous = F.lag("train_end").over(Window.orderBy("fold_idx"))
    added = folds.select(
        F.col("fold_idx").alias("period"), F.coalesce(previous, "train_start").alias("_from"),
        F.date_sub("train_end", 1).alias("_to"),
    )
    days = added.select("period", F.explode(F.sequence("_from", "_to")).alias("match_date"))
    return matches.join(F.broadcast(days), "match_date")


def first_seen(matches: DataFrame) -> DataFrame:
    """(team, first_date): a team is known to a fold iff this lies in its training window."""
    sides = F.explode(F.array("home_team", "away_team")).alias("team")
    return matches.select("match_date", sides).groupBy("team").agg(
        F.min("match_date").alias("first_date")
    )


def known_teams_only(validation: DataFrame, matches: DataFrame) -> DataFrame:
    """Drop validation rows with a team the fold's training rows never show."""
    seen = first_seen(matches)
    out = validation
    for side in ("home", "away"):
        lookup = seen.withColumnsRenamed({"team": f"{side}_team", "first_date": "_first"})
        out = out.join(lookup, f"{side}_team").filter(F.col("_first") < F.col("train_end"))
        out = out.drop("_first")
    return out


def unseen_teams(matches: DataFrame, known: DataFrame) -> DataFrame:
    """(team): teams of ``matches`` without fitted parameters."""
    sides = F.explode(F.array("home_team", "away_team")).alias("team")
    return matches.select(sides).distinct().join(known.select("team"), "team", "left_anti")


def all_teams(matches: DataFrame) -> DataFrame:
    return matches.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct()


def fold_metrics(scored: DataFrame, by: str = "fold_idx") -> DataFrame:
    """Per fold: n_matches, rps, nll, n_value_bets, flat_roi, kelly_roi.

    ``scored`` carries rps, nll, is_value, kelly_stake, flat_return, kelly_return
    per match; ROIs are null without bets.
    """
    bet = F.col("is_value")

    def total(name: str):
        return F.sum(F.when(bet, F.col(name)))

    stakes = total("kelly_stake")
    return scored.groupBy(by).agg(
        F.count("*").alias("n_matches"),
        F.avg("rps").alias("rps"),
        F.avg("nll").alias("nll"),
        F.count_if(bet).alias("n_value_bets"),
        F.try_divide(total("flat_return"), F.count_if(bet)).alias("flat_roi"),
        F.when(stakes != 0, total("kelly_return") / stakes).alias("kelly_roi"),
    )


def backtest_summary(per_fold: DataFrame, by: str = "fold_idx") -> DataFrame:
    """Fold rows plus one row with a null fold: totals and unweighted means over folds."""
    return per_fold.rollup(by).agg(
        F.sum("n_matches").alias("n_matches"),
        F.avg("rps").alias("rps"),
        F.avg("nll").alias("nll"),
        F.sum("n_value_bets").alias("n_value_bets"),
        F.avg("flat_roi").alias("flat_roi"),
        F.avg("kelly_roi").alias("kelly_roi"),
    )
