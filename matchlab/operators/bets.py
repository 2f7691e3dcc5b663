"""Model probabilities against prices: selection, staking and returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlab import constants as C
from matchlab.functions import adjust as A
from matchlab.functions import metrics as M
from matchlab.functions.once import with_once

OUTCOMES = ("home", "draw", "away")


def with_market_probs(predictions: DataFrame) -> DataFrame:
    """Add margin_home, margin_draw, margin_away; null without all three prices."""
    if "odds_home" not in predictions.columns:
        return predictions.withColumns(
            {f"margin_{o}": F.lit(None).cast("double") for o in OUTCOMES}
        )
    prices = [F.col(f"odds_{o}") for o in OUTCOMES]
    fair = M.remove_margin(*prices)
    return predictions.withColumn("_fair", fair).select(
        *predictions.columns, *[F.col(f"_fair.{o}").alias(f"margin_{o}") for o in OUTCOMES]
    )


def with_selection(
    predictions: DataFrame,
    min_edge: float = C.MIN_EDGE,
    min_market_prob: float = C.MIN_MARKET_PROB,
    min_relative_edge: float = C.MIN_RELATIVE_EDGE,
) -> DataFrame:
    """Add the best-edge outcome, its edge and market probability, and is_value."""
    df = with_market_probs(predictions)
    pick = A.value_selection(
        tuple(F.col(f"prob_{o}") for o in OUTCOMES),
        tuple(F.col(f"margin_{o}") for o in OUTCOMES),
        min_edge, min_market_prob, min_relative_edge,
    )
    return with_once(df, "_pick", pick).select(*df.columns, "_pick.*")


def _picked_odds(df: DataFrame) -> Column:
    if "odds_home" not in df.columns:
        return F.lit(None).cast("double")
    pick = F.col("best_edge_outcome")
    return (
        F.when(pick == "home", F.col("odds_home"))
        .when(pick == "draw", F.col("odds_draw"))
        .when(pick == "away", F.col("odds_away"))
    )


def with_returns(selected: DataFrame) -> DataFrame:
    """Add kelly_stake, outcome_won, flat_return, kelly_return."""
    odds = _picked_odds(selected)
    won = F.col("best_edge_outcome") == M.outcome_word(F.col("home_score"), F.col("away_score"))
    stake = A.kelly_stake(F.col("best_edge"), odds)
    return selected.withColumns({"kelly_stake": stake, "outcome_won": won}).withColumns(
        {
            "flat_return": F.when(F.col("outcome_won"), odds - 1.0).otherwise(
                F.when(odds.isNotNull(), -1.0)
            ),
            "kelly_return": F.when(
                F.col("outcome_won"), F.col("kelly_stake") * (odds - 1.0)
            ).otherwise(-F.col("kelly_stake")),
        }
    )


def value_bets(predictions: DataFrame, **gates: float) -> DataFrame:
    """Value bets only, with stake and returns; the full schema even when empty."""
    return with_returns(with_selection(predictions, **gates).filter("is_value"))


def live_bets(predictions: DataFrame, **gates: float) -> DataFrame:
    """Every priced prediction with its selection; a stake only for value bets above evens."""
    df = with_selection(predictions, **gates)
    odds = _picked_odds(df)
    stake = F.when(F.col("is_value") & (odds > 1.0), A.kelly_stake(F.col("best_edge"), odds))
    return df.withColumns(
        {
            "kelly_stake": F.coalesce(stake, F.lit(0.0)),
            "ev_pct": A.expected_value_pct(F.col("best_edge"), F.col("best_market_prob")),
        }
    )


def best_edges(selected: DataFrame, k: int) -> DataFrame:
    """The k largest edges (a top-k report)."""
    return selected.orderBy(F.desc(F.round("best_edge", 9)), "match_id").limit(k)
