"""Goal-rate adjustments and bet selection (Columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlab import constants as C


def _clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def injury_adjust(rate: Column, loss: Column, k: float = C.INJURY_K) -> Column:
    scaled = rate * (1.0 - k * F.coalesce(loss, F.lit(0.0)))
    return F.greatest(scaled, F.lit(C.RATE_FLOOR))


def sentiment_factor(
    score: Column, confidence: Column, k: float = C.SENTIMENT_K, gate: float = C.MIN_CONFIDENCE
) -> Column:
    """1.0 below the confidence gate or without a signal."""
    factor = _clamp(1.0 + k * score * confidence, *C.SENTIMENT_RANGE)
    return F.coalesce(F.when(confidence >= gate, factor), F.lit(1.0))


def trajectory_factor(
    score: Column, confidence: Column, k: float = C.TRAJECTORY_K, gate: float = C.MIN_CONFIDENCE
) -> Column:
    """Like the sentiment factor, but the score is not scaled by confidence."""
    factor = _clamp(1.0 + k * score, *C.TRAJECTORY_RANGE)
    return F.coalesce(F.when(confidence >= gate, factor), F.lit(1.0))


def scale_rate(rate: Column, factor: Column) -> Column:
    return F.greatest(rate * factor, F.lit(C.RATE_FLOOR))


def value_selection(
    probs: tuple[Column, Column, Column],
    market: tuple[Column, Column, Column],
    min_edge: float = C.MIN_EDGE,
    min_market_prob: float = C.MIN_MARKET_PROB,
    min_relative_edge: float = C.MIN_RELATIVE_EDGE,
) -> Column:
    """Struct(best_edge_outcome, best_edge, best_market_prob, is_value).

    Edges are rounded to nine places before the best is chosen, so that equal
    edges tie and the first of home, draw, away wins.  Missing prices are null
    and never a value bet.
    """
    words = ("home", "draw", "away")
    options = F.array(
        *[
            F.struct(
                F.round(p - m, 9).alias("rounded"),
                F.lit(-i).alias("order"),
                F.lit(word).alias("outcome"),
                (p - m).alias("edge"),
                m.alias("prob"),
            )
            for i, (word, p, m) in enumerate(zip(words, probs, market))
        ]
    )
    priced = market[0].isNotNull() & market[1].isNotNull() & market[2].isNotNull()
    best = F.when(priced, F.array_max(options))
    edge, prob = best["edge"], best["prob"]
    passes = (
        (edge >= min_edge)
        & (prob >= min_market_prob)
        & (prob > 0)
        & (edge / prob >= min_relative_edge)
    )
    return F.struct(
        best["outcome"].alias("best_edge_outcome"),
        edge.alias("best_edge"),
        prob.alias("best_market_prob"),
        F.coalesce(passes, F.lit(False)).alias("is_value"),
    )


def expected_value_pct(edge: Column, market_prob: Column) -> Column:
    return edge / market_prob * 100.0


def kelly_stake(edge: Column, odds: Column) -> Column:
    return C.KELLY_FRACTION * edge / odds
