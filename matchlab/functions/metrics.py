"""Row-level outcome, price and score expressions (all return Columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlab import constants as C


def outcome_class(home: Column, away: Column) -> Column:
    """0 home win, 1 draw, 2 away win."""
    return F.when(home > away, 0).when(home == away, 1).otherwise(2)


def outcome_word(home: Column, away: Column) -> Column:
    return F.when(home > away, "home").when(home == away, "draw").otherwise("away")


def rps(p_home: Column, p_draw: Column, outcome: Column) -> Column:
    """Ranked probability score of a 1X2 forecast."""
    first = p_home - F.when(outcome == 0, 1.0).otherwise(0.0)
    second = p_home + p_draw - F.when(outcome <= 1, 1.0).otherwise(0.0)
    return (first * first + second * second) / 2.0


def brier(prob: Column, happened: Column) -> Column:
    gap = prob - happened.cast("double")
    return gap * gap


def remove_margin(home: Column, draw: Column, away: Column) -> Column:
    """Struct of margin-free probabilities; null when a price is missing."""
    total = 1.0 / home + 1.0 / draw + 1.0 / away
    return F.struct(
        ((1.0 / home) / total).alias("home"),
        ((1.0 / draw) / total).alias("draw"),
        ((1.0 / away) / total).alias("away"),
    )


def rating_1x2(rating_home: Column, rating_away: Column, neutral: Column) -> Column:
    """Struct of 1X2 probabilities from two ratings."""
    gap = rating_home + F.when(neutral, 0.0).otherwise(C.HOME_ADVANTAGE) - rating_away
    drawn = C.DRAW_BASE_RATE * F.exp(-(gap * gap) / (2.0 * C.DRAW_RATING_SCALE**2))
    win = 1.0 / (1.0 + F.pow(F.lit(10.0), -gap / C.RATING_SCALE))
    return F.struct(
        (win * (1.0 - drawn)).alias("home"),
        drawn.alias("draw"),
        ((1.0 - win) * (1.0 - drawn)).alias("away"),
    )


def competition_k(tournament: Column) -> Column:
    """Update size of a competition: the longest listed prefix wins."""
    chain = None
    for name in sorted(C.COMPETITION_K, key=len, reverse=True):
        hit, value = tournament.startswith(name), F.lit(C.COMPETITION_K[name])
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(F.lit(C.DEFAULT_K))


def inactivity_decay(rating: Column, gap_days: Column) -> Column:
    """Pull a rating towards the start value after more than a year without a match.

    Linear in the gap and not clamped, so very long gaps overshoot.
    """
    pulled = rating - C.INACTIVITY_RATE * (gap_days / 365.0) * (rating - C.INITIAL_RATING)
    return F.when(gap_days > C.INACTIVITY_DAYS, pulled).otherwise(rating)


def temperature_scale(probs: list[Column], temperature: float) -> list[Column]:
    """Softmax of log-probabilities divided by a temperature."""
    powered = [
        F.exp(F.log(F.greatest(p, F.lit(C.LOG_FLOOR))) / F.lit(float(temperature))) for p in probs
    ]
    total = sum(powered[1:], powered[0])
    return [p / total for p in powered]
