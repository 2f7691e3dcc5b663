"""Calibration of forecast probabilities."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlab import constants as C
from matchlab.session import drop_durable, durable


def bin_index(prob: Column, bins: int = C.CALIBRATION_BINS) -> Column:
    """Equal-width bin of a probability; right-open edges, 1.0 in the last bin."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda edge: prob >= edge))


def _binned(df: DataFrame, prob: str, happened: str, bins: int) -> DataFrame:
    return df.groupBy(bin_index(F.col(prob), bins).alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg(prob).alias("mean_pred"),
        F.avg(F.col(happened).cast("double")).alias("frac_pos"),
    )


def reliability_bins(
    df: DataFrame, prob: str, happened: str, bins: int = C.CALIBRATION_BINS
) -> DataFrame:
    """(bin, n, mean_pred, frac_pos, is_small) for every bin, empty ones included."""
    spark = df.sparkSession
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    middle = (F.col("bin") + 0.5) / bins
    return every.join(_binned(df, prob, happened, bins), "bin", "left").select(
        "bin",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("mean_pred", middle).alias("mean_pred"),
        "frac_pos",
        (F.coalesce("n", F.lit(0)) < C.SMALL_BIN).alias("is_small"),
    )


def expected_calibration_error(
    df: DataFrame, prob: str, happened: str, bins: int = C.CALIBRATION_BINS
) -> DataFrame:
    """One row: ece."""
    binned = _binned(df, prob, happened, bins)
    gap = F.abs(F.col("mean_pred") - F.col("frac_pos"))
    return binned.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def _nll_at(probs: list[str], label: str, temperature: float) -> Column:
    logits = [F.log(F.greatest(F.col(p), F.lit(C.LOG_FLOOR))) / F.lit(temperature) for p in probs]
    chosen = F.element_at(F.array(*logits), F.col(label).cast("int") + 1)
    return F.avg(F.log(sum((F.exp(z) for z in logits[1:]), F.exp(logits[0]))) - chosen)


def fit_temperature(
    df: DataFrame, probs: list[str], label: str, points: int = 12, width: float = 1e-4
) -> float:
    """Temperature in (0.01, 10) with the least mean NLL.

    The loss has one valley in log-temperature.  Each round is one aggregate
    over the table that evaluates all candidates, and keeps the bracket round
    the best of them, until the bracket is narrower than ``width``, relatively.
    """
    df = durable(df.select(*probs, label))
    low, high = C.TEMPERATURE_RANGE
    while high / low > 1 + width:
        ratio = (high / low) ** (1.0 / (points - 1))
        candidates = [low * ratio**i for i in range(points)]
        losses = df.agg(
            *[_nll_at(probs, label, t).alias(f"t{i}") for i, t in enumerate(candidates)]
        ).first()
        best = min(range(points), key=lambda i: losses[i])
        low, high = candidates[max(best - 1, 0)], candidates[min(best + 1, points - 1)]
    drop_durable(df)
    return (low * high) ** 0.5


def fit_isotonic(df: DataFrame, prob: str, happened: str):
    """Monotone calibration model; predictions outside the seen range are clipped.

    Equal probabilities are pooled into one weighted point first, so repeated
    forecasts cost nothing in the fit.
    """
    points = df.groupBy(F.col(prob).alias("prob")).agg(
        F.avg(F.col(happened).cast("double")).alias("label"),
        F.count("*").cast("double").alias("weight"),
    )
    isotonic = IsotonicRegression(
        featuresCol="prob", labelCol="label", weightCol="weight", isotonic=True
    )
    return isotonic.fit(points)
