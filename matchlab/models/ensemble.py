"""Weighted means of score grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlab.functions.grid import CELLS, with_expected_goals, with_outcome_probs, with_score_grid
from matchlab.functions.once import with_once


def inverse_rps_weights(scores: DataFrame) -> DataFrame:
    """(model, weight) from (model, rps): weight = (1/rps) / sum(1/rps); rps must be positive."""
    checked = scores.withColumn(
        "rps",
        F.when(F.col("rps") > 0, F.col("rps")).otherwise(
            F.raise_error(F.lit("all RPS scores must be positive")).cast("double")
        ),
    )
    # One row per model: the window is as small as the list of models.
    everything = Window.partitionBy(F.lit(1))
    inverse = 1.0 / F.col("rps")
    return checked.select("model", (inverse / F.sum(inverse).over(everything)).alias("weight"))


def check_weights(weights: list[float], models: int) -> list[float]:
    if not models:
        raise ValueError("an ensemble needs at least one model")
    if len(weights) != models:
        raise ValueError(f"{len(weights)} weights for {models} models")
    if abs(sum(weights) - 1.0) > 1e-6:
        raise ValueError(f"weights must sum to 1, got {sum(weights):.6f}")
    return list(weights)


def ensemble_grid(
    predictions: list[DataFrame], weights: list[float] | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """(keys, grid, 1X2, expected goals) of the weighted mean of the models' grids.

    Markets are derived again from the mean grid.  The rates of the mean are its
    expected goals, and rho is 0.  A prediction without ``grid`` is joined by its
    rates (lambda_home, lambda_away, rho), three numbers instead of 64, and its grid
    is built from them after the join.
    """
    n = len(predictions)
    weights = check_weights(weights if weights is not None else [1.0 / max(n, 1)] * n, n)
    keys = keys or ["match_id"]
    rates = ["lambda_home", "lambda_away", "rho"]
    bare = [i for i, p in enumerate(predictions) if "grid" not in p.columns]
    parts = [
        p.select(*keys, *([F.col(c).alias(f"_{c}_{i}") for c in rates] if i in bare else [F.col("grid").alias(f"_g{i}")]))
        for i, p in enumerate(predictions)
    ]
    joined = reduce(lambda a, b: a.join(b, keys), parts)
    for i in bare:
        made = with_score_grid(joined, *[f"_{c}_{i}" for c in rates], out="_made")
        joined = with_once(made, f"_g{i}", F.col("_made")).drop("_made", *[f"_{c}_{i}" for c in rates])
    cells = [
        " + ".join(f"{float(w)}D * _g{i}[{k}]" for i, w in enumerate(weights))
        for k in range(len(CELLS))
    ]
    mean = joined.select(*keys, F.expr(f"array({', '.join(cells)})").alias("grid"))
    out = with_expected_goals(with_outcome_probs(mean))
    return out.withColumns(
        {
            "lambda_home": F.col("expected_home"),
            "lambda_away": F.col("expected_away"),
            "rho": F.lit(0.0),
        }
    )
