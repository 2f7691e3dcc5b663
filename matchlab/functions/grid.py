"""Joint score distribution and the market probabilities read off it.

The distribution is an ``array<double>`` of 64 cells, row-major
(``k = 8 * home + away``).  Cells, sums and markets are written out as plain SQL
arithmetic over columns rather than as lambdas over arrays, so that they run in
generated code; each step is its own projection, so that no step is computed
twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlab.constants import LOG_FLOOR, MAX_GOALS

SIZE = MAX_GOALS + 1
CELLS = [(i, j) for i in range(SIZE) for j in range(SIZE)]
MARKETS = [
    "home_win", "draw", "away_win",
    "over_0_5", "under_0_5", "over_1_5", "under_1_5", "over_2_5", "under_2_5",
    "over_3_5", "under_3_5", "over_4_5", "under_4_5",
    "btts_yes", "btts_no",
    "ah_home_m1_5", "ah_home_m0_5", "ah_home_p0_5", "ah_home_p1_5",
    "ah_home_m1_win", "ah_home_m1_push", "ah_home_p1_win", "ah_home_p1_push",
]


def _sum(terms: list[str]) -> str:
    return " + ".join(terms) if terms else "0.0D"


def _quoted(columns: list[str]) -> list[str]:
    return [f"`{c}`" for c in columns]


def _cells(grid: str, wanted, weight=None) -> str:
    """Sum of the cells for which ``wanted(home, away)`` holds, as SQL text."""
    terms = []
    for i, j in CELLS:
        if wanted(i, j):
            factor = "" if weight is None else f"{float(weight(i, j))}D * "
            terms.append(f"{factor}`{grid}`[{SIZE * i + j}]")
    return _sum(terms)


def _poisson(rate: str, goals: int) -> str:
    power = " * ".join([rate] * goals)
    return f"exp(-{rate}) * {power or '1.0D'} / {math.factorial(goals)}.0D"


def poisson_pmf(rate: str) -> Column:
    """``array<double>`` of P(k goals), k = 0..7, for the scoring rate in a column."""
    return F.expr("array(" + ", ".join(_poisson(f"`{rate}`", k) for k in range(SIZE)) + ")")


def with_score_grid(
    df: DataFrame,
    lambda_home: str = "lambda_home",
    lambda_away: str = "lambda_away",
    rho: str = "rho",
    out: str = "grid",
) -> DataFrame:
    """Add the normalised 64-cell distribution built from the two rates and rho."""
    home, away, low = _quoted([lambda_home, lambda_away, rho])
    kept = _quoted([c for c in df.columns if c != out])
    # Plain columns, not arrays: the optimizer would inline array items into every cell.
    pmf = df.selectExpr(
        *kept,
        *[f"{_poisson(home, k)} as _h{k}" for k in range(SIZE)],
        *[f"{_poisson(away, k)} as _a{k}" for k in range(SIZE)],
    )
    # Low scores are dependent: four cells carry a correction factor.
    factor = {
        (0, 0): f"(1.0D - {home} * {away} * {low})",
        (1, 0): f"(1.0D + {away} * {low})",
        (0, 1): f"(1.0D + {home} * {low})",
        (1, 1): f"(1.0D - {low})",
    }
    independent = [f"({_sum([f'_{s}{k}' for k in range(SIZE)])})" for s in "ha"]
    shift = _sum([f"_h{i} * _a{j} * ({f} - 1.0D)" for (i, j), f in factor.items()])
    mass = pmf.selectExpr("*", f"{' * '.join(independent)} + {shift} as _mass")
    cells = [
        " * ".join([f"_h{i}", f"_a{j}", *([factor[i, j]] if (i, j) in factor else [])]) + " / _mass"
        for i, j in CELLS
    ]
    return mass.selectExpr(*kept, f"array({', '.join(cells)}) as `{out}`")


def with_markets(df: DataFrame, grid: str = "grid", out: str = "markets") -> DataFrame:
    """Add a struct of the 23 market probabilities, all sums over one grid."""
    kept = _quoted([c for c in df.columns if c != out])
    margins = [
        f"{_cells(grid, lambda i, j, d=d: i - j == d)} as _d{d + MAX_GOALS}"
        for d in range(-MAX_GOALS, SIZE)
    ]
    totals = [f"{_cells(grid, lambda i, j, t=t: i + j == t)} as _t{t}" for t in range(5)]
    blank = f"{_cells(grid, lambda i, j: i == 0 or j == 0)} as _blank"
    summed = df.selectExpr(*kept, *margins, *totals, blank)

    def margin(low: int, high: int) -> str:
        return _sum([f"_d{d + MAX_GOALS}" for d in range(low, high + 1)])

    base = summed.selectExpr(
        *kept,
        f"{margin(1, 7)} as _home", f"{margin(0, 0)} as _draw", f"{margin(-7, -1)} as _away",
        f"{margin(2, 7)} as _by2", f"{margin(1, 1)} as _by1",
        f"{margin(-1, 7)} as _not2", f"{margin(-1, -1)} as _lose1",
        *[f"{_sum([f'_t{t}' for t in range(n + 1)])} as _u{n}" for n in range(5)],
        "_blank",
    )
    values = {
        "home_win": "_home", "draw": "_draw", "away_win": "_away",
        "btts_yes": "1.0D - _blank", "btts_no": "_blank",
        "ah_home_m1_5": "_by2", "ah_home_m0_5": "_home",
        "ah_home_p0_5": "_home + _draw", "ah_home_p1_5": "_not2",
        "ah_home_m1_win": "_by2", "ah_home_m1_push": "_by1",
        "ah_home_p1_win": "_home + _draw", "ah_home_p1_push": "_lose1",
    }
    for n in range(5):
        values[f"under_{n}_5"] = f"_u{n}"
        values[f"over_{n}_5"] = f"1.0D - _u{n}"
    fields = ", ".join(f"'{m}', {values[m]}" for m in MARKETS)
    return base.selectExpr(*kept, f"named_struct({fields}) as `{out}`")


def with_outcome_probs(df: DataFrame, grid: str = "grid") -> DataFrame:
    """Add prob_home, prob_draw, prob_away only."""
    return df.withColumns(
        {
            "prob_home": F.expr(_cells(grid, lambda i, j: i > j)),
            "prob_draw": F.expr(_cells(grid, lambda i, j: i == j)),
            "prob_away": F.expr(_cells(grid, lambda i, j: i < j)),
        }
    )


def with_expected_goals(df: DataFrame, grid: str = "grid") -> DataFrame:
    """Add expected_home and expected_away, the means of the two marginals."""
    return df.withColumns(
        {
            "expected_home": F.expr(_cells(grid, lambda i, j: i, lambda i, j: i)),
            "expected_away": F.expr(_cells(grid, lambda i, j: j, lambda i, j: j)),
        }
    )


def ah_away_side(markets: Column) -> Column:
    """Away side of the half-goal handicap lines."""
    return F.struct(
        (1.0 - markets["ah_home_p1_5"]).alias("ah_away_m1_5"),
        markets["away_win"].alias("ah_away_m0_5"),
        (1.0 - markets["ah_home_m0_5"]).alias("ah_away_p0_5"),
        (1.0 - markets["ah_home_m1_5"]).alias("ah_away_p1_5"),
    )


def top_scorelines(grid: Column, n: int = 5) -> Column:
    """``array<struct<home,away,prob>>`` of the n likeliest scores, best first."""
    ranked = F.array_sort(
        F.transform(grid, lambda p, k: F.struct((-p).alias("neg"), k.alias("k")))
    )
    return F.transform(
        F.slice(ranked, 1, n),
        lambda s: F.struct(
            F.floor(s["k"] / SIZE).cast("int").alias("home"),
            (s["k"] % SIZE).cast("int").alias("away"),
            (-s["neg"]).alias("prob"),
        ),
    )


def score_probability(grid: Column, home: Column, away: Column) -> Column:
    """Cell of an actual score; scores past the edge use the edge cell."""
    edge = F.lit(MAX_GOALS)
    index = F.least(home, edge) * SIZE + F.least(away, edge) + 1
    return F.element_at(grid, index.cast("int"))


def scoreline_nll(grid: Column, home: Column, away: Column) -> Column:
    """Negative log-likelihood of the actual score, with the probability floored."""
    return -F.log(F.greatest(score_probability(grid, home, away), F.lit(LOG_FLOOR)))
