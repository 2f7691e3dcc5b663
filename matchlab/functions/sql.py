"""The grid, market and metric expressions as functions of SQL text.

``register(spark)`` creates them as temporary functions of the session. Their bodies are
plain SQL arithmetic, so they run in generated code like the Column helpers:

    select match_id, score_markets(score_grid(lambda_home, lambda_away, rho)).* from forecasts
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from matchlab import constants as C
from matchlab.functions.grid import CELLS, MARKETS, SIZE, _poisson, _sum


def _grid_body() -> str:
    factor = {
        (0, 0): "(1.0D - lambda_home * lambda_away * rho)", (1, 0): "(1.0D + lambda_away * rho)",
        (0, 1): "(1.0D + lambda_home * rho)", (1, 1): "(1.0D - rho)",
    }
    pmf = {side: [f"({_poisson(f'lambda_{side}', k)})" for k in range(SIZE)] for side in ("home", "away")}
    shift = _sum([f"{pmf['home'][i]} * {pmf['away'][j]} * ({f} - 1.0D)" for (i, j), f in factor.items()])
    mass = f"(({_sum(pmf['home'])}) * ({_sum(pmf['away'])}) + {shift})"
    cells = [" * ".join([pmf["home"][i], pmf["away"][j], *([factor[i, j]] if (i, j) in factor else [])]) for i, j in CELLS]
    return f"array({', '.join(f'{cell} / {mass}' for cell in cells)})"


def _cells(wanted, weight=None) -> str:
    """Sum of the cells of ``grid`` for which ``wanted(home, away)`` holds."""
    times = lambda i, j: "" if weight is None else f"{float(weight(i, j))}D * "
    return _sum([f"{times(i, j)}grid[{SIZE * i + j}]" for i, j in CELLS if wanted(i, j)])


def _market_bodies() -> dict[str, str]:
    """Each market as a sum over the grid."""
    by = lambda low: _cells(lambda i, j: i - j >= low)
    level = lambda d: _cells(lambda i, j: i - j == d)
    blank = _cells(lambda i, j: i == 0 or j == 0)
    out = {
        "home_win": by(1), "draw": level(0), "away_win": _cells(lambda i, j: i < j), "btts_yes": f"1.0D - ({blank})", "btts_no": blank,
        "ah_home_m1_5": by(2), "ah_home_m0_5": by(1), "ah_home_p0_5": by(0), "ah_home_p1_5": by(-1),
        "ah_home_m1_win": by(2), "ah_home_m1_push": level(1), "ah_home_p1_win": by(0), "ah_home_p1_push": level(-1),
    }
    for n in range(5):
        few = _cells(lambda i, j, n=n: i + j <= n)
        out[f"under_{n}_5"], out[f"over_{n}_5"] = few, f"1.0D - ({few})"
    return {m: out[m] for m in MARKETS}


def _struct(fields: dict[str, str]) -> str:
    return f"named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items())})"


def _competition_body() -> str:
    cases = [f"when startswith(tournament, '{n.replace(chr(39), chr(39) * 2)}') then {float(C.COMPETITION_K[n])}D" for n in sorted(C.COMPETITION_K, key=len, reverse=True)]
    return f"case {' '.join(cases)} else {float(C.DEFAULT_K)}D end"


def _gated(gate: float, factor: str, low_high: tuple[float, float]) -> str:
    low, high = low_high
    return f"coalesce(case when confidence >= {gate}D then greatest({low}D, least({high}D, {factor})) end, 1.0D)"


def definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, result type, body)."""
    doubles = lambda *names: ", ".join(f"{n} double" for n in names)
    fields = lambda *names: f"struct<{', '.join(f'{n}: double' for n in names)}>"
    grid, score = "grid array<double>", "home int, away int"
    cell = f"grid[{SIZE} * least(home, {C.MAX_GOALS}) + least(away, {C.MAX_GOALS})]"
    implied = "(1.0D / home + 1.0D / draw + 1.0D / away)"
    gap = f"(rating_home + case when neutral then 0.0D else {float(C.HOME_ADVANTAGE)}D end - rating_away)"
    drawn = f"({C.DRAW_BASE_RATE}D * exp(-({gap} * {gap}) / {2.0 * C.DRAW_RATING_SCALE**2}D))"
    win = f"(1.0D / (1.0D + pow(10.0D, -{gap} / {float(C.RATING_SCALE)}D)))"
    first = "(p_home - case when outcome = 0 then 1.0D else 0.0D end)"
    second = "(p_home + p_draw - case when outcome <= 1 then 1.0D else 0.0D end)"
    return {
        "score_grid": (doubles("lambda_home", "lambda_away", "rho"), "array<double>", _grid_body()),
        "score_markets": (grid, fields(*MARKETS), _struct(_market_bodies())),
        "score_outcomes": (grid, fields("home", "draw", "away"), _struct({
            "home": _cells(lambda i, j: i > j), "draw": _cells(lambda i, j: i == j), "away": _cells(lambda i, j: i < j)})),
        "score_means": (grid, fields("home", "away"), _struct({
            "home": _cells(lambda i, j: i, lambda i, j: i), "away": _cells(lambda i, j: j, lambda i, j: j)})),
        "score_probability": (f"{grid}, {score}", "double", cell),
        "score_nll": (f"{grid}, {score}", "double", f"-ln(greatest({cell}, {C.LOG_FLOOR}D))"),
        "outcome_class": (score, "int", "case when home > away then 0 when home = away then 1 else 2 end"),
        "forecast_rps": ("p_home double, p_draw double, outcome int", "double", f"({first} * {first} + {second} * {second}) / 2.0D"),
        "forecast_brier": ("prob double, happened double", "double", "(prob - happened) * (prob - happened)"),
        "remove_margin": (doubles("home", "draw", "away"), fields("home", "draw", "away"), _struct({
            n: f"(1.0D / {n}) / {implied}" for n in ("home", "draw", "away")})),
        "rating_outcomes": ("rating_home double, rating_away double, neutral boolean", fields("home", "draw", "away"), _struct({
            "home": f"{win} * (1.0D - {drawn})", "draw": drawn, "away": f"(1.0D - {win}) * (1.0D - {drawn})"})),
        "competition_k": ("tournament string", "double", _competition_body()),
        "inactivity_decay": ("rating double, gap_days int", "double",
            f"case when gap_days > {C.INACTIVITY_DAYS} then rating - {C.INACTIVITY_RATE}D * (gap_days / 365.0D) * "
            f"(rating - {float(C.INITIAL_RATING)}D) else rating end"),
        "injury_adjust": (doubles("rate", "loss"), "double",
            f"greatest(rate * (1.0D - {C.INJURY_K}D * coalesce(loss, 0.0D)), {C.RATE_FLOOR}D)"),
        "sentiment_factor": (doubles("score", "confidence"), "double",
            _gated(C.MIN_CONFIDENCE, f"1.0D + {C.SENTIMENT_K}D * score * confidence", C.SENTIMENT_RANGE)),
        "trajectory_factor": (doubles("score", "confidence"), "double",
            _gated(C.MIN_CONFIDENCE, f"1.0D + {C.TRAJECTORY_K}D * score", C.TRAJECTORY_RANGE)),
    }


def register(spark: SparkSession) -> list[str]:
    """Create all functions in the session, replacing earlier ones; returns their names."""
    made = definitions()
    for name, (parameters, result, body) in made.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
    return list(made)
