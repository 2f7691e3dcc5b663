"""Second-order fits of the goal rates: hard histories, both ways to solve, the regression, and SQL functions."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import MATCH_SCHEMA, random_matches
from matchlab.functions import adjust as A
from matchlab.functions import grid
from matchlab.functions import metrics as M
from matchlab.functions import sql as S
from matchlab.models import goal_rates as G
from matchlab.models import poisson_glm


def parameters(fitted):
    teams, scalars = fitted
    return {r["team"]: (r["log_alpha"], r["log_beta"]) for r in teams.collect()}, tuple(scalars.select("log_gamma", "rho").first())


def apart(one, other):
    assert set(one[0]) == set(other[0])
    gaps = [abs(x - y) for t in one[0] for x, y in zip(one[0][t], other[0][t])]
    return max([*gaps, *(abs(x - y) for x, y in zip(one[1], other[1]))])


def idle_history():
    """Six teams that play until 2020, six that stopped in 1990, and some matches across before that."""
    rng = random.Random(4)
    rows = []
    for i in range(480):
        old = i % 2 == 0
        start = dt.date(1986, 1, 1) if old else dt.date(2016, 1, 1)
        teams = [f"T{k:02d}" for k in (range(12) if i % 8 == 0 else range(6, 12) if old else range(6))]
        home, away = rng.sample(teams, 2)
        rows.append((i, start + dt.timedelta(days=3 * i), home, away, rng.randrange(4), rng.randrange(3), i % 5 == 0, "Cup", "x"))
    return rows


def test_teams_idle_for_decades(spark):
    stats = G.sufficient_stats(spark.createDataFrame(idle_history(), MATCH_SCHEMA))
    teams, (gamma, rho) = parameters(G.fit(stats))
    assert len(teams) == 12 and all(map(math.isfinite, [gamma, rho, *(x for t in teams.values() for x in t)]))
    # The idle teams among themselves are at their own optimum, however little they weigh.
    named = [(t, a, b) for t, (a, b) in teams.items()]
    frame = spark.createDataFrame(named, "team string, attack double, defence double")
    scalars = spark.createDataFrame([(gamma, rho)], "log_gamma double, rho double")
    slopes = {
        (r["i"], r["j"]): r["value"] for r in G._moments(G._with_rates(stats, frame, scalars, []), []).collect()
    }
    for kind in "ad":
        for team in teams:
            assert abs(slopes[kind + team, ""]) <= 1e-5 * slopes[kind + team, kind + team]


def test_both_ways_to_solve_agree(spark):
    """Two models at once, by one task each and by conjugate gradients."""
    df = spark.createDataFrame(random_matches(200, teams=3, seed=8), MATCH_SCHEMA)
    stats = G.sufficient_stats(df.withColumn("fold_idx", (F.col("match_id") % 2).cast("int")), ("fold_idx",))
    one, other = (
        {(r["fold_idx"], r["team"]): r["log_alpha"] for r in G.fit(stats, by=("fold_idx",), dense=d)[0].collect()} for d in (0, G.DENSE)
    )
    assert set(one) == set(other) and len(one) == 6 and max(abs(one[k] - other[k]) for k in one) < 1e-6


def test_a_side_without_goals_is_held(spark):
    rows = [r for r in random_matches(200, teams=4, seed=2)]
    rows = [(*r[:4], 0 if r[2] == "P0T3" else r[4], 0 if r[3] == "P0T3" else r[5], *r[6:]) for r in rows]
    teams, _ = parameters(G.fit(G.sufficient_stats(spark.createDataFrame(rows, MATCH_SCHEMA))))
    assert teams["P0T3"][0] < -15 and all(abs(a) < 3 and abs(b) < 3 for t, (a, b) in teams.items() if t != "P0T3")


def test_fits_of_nothing(spark):
    none = G.sufficient_stats(spark.createDataFrame([], MATCH_SCHEMA))
    assert G.fit(none)[0].count() == 0
    assert poisson_glm.fit(none)[0].count() == 0


def test_regression_agrees_with_the_fit_without_low_scores(spark):
    df = spark.createDataFrame(random_matches(500, teams=6, seed=6, pools=2), MATCH_SCHEMA)
    stats = G.sufficient_stats(df)
    plain = stats.withColumns({c: F.lit(0.0) for c in ("n00", "n10", "n01", "n11")})
    wanted, (gamma, rho) = parameters(G.fit(plain, tolerance=1e-8))
    assert rho == 0.0
    got, (own_gamma, own_rho) = parameters(poisson_glm.fit(stats))
    assert apart((got, (own_gamma,)), (wanted, (gamma,))) < 1e-6
    # Groups that never met: the first of each has attack 0.
    assert {t for t, (a, _) in got.items() if a == 0.0} == {"P0T0", "P1T0"}
    # rho is the best one for these rates.
    named = spark.createDataFrame([(t, a, b) for t, (a, b) in got.items()], "team string, attack double, defence double")

    def total(value):
        rated = G._with_rates(stats, named, spark.createDataFrame([(gamma, value)], "log_gamma double, rho double"), [])
        return rated.agg(F.sum(G.log_likelihood(rated))).first()[0]

    assert total(own_rho) > max(total(own_rho + 1e-3), total(own_rho - 1e-3))


def test_regression_refuses_too_many_coefficients(spark, monkeypatch):
    monkeypatch.setattr(poisson_glm, "MOST_FEATURES", 10)
    with pytest.raises(ValueError, match="13 coefficients"):
        poisson_glm.fit(G.sufficient_stats(spark.createDataFrame(random_matches(60, teams=6), MATCH_SCHEMA)))


def test_sql_functions_equal_the_column_helpers(spark):
    assert set(S.register(spark)) == set(S.definitions())
    rng = np.random.default_rng(1)
    rows = [
        (float(a), float(b), float(r), int(h), int(g), float(p), float(q), float(x), float(c), bool(n), int(d), t)
        for a, b, r, h, g, p, q, x, c, n, d, t in zip(
            rng.uniform(0.3, 3, 40), rng.uniform(0.3, 3, 40), rng.uniform(-0.1, 0.1, 40), rng.integers(0, 11, 40), rng.integers(0, 11, 40),
            rng.uniform(0.2, 0.5, 40), rng.uniform(0.1, 0.4, 40), rng.uniform(-3, 3, 40), rng.uniform(0, 1, 40), rng.random(40) < 0.5,
            rng.integers(0, 900, 40), rng.choice(["Friendly", "FIFA World Cup", "FIFA World Cup qualification", "UEFA Euro", "X"], 40),
        )
    ]
    df = spark.createDataFrame(rows, "lh double, la double, rho double, h int, a int, p double, q double, x double, c double, n boolean, d int, t string")
    df = grid.with_expected_goals(grid.with_outcome_probs(grid.with_markets(grid.with_score_grid(df, "lh", "la", "rho"))))
    df.createOrReplaceTempView("sql_cases")
    col = F.col
    outcome = M.outcome_class(col("h"), col("a"))
    pairs = {
        "score_grid(lh, la, rho)": col("grid"), "score_markets(grid)": col("markets"),
        "score_outcomes(grid)": F.struct("prob_home", "prob_draw", "prob_away"), "score_means(grid)": F.struct("expected_home", "expected_away"),
        "score_probability(grid, h, a)": grid.score_probability(col("grid"), col("h"), col("a")),
        "score_nll(grid, h, a)": grid.scoreline_nll(col("grid"), col("h"), col("a")), "outcome_class(h, a)": outcome,
        "forecast_rps(p, q, outcome_class(h, a))": M.rps(col("p"), col("q"), outcome),
        "forecast_brier(p, double(n))": M.brier(col("p"), col("n")), "remove_margin(1 + lh, 2 + la, 3)": M.remove_margin(1 + col("lh"), 2 + col("la"), F.lit(3.0)),
        "rating_outcomes(1500 + 100 * x, 1500, n)": M.rating_1x2(1500 + 100 * col("x"), F.lit(1500.0), col("n")),
        "competition_k(t)": M.competition_k(col("t")).cast("double"), "inactivity_decay(1500 + 100 * x, d)": M.inactivity_decay(1500 + 100 * col("x"), col("d")),
        "injury_adjust(lh, c)": A.injury_adjust(col("lh"), col("c")), "sentiment_factor(x, c)": A.sentiment_factor(col("x"), col("c")),
        "trajectory_factor(x, c)": A.trajectory_factor(col("x"), col("c")),
    }
    told = spark.sql(f"select {', '.join(f'{call} as v{i}' for i, call in enumerate(pairs))} from sql_cases").collect()
    wanted = df.select(*[v.alias(f"v{i}") for i, v in enumerate(pairs.values())]).collect()

    def flat(value):
        return [y for x in value for y in flat(x)] if isinstance(value, (tuple, list)) else [value]

    for i, call in enumerate(pairs):
        for x, y in zip(told, wanted):
            assert flat(x[i]) == pytest.approx(flat(y[i]), rel=1e-9, abs=1e-12), call


def test_sql_functions_run_in_generated_code(spark):
    S.register(spark)
    spark.range(100).selectExpr("1.0D + id / 100 as lh", "1.2D as la", "-0.05D as rho").createOrReplaceTempView("sql_rates")
    plan = spark.sql("select score_markets(score_grid(lh, la, rho)) as m from sql_rates")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "*(1) Project" in plan
