import math

import pytest
from pyspark.sql import functions as F

from matchlab.functions import grid as G
from matchlab.functions import metrics as M

PARAMS = [(1, 1.4, 1.1, -0.05), (2, 0.2, 3.0, 0.1), (3, 2.0, 2.0, 0.0), (4, 0.01, 0.01, 0.08)]


@pytest.fixture(scope="module")
def grids(spark):
    df = spark.createDataFrame(PARAMS, "match_id bigint, lambda_home double, lambda_away double, rho double")
    return G.with_expected_goals(G.with_outcome_probs(G.with_markets(G.with_score_grid(df)))).collect()


def by_hand(lh, la, rho):
    p = lambda l, k: math.exp(-l) * l**k / math.factorial(k)
    g = [[p(lh, i) * p(la, j) for j in range(8)] for i in range(8)]
    g[0][0] *= 1 - lh * la * rho
    g[1][0] *= 1 + la * rho
    g[0][1] *= 1 + lh * rho
    g[1][1] *= 1 - rho
    total = sum(map(sum, g))
    return [[x / total for x in row] for row in g]


def test_cells_match_the_formula(grids):
    for row in grids:
        expected = [x for line in by_hand(row["lambda_home"], row["lambda_away"], row["rho"]) for x in line]
        assert row["grid"] == pytest.approx(expected, abs=1e-14)


def test_grid_and_markets_are_coherent(grids):
    for row in grids:
        m = row["markets"]
        assert sum(row["grid"]) == pytest.approx(1.0)
        assert min(row["grid"]) >= 0
        assert m["home_win"] + m["draw"] + m["away_win"] == pytest.approx(1.0)
        assert row["prob_home"] == pytest.approx(m["home_win"])
        for n in range(5):
            assert m[f"over_{n}_5"] + m[f"under_{n}_5"] == pytest.approx(1.0)
        overs = [m[f"over_{n}_5"] for n in range(5)]
        assert overs == sorted(overs, reverse=True)
        assert m["ah_home_m1_5"] <= m["ah_home_m0_5"] <= m["ah_home_p0_5"] <= m["ah_home_p1_5"]
        assert m["ah_home_m1_win"] + m["ah_home_m1_push"] == pytest.approx(m["home_win"])


def test_uniform_grid_expects_three_and_a_half_goals(spark):
    df = spark.range(1).select(F.array_repeat(F.lit(1 / 64), 64).alias("grid"))
    row = G.with_expected_goals(df).first()
    assert (row["expected_home"], row["expected_away"]) == pytest.approx((3.5, 3.5))


def test_top_scorelines_break_ties_by_score(spark):
    df = spark.range(1).select(F.array_repeat(F.lit(1 / 64), 64).alias("grid"))
    top = df.select(G.top_scorelines(F.col("grid"), 3).alias("t")).first()["t"]
    assert [(s["home"], s["away"]) for s in top] == [(0, 0), (0, 1), (0, 2)]


def test_scores_past_the_edge_use_the_edge_and_zero_cells_are_floored(spark):
    cells = [0.0] * 64
    cells[63] = 1.0
    df = spark.createDataFrame([(cells, 9, 12), (cells, 0, 0)], "grid array<double>, h int, a int")
    out = [r[0] for r in df.select(G.scoreline_nll(F.col("grid"), F.col("h"), F.col("a"))).collect()]
    assert out == pytest.approx([0.0, -math.log(1e-10)])


@pytest.mark.parametrize(
    "home,draw,outcome,expected",
    [(1.0, 0.0, 0, 0.0), (0.0, 0.0, 0, 1.0), (0.0, 1.0, 1, 0.0), (1.0, 0.0, 2, 1.0),
     (1 / 3, 1 / 3, 1, 1 / 9)],
)
def test_rps_closed_forms(spark, home, draw, outcome, expected):
    df = spark.createDataFrame([(home, draw, outcome)], "h double, d double, o int")
    assert df.select(M.rps(F.col("h"), F.col("d"), F.col("o"))).first()[0] == pytest.approx(expected)


def test_brier_of_a_coin(spark):
    df = spark.createDataFrame([(0.5, True), (0.5, False)], "p double, y boolean")
    assert [r[0] for r in df.select(M.brier(F.col("p"), F.col("y"))).collect()] == [0.25, 0.25]


def test_away_handicap_mirrors_home(grids, spark):
    df = spark.createDataFrame(PARAMS, "match_id bigint, lambda_home double, lambda_away double, rho double")
    rows = G.with_markets(G.with_score_grid(df)).select("markets", G.ah_away_side(F.col("markets")).alias("a")).collect()
    for r in rows:
        assert r["a"]["ah_away_p0_5"] == pytest.approx(r["markets"]["draw"] + r["markets"]["away_win"])
        assert r["a"]["ah_away_m1_5"] == pytest.approx(1 - r["markets"]["ah_home_p1_5"])
