import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import MATCH_SCHEMA, day, random_matches
from matchlab.functions import adjust as A
from matchlab.operators import bets as B
from matchlab.operators import calibration as L
from matchlab.operators import folds as D
from matchlab.operators import odds as O

PRED = (
    "match_id int, prob_home double, prob_draw double, prob_away double, odds_home double, "
    "odds_draw double, odds_away double, home_score int, away_score int"
)


def selection(spark, probs, market):
    df = spark.createDataFrame([(*probs, *market)], "a double, b double, c double, x double, y double, z double")
    pick = A.value_selection(tuple(map(F.col, "abc")), tuple(map(F.col, "xyz")))
    return df.select(pick.alias("s")).first()["s"]


@pytest.mark.parametrize(
    "model,market,value",
    [(0.09, 0.06, False), (0.42, 0.39, False), (0.55, 0.40, True), (0.10, 0.08, True)],
)
def test_three_gates(spark, model, market, value):
    rest, other = (1 - model) / 2, (1 - market) / 2
    s = selection(spark, (model, rest, rest), (market, other, other))
    assert (s["best_edge_outcome"], s["is_value"]) == ("home", value)
    assert s["best_edge"] == pytest.approx(model - market)


def test_missing_prices_are_never_value(spark):
    s = selection(spark, (0.5, 0.3, 0.2), (None, 0.3, 0.2))
    assert (s["best_edge_outcome"], s["is_value"]) == (None, False)


def test_equal_edges_choose_home_first(spark):
    s = selection(spark, (0.4, 0.2, 0.4), (0.35, 0.3, 0.35))
    assert s["best_edge_outcome"] == "home"


def test_stake_and_returns(spark):
    rows = [(1, 0.55, 0.25, 0.20, 2.4, 3.6, 4.5, 2, 0), (2, 0.55, 0.25, 0.20, 2.4, 3.6, 4.5, 0, 0)]
    won, lost = B.value_bets(spark.createDataFrame(rows, PRED)).orderBy("match_id").collect()
    total = 1 / 2.4 + 1 / 3.6 + 1 / 4.5
    edge = 0.55 - (1 / 2.4) / total
    assert won["kelly_stake"] == pytest.approx(0.25 * edge / 2.4)
    assert won["flat_return"] == pytest.approx(1.4) and lost["flat_return"] == -1.0
    assert won["kelly_return"] == pytest.approx(won["kelly_stake"] * 1.4)
    assert lost["kelly_return"] == pytest.approx(-lost["kelly_stake"])


def test_empty_and_unpriced_predictions_keep_the_schema(spark):
    empty = B.value_bets(spark.createDataFrame([], PRED))
    assert empty.count() == 0
    assert {"margin_home", "best_edge", "kelly_stake", "outcome_won", "kelly_return"} <= set(empty.columns)
    bare = spark.createDataFrame([(1, 0.5, 0.3, 0.2, None, None, None, 1, 0)], PRED).drop("odds_home", "odds_draw", "odds_away")
    assert B.value_bets(bare).count() == 0


def test_fold_starts_advance_step_by_step():
    folds = D.fold_list(dt.date(2000, 8, 31), dt.date(2005, 12, 31))
    assert folds[0][2] == dt.date(2003, 8, 31)
    assert folds[1][2] == dt.date(2004, 2, 29) and folds[2][2] == dt.date(2004, 8, 29)
    assert all(f[3] <= dt.date(2005, 12, 31) for f in folds)
    assert D.fold_list(dt.date(2000, 1, 1), dt.date(2002, 1, 1)) == []


def test_training_never_sees_validation(spark):
    rows = random_matches(300, days=1900, seed=2)
    df = spark.createDataFrame(rows, MATCH_SCHEMA)
    folds = D.walk_forward_folds(df)
    val = D.validation_rows(df, folds).select("fold_idx", "match_id", "match_date", "train_end", "val_end").collect()
    assert val and all(r["train_end"] <= r["match_date"] < r["val_end"] for r in val)
    periods = {r["match_id"]: r["period"] for r in D.training_period(df, folds).collect()}
    ends = {r["fold_idx"]: r["train_end"] for r in folds.collect()}
    for r in rows:
        first = min((f for f, e in ends.items() if r[1] < e), default=None)
        assert periods.get(r[0]) == first


def test_summary_means_ignore_folds_without_bets(spark):
    df = spark.createDataFrame(
        [(1, 10, 0.2, 2.0, 2, 0.5, 0.4), (2, 30, 0.4, 3.0, 0, None, None)],
        "fold_idx int, n_matches int, rps double, nll double, n_value_bets int, flat_roi double, kelly_roi double",
    )
    total = D.backtest_summary(df).filter("fold_idx is null").first()
    assert (total["n_matches"], total["n_value_bets"]) == (40, 2)
    assert total["rps"] == pytest.approx(0.3) and total["flat_roi"] == 0.5


def test_bins_are_right_open_on_exact_edges(spark):
    probs = [0.0, 0.1, 0.3, 0.30000000000000004, 0.6, 0.7, 0.9999, 1.0]
    df = spark.createDataFrame([(p,) for p in probs], "p double")
    out = [r[0] for r in df.select(L.bin_index(F.col("p"))).collect()]
    assert out == [sum(p >= i / 10 for i in range(1, 10)) for p in probs]


def test_empty_and_small_bins_are_listed(spark):
    df = spark.createDataFrame([(0.05, True)] * 6 + [(0.95, False)], "p double, y boolean")
    out = {r["bin"]: r for r in L.reliability_bins(df, "p", "y").collect()}
    assert len(out) == 10 and out[0]["n"] == 6 and not out[0]["is_small"]
    assert out[9]["is_small"] and out[4]["n"] == 0 and out[4]["frac_pos"] is None
    assert out[4]["mean_pred"] == pytest.approx(0.45)
    ece = L.expected_calibration_error(df, "p", "y").first()[0]
    assert ece == pytest.approx((6 * 0.95 + 0.95) / 7)


def test_temperature_undoes_overconfidence(spark):
    rng, rows = random.Random(1), []
    for _ in range(3000):
        p = rng.uniform(0.2, 0.8)
        label = 0 if rng.random() < p else 1
        # Forecasts sharpened by the square: the right temperature is 2.
        a, b = p * p, (1 - p) ** 2
        rows.append((a / (a + b), b / (a + b), label))
    df = spark.createDataFrame(rows, "a double, b double, y int")
    assert L.fit_temperature(df, ["a", "b"], "y") == pytest.approx(2.0, abs=0.25)


def test_isotonic_is_monotone(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 2), rng.random()) for _ in range(500)]
    df = spark.createDataFrame([(p, u < p * p) for p, u in rows], "p double, y boolean")
    model = L.fit_isotonic(df, "p", "y")
    out = [r["prediction"] for r in model.transform(df.withColumn("prob", F.col("p"))).orderBy("prob").collect()]
    assert out == sorted(out)


def test_swapped_listing_is_turned_round(spark):
    odds = spark.createDataFrame(
        [("Brazil", "USA", 1.5, 4.0, 6.0, 1, [(-1.0, 1.9, 1.0, 2.0)]), ("Iran", "Spain", 5.0, 3.0, 1.7, 2, None)],
        f"home_team string, away_team string, odds_home double, odds_draw double, odds_away double, pos int, spreads {O.SPREADS}",
    )
    matches = spark.createDataFrame(
        [(1, "United States", "Brazil"), (2, "IR Iran", "Spain"), (3, "X", "Y")],
        "match_id int, home_team string, away_team string",
    )
    out = {r["match_id"]: r for r in O.odds_join_swapped(matches, odds).collect()}
    assert (out[1]["odds_home"], out[1]["odds_away"], out[1]["is_swapped"]) == (6.0, 1.5, True)
    assert tuple(out[1]["spreads"][0]) == (-1.0, 2.0, 1.0, 1.9)
    assert (out[2]["odds_home"], out[2]["is_swapped"]) == (5.0, False)
    assert out[3]["odds_home"] is None and not out[3]["is_swapped"]


def test_latest_per_key_of_a_hot_key(spark):
    rows = [("a", i, i * 2) for i in range(2000)] + [("b", 1, 5)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    out = {r["k"]: r["v"] for r in O.latest_per_key(df, ["k"], ["t"]).collect()}
    assert out == {"a": 3998, "b": 5}


@pytest.mark.parametrize(
    "score,conf,sentiment,trajectory",
    [(1.0, 0.2, 1.0, 1.0), (0.5, 0.5, 1.075, 1.075), (-1.0, 1.0, 0.70, 0.85), (1.0, 1.0, 1.30, 1.15),
     (None, None, 1.0, 1.0)],
)
def test_signal_factors(spark, score, conf, sentiment, trajectory):
    df = spark.createDataFrame([(score, conf)], "s double, c double")
    r = df.select(A.sentiment_factor(F.col("s"), F.col("c")), A.trajectory_factor(F.col("s"), F.col("c"))).first()
    assert tuple(r) == pytest.approx((sentiment, trajectory))


def test_injury_floor(spark):
    df = spark.createDataFrame([(0.015, 1.0), (2.0, 0.5), (2.0, None)], "r double, l double")
    out = [r[0] for r in df.select(A.injury_adjust(F.col("r"), F.col("l"))).collect()]
    assert out == pytest.approx([0.01, 1.5, 2.0])
