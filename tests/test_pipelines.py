import pytest
from pyspark.sql import functions as F

from helpers import MATCH_SCHEMA, day, random_matches
from matchlab import constants as C
from matchlab.catalog.models import net_weights
from matchlab.plans import pipelines as P


@pytest.fixture(scope="module")
def matches(spark):
    # 1500 days: three years of training and one fold.
    return spark.createDataFrame(random_matches(400, teams=6, days=1500, seed=31), MATCH_SCHEMA)


@pytest.mark.parametrize("model", ["rates", "ratings", "ensemble"])
def test_backtest(spark, matches, model):
    prices = matches.select(
        "match_id", F.lit(2.4).alias("odds_home"), F.lit(3.2).alias("odds_draw"), F.lit(3.0).alias("odds_away")
    )
    out = P.backtest(matches, prices, model=model, tree_options={"trees": 2}).collect()
    folds = [r for r in out if r["fold_idx"] is not None]
    (total,) = [r for r in out if r["fold_idx"] is None]
    assert folds and total["n_matches"] == sum(r["n_matches"] for r in folds)
    assert 0 < total["rps"] < 1
    assert (total["nll"] is None) == (model == "ratings")
    for r in folds:
        assert (r["flat_roi"] is None) == (r["n_value_bets"] == 0)


def test_backtest_filters_and_unknown_model(spark, matches):
    some = P.backtest(matches, model="ratings", tournament="Cup", summary=False).agg(F.sum("n_matches")).first()[0]
    assert 0 < some < 400
    with pytest.raises(ValueError):
        P.backtest(matches, model="oracle")


def test_prediction_run(spark, matches):
    schedule = spark.createDataFrame(
        [(1, day(1600), "P0T0", "P0T1", False), (2, day(1601), "P0T2", "P0T3", True), (3, day(1602), "P0T4", "new", False)],
        "match_id bigint, match_date date, home_team string, away_team string, is_completed boolean",
    ).withColumn("kickoff", F.col("match_date").cast("timestamp_ntz"))
    losses = spark.createDataFrame([("P0T0", 0.4)], "team string, loss double")
    plain = P.predict_upcoming(matches, schedule).collect()
    hurt = P.predict_upcoming(matches, schedule, losses=losses).collect()
    assert sorted((r["match_id"], *r["unseen"]) for r in plain) == [(1,), (3, "new")]
    plain, hurt = ([r for r in rows if r["match_id"] == 1] for rows in (plain, hurt))
    assert hurt[0]["lambda_home"] == pytest.approx(0.8 * plain[0]["lambda_home"])
    assert hurt[0]["prob_home"] < plain[0]["prob_home"]
    assert hurt[0]["markets"]["home_win"] == pytest.approx(hurt[0]["prob_home"])


@pytest.mark.parametrize("model", ["trees", "network", "ensemble"])
def test_prediction_run_of_every_model(spark, matches, model):
    teams = [f"P0T{i}" for i in range(6)]
    done = spark.createDataFrame(
        [(900 + i, day(9660 + i), teams[i], teams[i + 1], 2, i) for i in range(3)],
        "match_id bigint, match_date date, home_team string, away_team string, home_score int, away_score int",
    ).withColumn("pool", F.lit(matches.first()["pool"]))
    schedule = spark.createDataFrame(
        [(1, day(9670), "P0T0", "P0T1", False), (3, day(9671), "P0T4", "new", False)],
        "match_id bigint, match_date date, home_team string, away_team string, is_completed boolean",
    ).withColumn("kickoff", F.col("match_date").cast("timestamp_ntz"))
    vocab = spark.createDataFrame(
        [(t, i + 1, [0.1 * i] * C.EMBED_DIM) for i, t in enumerate(teams)], "team string, idx bigint, vector array<float>"
    )
    options = {"completed": done, "network": (vocab, net_weights()), "tree_options": {"trees": 2}}
    out = {r["match_id"]: r for r in P.predict_upcoming(matches, schedule, model=model, **options).collect()}
    assert out[1]["prob_home"] + out[1]["prob_draw"] + out[1]["prob_away"] == pytest.approx(1.0)
    assert out[1]["markets"]["home_win"] == pytest.approx(out[1]["prob_home"])
    if model == "ensemble":
        assert out[1]["rho"] == 0.0 and set(out) == {1, 3} and out[3]["unseen"] == ["new"] and out[3]["prob_home"] is None
    else:
        assert out[3]["prob_home"] > 0


def test_injected_matches_move_the_weights(spark, matches):
    done = spark.createDataFrame(
        [(900, day(1700), "P0T0", "P0T1", 2, 0)],
        "match_id bigint, match_date date, home_team string, away_team string, home_score int, away_score int",
    ).withColumn("pool", F.lit(matches.first()["pool"]))
    before = {r["match_id"]: r["sample_weight"] for r in P.played(matches).collect()}
    after = {r["match_id"]: r for r in P.played(matches, done).collect()}
    assert set(after) == {*before, 900} and after[900]["neutral"] and after[900]["elo_home_pre"] != 1500.0
    assert all(after[i]["sample_weight"] < w for i, w in before.items())


def test_unknown_models_are_refused(spark, matches):
    for call in (
        lambda: P.predict_upcoming(matches, matches, model="oracle"), lambda: P.predict_upcoming(matches, matches, model="network"),
        lambda: P.export_run(matches, "x", model="oracle"),
    ):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("model", ["rates", "ensemble"])
def test_export_run(spark, matches, tmp_path, model):
    since = str(matches.agg(F.percentile_approx(F.unix_date("match_date"), 0.9)).first()[0])
    since = spark.sql(f"select cast(date_from_unix_date({since}) as string)").first()[0]
    out = P.export_run(matches, str(tmp_path / "out"), since=since, model=model, tree_options={"trees": 2})
    written = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert written.count() == out.count() == matches.filter(F.col("match_date") >= since).count()
    assert {"prob_home", "prob_draw", "prob_away", "over_2_5"} <= set(written.columns)


def test_training_set_has_every_context_column(spark, matches):
    out = P.training_set(matches)
    assert out.count() == 400
    assert {"elo_diff", "rest_days_home", "is_knockout", "sample_weight", "squad_caps_away"} <= set(out.columns)
