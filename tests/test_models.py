import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import MATCH_SCHEMA, day, random_matches
from matchlab import constants as C
from matchlab.catalog.models import net_weights
from matchlab.models import ensemble as E
from matchlab.models import goal_rates as G
from matchlab.models import score_net as N
from matchlab.models import trees as T
from matchlab.operators import folds as D


def poisson(rng, rate):
    limit, k, p = math.exp(-rate), 0, 1.0
    while True:
        p *= rng.random()
        if p <= limit:
            return k
        k += 1


def league(n=600, seed=42):
    """Poisson scores of six teams of known strength, 1.35 times the goals at home."""
    rng = random.Random(seed)
    attack = [0.0, 0.3, -0.2, 0.1, 0.4, -0.3]
    rows = []
    for i in range(n):
        h, a = rng.sample(range(6), 2)
        neutral = rng.random() < 0.25
        lh = 1.3 * math.exp(attack[h] - attack[a] / 2) * (1 if neutral else 1.35)
        la = 1.3 * math.exp(attack[a] - attack[h] / 2)
        rows.append((i, day(i // 3), f"T{h}", f"T{a}", poisson(rng, lh), poisson(rng, la), neutral, "Cup", "x"))
    return rows


def log_likelihood(rows, teams, gamma, rho, end):
    total = 0.0
    for _, date, home, away, hs, as_, neutral, *_ in rows:
        (ah, bh), (aa, ba) = teams[home], teams[away]
        lh, la = math.exp(ah + ba + (0 if neutral else gamma)), math.exp(aa + bh)
        tau = {(0, 0): 1 - lh * la * rho, (1, 0): 1 + la * rho, (0, 1): 1 + lh * rho, (1, 1): 1 - rho}
        w = math.exp(-C.DECAY_PER_DAY * (end - date).days)
        total += w * (math.log(max(tau.get((hs, as_), 1.0), 1e-10)) + hs * math.log(lh) - lh + as_ * math.log(la) - la)
    return total


@pytest.fixture(scope="module")
def fitted(spark):
    rows = league()
    stats = G.sufficient_stats(spark.createDataFrame(rows, MATCH_SCHEMA))
    teams, scalars = G.fit(stats, tolerance=1e-6)
    return rows, stats, teams, scalars


def test_fit_is_a_maximum(fitted):
    rows, _, teams, scalars = fitted
    params = {r["team"]: (r["log_alpha"], r["log_beta"]) for r in teams.collect()}
    gamma, rho = scalars.select("log_gamma", "rho").first()
    end = max(r[1] for r in rows)
    best = log_likelihood(rows, params, gamma, rho, end)
    assert params["T0"][0] == 0.0
    for step in (0.01, -0.01):
        assert log_likelihood(rows, params, gamma + step, rho, end) < best
        assert log_likelihood(rows, params, gamma, rho + step, end) < best
        for team, (a, b) in params.items():
            for moved in ((a + step, b), (a, b + step)):
                assert log_likelihood(rows, {**params, team: moved}, gamma, rho, end) < best


def test_fit_finds_home_advantage_and_strength(fitted):
    _, _, teams, scalars = fitted
    gamma = scalars.select("log_gamma").first()[0]
    assert 0.0 < gamma < 0.8
    attack = {r["team"]: r["log_alpha"] for r in teams.collect()}
    assert attack["T4"] > attack["T5"]


def test_statistics_hold_the_whole_likelihood(spark, fitted):
    rows, stats, teams, scalars = fitted
    params = {r["team"]: (r["log_alpha"], r["log_beta"]) for r in teams.collect()}
    gamma, rho = scalars.select("log_gamma", "rho").first()
    named = teams.withColumnsRenamed({"log_alpha": "attack", "log_beta": "defence"})
    rated = G._with_rates(stats, named, scalars, [])
    total = rated.agg(F.sum(G.log_likelihood(rated))).first()[0]
    assert total == pytest.approx(log_likelihood(rows, params, gamma, rho, max(r[1] for r in rows)), rel=1e-9)


def test_folds_fit_like_single_models(spark):
    rows = random_matches(500, teams=5, days=1600, seed=9)
    df = spark.createDataFrame(rows, MATCH_SCHEMA)
    folds = D.walk_forward_folds(df)
    teams, scalars = G.fit(G.fold_stats(df, folds), by=("fold_idx",), tolerance=1e-6)
    fold = folds.orderBy(F.desc("fold_idx")).first()
    alone, single = G.fit(
        G.sufficient_stats(df.filter(F.col("match_date") < F.lit(fold["train_end"]))), tolerance=1e-6
    )
    got = {r["team"]: r["log_alpha"] for r in teams.filter(F.col("fold_idx") == fold["fold_idx"]).collect()}
    for r in alone.collect():
        assert got[r["team"]] == pytest.approx(r["log_alpha"], abs=1e-3)
    here = scalars.filter(F.col("fold_idx") == fold["fold_idx"]).first()
    assert here["log_gamma"] == pytest.approx(single.first()["log_gamma"], abs=1e-3)


def test_neutral_ground_drops_the_home_factor_and_unknown_teams_are_named(spark, fitted):
    _, _, teams, scalars = fitted
    df = spark.createDataFrame(
        [(1, "T1", "T2", True), (2, "T1", "T2", False), (3, "T1", "nobody", True)],
        "match_id int, home_team string, away_team string, neutral boolean",
    )
    out = {r["match_id"]: r for r in G.predict(df, teams, scalars).collect()}
    assert set(out) == {1, 2, 3} and out[2]["lambda_home"] > out[1]["lambda_home"]
    assert out[1]["unseen"] == [] and out[3]["unseen"] == ["nobody"] and out[3]["lambda_home"] is out[3]["prob_home"] is None
    assert out[1]["prob_home"] + out[1]["prob_draw"] + out[1]["prob_away"] == pytest.approx(1.0)
    assert {r["team"] for r in D.unseen_teams(df, teams).collect()} == {"nobody"}


def test_ensemble_weights(spark):
    df = spark.createDataFrame([("a", 0.2), ("b", 0.4)], "model string, rps double")
    assert {r["model"]: r["weight"] for r in E.inverse_rps_weights(df).collect()} == pytest.approx({"a": 2 / 3, "b": 1 / 3})
    with pytest.raises(Exception, match="positive"):
        E.inverse_rps_weights(spark.createDataFrame([("a", 0.0)], "model string, rps double")).collect()
    for weights, models in (([0.5], 2), ([0.5, 0.6], 2), ([], 0)):
        with pytest.raises(ValueError):
            E.check_weights(weights, models)


def test_ensemble_of_one_is_itself(spark):
    grid = [i / 2016 for i in range(64)]
    df = spark.createDataFrame([(1, grid)], "match_id int, grid array<double>")
    out = E.ensemble_grid([df, df], [0.25, 0.75]).first()
    assert out["grid"] == pytest.approx(grid) and out["lambda_home"] == pytest.approx(out["expected_home"])


def contextual(spark, n=200):
    rows = random_matches(n, teams=8, days=900, seed=11)
    df = spark.createDataFrame(rows, MATCH_SCHEMA)
    return df.withColumns(
        {
            "elo_home_pre": 1400.0 + F.col("match_id") % 200, "elo_away_pre": F.lit(1500.0),
            "elo_diff": F.col("match_id") % 200 - 100.0,
            "rest_days_home": F.when(F.col("match_id") % 5 != 0, (F.col("match_id") % 700).cast("double")),
            "rest_days_away": F.lit(7.0), "is_knockout": F.lit(False), "is_host_home": F.lit(False),
            "is_host_away": F.lit(True), "sample_weight": F.lit(1.0),
        }
    )


def test_tree_features_and_rates(spark):
    df = contextual(spark)
    x = T.feature_matrix(df)
    assert [c for c in x.columns if c in T.FEATURES] == T.FEATURES and len(T.FEATURES) == 19
    rest = x.agg(F.max("rest_days_home"), F.count_if(F.col("rest_days_home") == 365.0)).first()
    assert rest[0] == 365.0 and rest[1] >= 40
    model = T.fit(df, trees=3)
    new = df.withColumn("home_team", F.when(F.col("match_id") % 2 == 0, "stranger").otherwise(F.col("home_team")))
    out = model.predict(new).collect()
    assert len(out) == 200 and all(r["lambda_home"] >= 0.01 and r["rho"] == 0.0 for r in out)


def test_network_scores_like_plain_numpy(spark):
    df = contextual(spark, 60)
    vocab = N.team_vocab(df)
    names = sorted({r["team"] for r in vocab.collect()})
    assert {r["team"]: r["idx"] for r in vocab.collect()} == {t: i + 1 for i, t in enumerate(names)}
    rng, w = np.random.default_rng(1), net_weights()
    vectors = {i: rng.normal(size=C.EMBED_DIM).astype("float32") for i in range(1, len(names) + 1)}
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "idx bigint, vector array<float>")
    known = N.with_vectors(vocab.filter(F.col("team") != names[0]), emb)
    tensors = N.sequence_tensors(df, known)
    out = {r["match_id"]: r for r in N.net_batch_score(tensors, w).collect()}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def encode(seq):
        h = np.zeros(C.GRU_HIDDEN)
        for x in np.array(seq):
            i, g = w["gru_in"] @ x + w["gru_in_bias"], w["gru_hid"] @ h + w["gru_hid_bias"]
            r, z = sig(i[:32] + g[:32]), sig(i[32:64] + g[32:64])
            n = np.tanh(i[64:] + r * g[64:])
            h = (1 - z) * n + z * h
        return h

    for row in tensors.collect():
        ctx = w["ctx2"] @ np.maximum(w["ctx1"] @ np.array(row["context"]) + w["ctx1_bias"], 0) + w["ctx2_bias"]
        zero = np.zeros(C.EMBED_DIM)
        fused = np.concatenate(
            [vectors.get(row["home_idx"], zero), vectors.get(row["away_idx"], zero),
             encode(row["home_seq"]), encode(row["away_seq"]), ctx]
        )
        o = w["fuse2"] @ np.maximum(w["fuse1"] @ fused + w["fuse1_bias"], 0) + w["fuse2_bias"]
        got = out[row["match_id"]]
        assert got["lambda_home"] == pytest.approx(math.log1p(math.exp(o[0])), abs=1e-6)
        assert got["rho"] == pytest.approx(0.2 * math.tanh(o[2]), abs=1e-6)
