"""Cases of the third round of findings."""

import difflib
import html
import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from matchlab.functions import grid as G
from matchlab.functions import text as X
from matchlab.models import ensemble as E
from matchlab.models import trees as T
from matchlab.operators import matching as N


def test_name_match_compares_few_pairs_of_a_team_and_finds_the_most_similar(spark, monkeypatch):
    # 400 names that all share their beginning: each met every other one before.
    compared, plain = spark.sparkContext.accumulator(0), N.similarity.func

    def counting(candidate: pd.Series, name: pd.Series) -> pd.Series:
        compared.add(len(candidate))
        return plain(candidate, name)

    counted = F.pandas_udf(counting, "double").asNondeterministic()
    monkeypatch.setattr(N, "similarity", counted)
    names = [f"customer#{i:09d}" for i in range(0, 6400, 16)]
    squads = spark.createDataFrame([("A", n, i) for i, n in enumerate(names)], "team string, player_name string, pos long")
    absent = spark.createDataFrame(
        [("A", n[:5] + "x" + n[6:], i) for i, n in enumerate(names)], "team string, absent_name string, pos long"
    )
    rows = N.fuzzy_name_match(absent, squads).collect()
    assert {r["pos"]: (r["player_name"], r["how"]) for r in rows} == {i: (n, "similar") for i, n in enumerate(names)}
    assert compared.value <= 4 * len(names)


def test_name_match_tiers_agree_with_all_pairs(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abc ") for _ in range(rng.randrange(1, 12))) for _ in range(150)})

    def slip(name):
        out = list(name)
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(out) + 1)
            out[at : at + rng.randrange(2)] = rng.choice(["", "a", "z", "é"])
        return "".join(out)

    asked = sorted({slip(n) for n in names} | {"a" * 60 + "b"})
    names += ["a" * 60 + "c", "a" * 58]
    squads = spark.createDataFrame([("A", n, i) for i, n in enumerate(names)], "team string, player_name string, pos long")
    absent = spark.createDataFrame([("A", n, i) for i, n in enumerate(asked)], "team string, absent_name string, pos long")
    got = {r["pos"]: (r["player_name"], r["how"]) for r in N.fuzzy_name_match(absent, squads).collect()}
    key = lambda s: s.strip(" ").lower()
    first = {}
    for n in names:
        first.setdefault(key(n), n)
    for i, name in enumerate(asked):
        own = key(name)
        if own in first:
            assert got[i] == (first[own], "exact")
            continue
        ratios = [(difflib.SequenceMatcher(None, c, own).ratio(), c) for c in first if c and own]
        ratio, best = max(ratios, default=(0.0, None))
        if ratio >= 0.8:
            assert got[i] == (first[best], "similar")
        else:
            assert got[i][1] in (None, "part")


def test_tree_tasks_follow_rows_not_the_shuffle(spark):
    assert T.tasks_for(0, 8) == T.tasks_for(800_000, 8) == 8
    assert T.tasks_for(5_000_001, 8) == 51
    tasks = []
    real = T.GBTRegressor.fit
    class Stop(Exception):
        pass
    def look(self, rows):
        tasks.append(rows.rdd.getNumPartitions())
        raise Stop
    T.GBTRegressor.fit = look
    try:
        rows = spark.range(400).repartition(64).select(
            *[F.rand(1).alias(c) for c in T.FEATURES], *[F.lit(1).alias(c) for c in ("home_score", "away_score")]
        ).withColumns({f"{n}_{s}": F.lit(1.0) for n in T.FORM for s in ("home", "away")})
        try:
            T.fit(rows, trees=1)
        except Stop:
            pass
    finally:
        T.GBTRegressor.fit = real
    assert tasks and max(tasks) <= spark.sparkContext.defaultParallelism


def test_ensemble_of_rates_equals_the_one_of_grids_and_joins_no_grid(spark):
    rates = spark.createDataFrame(
        [(i, 0.4 + i / 10, 1.9 - i / 20, (i - 5) / 50) for i in range(12)] + [(3, 1.0, 1.0, 0.0), (None, 1.0, 1.0, 0.0), (20, None, 1.0, 0.0)],
        "match_id long, lambda_home double, lambda_away double, rho double",
    )
    other = T.unfitted_rates(rates.select("match_id"))
    out = E.ensemble_grid([rates, other], [0.7, 0.3])
    whole = E.ensemble_grid([G.with_score_grid(rates), G.with_score_grid(other)], [0.7, 0.3])
    order = lambda df: sorted(map(str, df.collect()))
    assert out.columns == whole.columns and order(out) == order(whole)
    mixed = E.ensemble_grid([rates, G.with_score_grid(other)], [0.7, 0.3])
    assert order(mixed) == order(whole)
    below = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    assert "array(" not in below


def test_entities_are_decoded_like_html_unescape_without_the_text(spark, monkeypatch):
    rng = random.Random(5)
    bits = ["&amp;", "&amp", "&notit;", "&not", "&#65;", "&#x41", "&#0;", "&#150;", "&#xD800;", "&#9999999999;", "&zzzz;", "& ", "&", "&&amp;",
            "&#", "&#;", "&#x;", "a", "é", "\U0001f600", "&\U0001f600;", "&CounterClockwiseContourIntegral;", "&" + "q" * 40 + ";", "\n", "<", "&lt", "&nbsp;", "&acE;"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 9))) for _ in range(400)] + bits + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    got = dict(df.select("i", X._unescape(F.col("t"))).collect())
    assert got == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}
    # The texts themselves stay out of Python.
    crossed, decode = spark.sparkContext.accumulator(0), X._decoded.func

    def counting(references: pa.Array) -> pa.Array:
        crossed.add(references.flatten().nbytes)
        return decode(references)

    monkeypatch.setattr(X, "_decoded", F.arrow_udf(counting, "array<string>"))
    long = spark.createDataFrame([("x" * 100_000 + "&amp;",)] * 20, "t string")
    assert long.select(F.length(X.clean_html(F.col("t"))).alias("n")).agg(F.sum("n")).first()[0] == 20 * 100_001
    assert 0 < crossed.value < 10_000
