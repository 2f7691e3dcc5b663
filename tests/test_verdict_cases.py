"""Cases an earlier review found: null fingerprints, repeated places, session time zones."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import MATCH_SCHEMA, random_matches
from matchlab.functions import text as X
from matchlab.models import goal_rates as G
from matchlab.operators import articles as A
from matchlab.operators import matching as N
from matchlab.operators import ratings as R
from matchlab.operators.components import connected_components
from matchlab.sources.results import load_results


def test_dedupe_ends_on_nulls_and_repeated_places(spark):
    rows = [
        ("T", 1, "a", None), ("T", 2, "a", None), ("T", 3, "b", "x"), ("T", 3, "c", "x"), ("T", 4, "d", "y"),
        (None, 5, "e", "z"), ("T", None, "f", "z"), ("T", 6, None, "q"),
    ]
    df = spark.createDataFrame(rows, "team string, pos int, link string, fingerprint string")
    kept = sorted((r.pos, r.link) for r in A.dedupe_articles(df).collect())
    assert kept[0] == (1, "a") and kept[-1] == (4, "d") and len(kept) <= 4


def kept_by_hand(rows):
    seen, kept = set(), []
    for team, pos, link, printed in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        keys = {(team, "l", link), (team, "f", printed)}
        if not keys & seen:
            seen |= keys
            kept.append((team, pos, link, printed))
    return kept


def test_dedupe_of_long_chains_is_the_ordered_pass(spark):
    rng = random.Random(8)
    chain = [("T", i, f"l{(i + 1) // 2}", f"f{i // 2}") for i in range(2000)]
    mixed = [(rng.choice("AB"), i // 2, f"l{rng.randrange(150)}", f"f{rng.randrange(150)}") for i in range(400)]
    rows = [*chain, *mixed]
    df = spark.createDataFrame(rows, "team string, pos int, link string, fingerprint string")
    assert sorted(map(tuple, A.dedupe_articles(df).collect())) == sorted(kept_by_hand(rows))


def test_scan_finds_pools_itself(spark):
    rows = random_matches(150, pools=3, seed=12)
    df = spark.createDataFrame(rows, MATCH_SCHEMA)
    named = lambda pool: sorted(map(tuple, R.rating_scan(df, pool).select("match_id", "elo_home_pre", "elo_away_post").collect()))
    assert named(None) == named("pool")
    assert R.with_pools(df, "p").select("p").distinct().count() == 3


def test_names_below_the_cutoff_of_pieces(spark):
    squads = spark.createDataFrame([("A", "Kylian Mbappe", 1), ("A", "Li", 2)], "team string, player_name string, pos int")
    absent = spark.createDataFrame([("A", "K. Mbape", 1), ("A", "xyz", 2)], "team string, absent_name string, pos int")
    found = {r["pos"]: r["player_name"] for r in N.fuzzy_name_match(absent, squads, cutoff=0.5).collect()}
    assert found == {1: "Kylian Mbappe", 2: None}
    with pytest.raises(ValueError):
        N.fuzzy_name_match(absent, squads, cutoff=0.0)


def test_fingerprint_reads_whole_texts(spark):
    rows = [("T", None), (None, None), ("x" * 200, "a"), ("X" * 200, "A"), ("x" * 200, "b")]
    df = spark.createDataFrame(rows, "t string, d string")
    whole, start = (
        [r.f for r in df.select(A.fingerprint(F.col("t"), F.col("d"), n).alias("f")).collect()] for n in (None, 120)
    )
    assert None not in whole
    assert len(set(whole)) == 4 and whole[2] == whole[3] != whole[4]
    assert start[2] == start[3] == start[4]


def test_many_terms_take_several_passes(spark, monkeypatch):
    rows = [(1, "alpha beats gamma", "x"), (2, "none", "beta and Beta"), (3, "delta", "")]
    df = spark.createDataFrame(rows, "pos int, title string, description string")
    terms = {"A": ("alpha",), "B": ("beta", "bet"), "C": ("gamma",), "D": ("delta",)}
    found = lambda: sorted(map(tuple, A.team_article_match(df, terms).select("pos", "team", "in_title").collect()))
    whole = found()
    monkeypatch.setattr(A, "TERMS_A_PASS", 1)
    assert found() == whole == [(1, "A", True), (1, "C", True), (2, "B", False), (3, "D", True)]
    assert A.team_article_match(df, {}).count() == 0


def test_fit_says_when_it_has_not_converged(spark):
    rows = random_matches(60, teams=4, seed=5)
    df = spark.createDataFrame(rows, MATCH_SCHEMA)
    with pytest.raises(RuntimeError, match="not converged"):
        G.fit(G.sufficient_stats(df), max_sweeps=1, tolerance=1e-9)


def test_ids_of_results_do_not_depend_on_the_splits(spark, tmp_path):
    head = "date,home_team,away_team,home_score,away_score,tournament,city,country,neutral"
    lines = [f"2000-01-{1 + i % 9:02d},A{i % 3},B,{i % 2},1,Cup,X,Y,FALSE" for i in range(40)]
    ids = []
    for name, some in (("one", lines), ("other", lines[::-1])):
        path = tmp_path / f"{name}.csv"
        path.write_text("\n".join([head, *some]))
        ids.append(sorted(tuple(r) for r in load_results(spark, str(path)).select("match_id", "match_date", "home_team", "home_score").collect()))
    assert ids[0] == ids[1] and len({r[0] for r in ids[0]}) == 40


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_iso_to_utc_in_any_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        raw = ["2026-06-11T18:00:00+02:00", "2026-06-11T18:00:00Z", "2026-06-11T18:00:00", "2026-11-01T05:30:00Z", "2026-06-11", "soon", None]
        df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
        out = [r.u for r in df.select("i", X.iso_to_utc(F.col("r")).cast("string").alias("u")).orderBy("i").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert out == [
        "2026-06-11 16:00:00", "2026-06-11 18:00:00", "2026-06-11 18:00:00", "2026-11-01 05:30:00", "2026-06-11 00:00:00", None, None,
    ]


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 700)]
    hub = [(5000, x) for x in range(6000, 6300)] + [(1, 5000)]
    pairs = spark.createDataFrame([*chain, *hub, (9, 9), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(pairs, "a", "b").collect()}
    assert got == {**{i: 100 for i in range(100, 701)}, **{x: 1 for x in [1, 5000, *range(6000, 6300)]}, 9: 9}


def test_tens_of_thousands_of_terms_in_one_pass(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(2, 9)))
    terms = {f"T{i}": (word(), word() + " " + word(), word(), "aa") for i in range(12_500)}
    text = lambda: " ".join(word() for _ in range(rng.randint(0, 12)))
    rows = [(i, text() if i % 7 else None, text() + " aaaa" * (i % 3) if i % 5 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "pos int, title string, description string").withColumn("team", F.lit("clash"))
    wanted = set()
    for pos, title, body in rows:
        for team, words in terms.items():
            if any(w in (title or "") for w in words):
                wanted.add((pos, team, True))
            elif sum((body or "").strip().count(w) for w in words) >= 2:
                wanted.add((pos, team, False))
    out = A.team_article_match(df, terms)
    found = out.select("pos", "team", "in_title").collect()
    assert len(found) == len(wanted) and set(map(tuple, found)) == wanted
    plan = out._jdf.queryExecution().executedPlan().toString()
    # One step decodes character references, one searches.
    assert plan.count("ArrowEvalPython") == 2 and "Union" not in plan


def test_dedupe_of_a_chain_of_many_and_a_hot_link(spark):
    chain = [("T", i, f"l{(i + 1) // 2}", f"f{i // 2}") for i in range(100_000)]
    hot = [("H", i, "hot", f"h{i // 2}") for i in range(3000)]
    # Falling chains: every second article waits for two others.
    zigzag = [("Z", (i * 7919) % 5000, f"l{(i + 1) // 2}", f"f{i // 2}") for i in range(5000)]
    rows = [*chain, *hot, *zigzag]
    columns = list(zip(*rows))
    df = spark.createDataFrame(pa.table(dict(zip(["team", "pos", "link", "fingerprint"], map(list, columns)))))
    assert sorted(map(tuple, A.dedupe_articles(df).collect())) == sorted(kept_by_hand(rows))
