import pytest
from pyspark.sql import functions as F

from helpers import MATCH_SCHEMA, day, history_by_hand, random_matches
from matchlab.operators import timeline as T


def frame(spark, rows):
    df = spark.createDataFrame(rows, MATCH_SCHEMA)
    return df.withColumns({"elo_home_pre": F.lit(1600.0), "elo_away_pre": F.lit(1400.0)})


# 40 dates for 300 matches: several matches per team and date, one team in a third of all.
CROWDED = random_matches(300, teams=5, days=40, hot=1, seed=8)


@pytest.mark.parametrize("n", [1, 5, 10])
def test_form_uses_only_earlier_dates(spark, n):
    for r in T.match_form(frame(spark, CROWDED), n).collect():
        for side in ("home", "away"):
            past = history_by_hand(CROWDED, r[f"{side}_team"], r["match_date"], n)
            assert r[f"form_n_played_{side}"] == len(past)
            gf = sum(p[0] for p in past) / len(past) if past else 0.0
            pts = sum(3 if a > b else a == b for a, b in past) / len(past) if past else 0.0
            assert r[f"form_gf_{side}"] == pytest.approx(gf)
            assert r[f"form_pts_{side}"] == pytest.approx(pts)


def test_sequences_are_padded_in_front_and_oldest_first(spark):
    for r in T.match_sequences(frame(spark, CROWDED)).collect():
        past = history_by_hand(CROWDED, r["home_team"], r["match_date"], 10)
        seq = r["home_seq"]
        assert len(seq) == 10 and all(len(s) == 5 for s in seq)
        assert all(s == [0.0] * 5 for s in seq[: 10 - len(past)])
        assert [(s[0], s[1]) for s in seq[10 - len(past):]] == past


def test_one_pass_gives_the_same_as_separate_passes(spark):
    df = frame(spark, CROWDED)
    both = T.with_team_days(df, form=5, sequence=10).select("match_id", "form_gf_home", "away_seq", "rest_days_home")
    apart = (
        T.match_form(df).select("match_id", "form_gf_home")
        .join(T.match_sequences(df).select("match_id", "away_seq"), "match_id")
        .join(T.rest_days(df).select("match_id", "rest_days_home"), "match_id")
    )
    assert sorted(map(tuple, both.collect()), key=repr) == sorted(map(tuple, apart.collect()), key=repr)


def test_rest_days(spark):
    rows = [
        (1, day(0), "A", "B", 1, 0, True, "Cup", "x"), (2, day(3), "C", "A", 1, 0, True, "Cup", "x"),
        (3, day(3), "A", "B", 1, 0, True, "Cup", "x"),
    ]
    got = {r["match_id"]: (r["rest_days_home"], r["rest_days_away"]) for r in T.rest_days(frame(spark, rows)).collect()}
    assert got == {1: (None, None), 2: (None, 3.0), 3: (0.0, 3.0)}


def test_rest_days_of_a_hot_team(spark):
    last, expected = {}, {}
    for r in CROWDED:
        expected[r[0]] = tuple(
            float((r[1] - last[t]).days) if t in last else None for t in (r[2], r[3])
        )
        last[r[2]] = last[r[3]] = r[1]
    got = T.rest_days(frame(spark, CROWDED)).collect()
    assert {r["match_id"]: (r["rest_days_home"], r["rest_days_away"]) for r in got} == expected


def test_asof_probes_need_not_be_playing_dates(spark):
    probes = [(t, day(d)) for t in ("P0T0", "P0T1", "nobody") for d in (-1, 0, 7, 20, 39, 90)]
    df = spark.createDataFrame(probes + probes[:3], "team string, as_of date")
    out = T.history_asof(frame(spark, CROWDED), df, 5).collect()
    assert len(out) == len(probes) + 3
    for r in out:
        expected = history_by_hand(CROWDED, r["team"], r["as_of"], 5)
        assert [(h["gf"], h["ga"]) for h in r["history"] or []] == expected


def test_perspective_and_points(spark):
    rows = [(1, day(0), "A", "B", 2, 1, True, "Cup", "x"), (2, day(1), "B", "A", 1, 1, True, "Cup", "x")]
    long = {(r["match_id"], r["team"]): r for r in T.team_long_form(frame(spark, rows)).collect()}
    assert (long[1, "A"]["gf"], long[1, "A"]["pts"], long[1, "A"]["opp_rating"]) == (2, 3, 1400.0)
    assert (long[1, "B"]["gf"], long[1, "B"]["pts"], long[1, "B"]["opp_rating"]) == (1, 0, 1600.0)
    assert long[2, "A"]["pts"] == 1 and long[2, "A"]["is_home"] is False


def test_numbering_counts_every_match(spark):
    out = T.numbered_team_matches(frame(spark, CROWDED)).filter("team = 'P0T1'").orderBy("seq").collect()
    assert [r["seq"] for r in out] == list(range(1, len(out) + 1))
    assert {r["n_matches"] for r in out} == {len(out)}
    assert [(r["match_date"], r["match_id"]) for r in out] == sorted((r["match_date"], r["match_id"]) for r in out)


def test_only_a_bounded_part_of_a_team_day_is_kept(spark):
    plan = T.match_form(frame(spark, CROWDED))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_block_headers(spark):
    rows = [(1, day(0), "A", "B", 2, 1, True, "Cup", "x"), (2, day(1), "B", "A", 1, 1, True, "Cup", "x")]
    df = frame(spark, rows).withColumn("stage", F.when(F.col("match_id") == 1, "Final"))
    headers = {(r["team"], r["seq"]): r["header"] for r in T.chronological_blocks(df).collect()}
    assert headers["A", 1] == "=== Match 1 of 2 — vs B (2000-01-01), Final, A won 2-1 ==="
    assert headers["A", 2] == "=== Match 2 of 2 — vs B (2000-01-02), round unknown, A drew 1-1 ==="
