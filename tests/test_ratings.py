import pytest
from pyspark.sql import functions as F

from helpers import MATCH_SCHEMA, day, random_matches, ratings_by_hand
from matchlab.functions.metrics import competition_k, inactivity_decay
from matchlab.operators import ratings as R


def frame(spark, rows):
    return spark.createDataFrame(rows, MATCH_SCHEMA)


def scan(spark, rows, **options):
    done = R.rating_scan(frame(spark, rows), **options).collect()
    return {r["match_id"]: (r["elo_home_pre"], r["elo_away_pre"]) for r in done}


def close(got, expected):
    assert got.keys() == expected.keys()
    for key, value in expected.items():
        assert got[key] == pytest.approx(value, abs=1e-9)


def test_first_match_starts_level(spark):
    rows = [(1, day(0), "A", "B", 2, 1, True, "FIFA World Cup", "x")]
    assert scan(spark, rows) == {1: (1500.0, 1500.0)}


def test_draw_of_equals_on_neutral_ground_changes_nothing(spark):
    rows = [(1, day(0), "A", "B", 1, 1, True, "Friendly", "x")]
    ends = R.current_ratings(R.rating_scan(frame(spark, rows))).collect()
    assert {r["rating"] for r in ends} == {1500.0}


def test_updates_are_zero_sum_and_home_win_gains_less(spark):
    rows = [(1, day(0), "A", "B", 1, 0, False, "Friendly", "x"), (2, day(0), "C", "D", 1, 0, True, "Friendly", "x")]
    ends = {r["team"]: r["rating"] for r in R.current_ratings(R.rating_scan(frame(spark, rows))).collect()}
    assert ends["A"] + ends["B"] == pytest.approx(3000)
    assert 1500 < ends["A"] < ends["C"]


@pytest.mark.parametrize("pools", [1, 3])
def test_scan_equals_the_loop(spark, pools):
    # 1600 days for 120 matches: gaps of more than a year do occur.
    rows = random_matches(120, days=1600, pools=pools, seed=3)
    expected, ends = ratings_by_hand(rows)
    close(scan(spark, rows), expected)
    got = R.current_ratings(R.rating_scan(frame(spark, rows))).collect()
    close({(r["pool"], r["team"]): (r["rating"],) for r in got}, {k: (v,) for k, v in ends.items()})


def test_slices_change_nothing(spark):
    # A hot team holds a third of the rows; slices cut its pool into many tasks.
    rows = random_matches(200, days=1600, pools=2, hot=0, seed=4)
    close(scan(spark, rows, rows_per_task=15), ratings_by_hand(rows)[0])


def test_slices_stay_near_the_asked_size(spark):
    rows = frame(spark, random_matches(200, days=500))
    ends = R._slice_ends(R._scan_input(rows, "pool"), 20)
    assert len(ends) >= 10 and ends == sorted(ends)


def test_small_batches_keep_the_state(spark):
    rows = random_matches(150, pools=2, seed=5)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        close(scan(spark, rows), ratings_by_hand(rows)[0])
    finally:
        spark.conf.set(key, before)


def test_extension_places_old_matches_in_time(spark):
    rows = random_matches(150, seed=6)
    base, new = rows[:100] + rows[120:], rows[100:120]
    got = R.extend_ratings(frame(spark, base), frame(spark, new)).collect()
    # On a shared date the base rows come first.
    order = [(i, r) for i, r in enumerate(sorted(base, key=lambda r: (r[1], r[0])))]
    both = sorted([(r[1], 0, r[0], r) for _, r in order] + [(r[1], 1, r[0], r) for r in new])
    renumbered = [(i, *row[3][1:]) for i, row in enumerate(both)]
    expected, _ = ratings_by_hand(renumbered)
    by_id = {row[2]: expected[i] for i, row in enumerate(both)}
    assert len(got) == 20
    for r in got:
        assert (r["elo_home_pre"], r["elo_away_pre"]) == pytest.approx(by_id[r["match_id"]])
        assert r["elo_diff"] == pytest.approx(r["elo_home_pre"] - r["elo_away_pre"])


@pytest.mark.parametrize(
    "name,k",
    [("FIFA World Cup", 60), ("FIFA World Cup qualification", 40), ("UEFA Euro 2024", 50),
     ("CONCACAF Gold Cup", 40), ("Friendly", 20), ("Baltic Cup", 35)],
)
def test_longest_prefix_sets_k(spark, name, k):
    assert spark.range(1).select(competition_k(F.lit(name))).first()[0] == k


def test_decay_overshoots_after_very_long_gaps(spark):
    df = spark.createDataFrame([(1700.0, 365), (1700.0, 730), (1700.0, 7300)], "r double, g int")
    out = [x[0] for x in df.select(inactivity_decay(F.col("r"), F.col("g"))).collect()]
    assert out == pytest.approx([1700.0, 1660.0, 1300.0])


def test_rating_probabilities_sum_to_one(spark):
    df = spark.createDataFrame(
        [(1, 1500.0, 1500.0, True), (2, 1900.0, 1400.0, False)],
        "match_id int, elo_home_pre double, elo_away_pre double, neutral boolean",
    )
    a, b = R.with_rating_probs(df).orderBy("match_id").collect()
    assert a["prob_draw"] == pytest.approx(0.26) and a["prob_home"] == pytest.approx(0.37)
    assert b["prob_home"] + b["prob_draw"] + b["prob_away"] == pytest.approx(1.0)
