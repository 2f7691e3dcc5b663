import pytest
from pyspark.sql import functions as F

from helpers import day
from matchlab.functions import text as X
from matchlab.operators import context as K
from matchlab.operators import scores as S
from matchlab.operators import squads as Q

RESULT = "match_id bigint, match_date date, home_team string, away_team string, home_score int, away_score int"
GOAL = "match_date date, home_team string, away_team string, team string, goal_minute int"


def corrected(spark, goals, rows=None):
    rows = rows or [(1, day(0), "Croatia", "England", 2, 1)]
    df = S.extra_time_correction(spark.createDataFrame(rows, RESULT), spark.createDataFrame(goals, GOAL))
    return {r["match_id"]: r for r in df.collect()}


def goal(team, minute, date=0):
    return (day(date), "Croatia", "England", team, minute)


def test_extra_time_goal_is_taken_off(spark):
    r = corrected(spark, [goal("England", 5), goal("Croatia", 68), goal("Croatia", 109)])[1]
    assert (r["home_score"], r["away_score"], r["corrected"], r["non_draw"]) == (1, 1, True, False)


def test_no_late_goal_or_no_coverage_changes_nothing(spark):
    assert corrected(spark, [goal("Croatia", 12)])[1]["home_score"] == 2
    assert corrected(spark, [goal("Croatia", 109, date=9)])[1]["corrected"] is False


def test_goals_without_minute_count_neither_way(spark):
    r = corrected(spark, [goal("England", None), goal("Croatia", 109)])[1]
    assert (r["home_score"], r["away_score"]) == (0, 0)
    assert corrected(spark, [goal("England", None)])[1]["corrected"] is False


def test_every_duplicate_row_is_corrected_and_non_draw_flagged(spark):
    rows = [(i, day(0), "Croatia", "England", 3, 1) for i in (1, 2)]
    out = corrected(spark, [goal("Croatia", 10), goal("Croatia", 93)], rows)
    assert {(r["home_score"], r["away_score"], r["non_draw"]) for r in out.values()} == {(1, 0, True)}


@pytest.mark.parametrize(
    "stage,offset,expected",
    [("Group J - Matchday 17", 40, False), ("Round of 32", 0, True), ("Group", 40, True),
     ("group", 0, False), (None, 40, True), ("", 0, False)],
)
def test_knockout_stage(spark, stage, offset, expected):
    df = spark.createDataFrame([(stage, offset)], "stage string, o int").withColumn(
        "d", F.date_add(F.lit("2026-06-11").cast("date"), F.col("o"))
    )
    assert df.select(X.knockout_stage(F.col("d"), F.col("stage"))).first()[0] is expected


def test_sample_weight_closed_forms(spark):
    rows = [(day(1095), "Cup"), (day(0), "Cup"), (day(1095), "Friendly")]
    df = spark.createDataFrame(rows, "match_date date, tournament string")
    assert [r["sample_weight"] for r in K.sample_weight(df).collect()] == pytest.approx([1.0, 0.5, 0.2])


def test_boost_only_lifts_the_current_tournament(spark):
    df = spark.sql(
        "select date '2026-06-20' match_date, 'FIFA World Cup' tournament union all "
        "select date '2026-06-20', 'Cup'"
    )
    assert sorted(r["sample_weight"] for r in K.sample_weight(df, boost=4).collect()) == [1.0, 4.0]


def test_qualifier_of_the_year_uses_the_finals_squad(spark):
    df = spark.createDataFrame([("FIFA World Cup qualification", 2026), ("UEFA Euro", 2020)], "t string, y int")
    out = [r[0] for r in df.select(Q.tournament_key(F.col("t"), F.col("y"))).collect()]
    assert out == ["wc2026", None]


def test_squad_quality_uses_names_without_notes(spark):
    squads = spark.createDataFrame(
        [("wc2026", "A", "Harry Kane (captain)", "Bayern Munich", 80), ("wc2026", "A", "Nobody", "FC X", 20),
         ("wc2026", "B", "Young", "Arsenal", 0)],
        "tournament_key string, team string, player_name string, club string, caps int",
    )
    goals = spark.createDataFrame(
        [("Harry Kane", False)] * 5 + [("harry kane ", False), ("Harry Kane", True)], "scorer string, own_goal boolean"
    )
    out = {r["team"]: r for r in Q.squad_quality(squads, Q.career_goals(goals)).collect()}
    assert out["A"]["top5_share"] == 0.5 and out["A"]["avg_caps_norm"] == 0.5
    assert out["A"]["intl_goals_per_cap"] == pytest.approx(6 / 100)
    assert out["B"]["intl_goals_per_cap"] == 0.0 and out["B"]["top5_share"] == 1.0


def test_injury_loss_by_caps_and_by_heads(spark):
    squads = spark.createDataFrame(
        [("A", "x", 30, 1), ("A", "y", 70, 2), ("B", "u", 0, 1), ("B", "v", 0, 2), ("C", "w", 5, 1)],
        "team string, player_name string, caps int, pos int",
    )
    matched = spark.createDataFrame(
        [("A", "x"), ("A", "x"), ("A", None), ("B", "u"), ("B", "u")], "team string, player_name string"
    )
    out = {r["team"]: r["loss"] for r in Q.injury_loss(matched, squads).collect()}
    # Caps count a player once, heads count every report.
    assert out == {"A": 0.3, "B": 1.0, "C": 0.0}


def test_absences_keep_feed_order_and_every_player(spark):
    rows = [("A", f"p{i % 700}", 31 * i) for i in range(1000)] + [("B", "q", 9000), ("B", "p0", 2)]
    df = spark.createDataFrame(rows, "team string, player_name string, pos bigint")
    places = sorted(tuple(r) for r in Q.absence_list(df).select("team", "place", "player_name").collect())
    assert places == [("A", i, f"p{i}") for i in range(700)] + [("B", 0, "p0"), ("B", 1, "q")]


def test_upcoming_window_and_due_notices(spark):
    df = spark.sql(
        "select * from values (1, timestamp_ntz '2026-06-11 18:00:00', false), "
        "(2, timestamp_ntz '2026-06-11 18:30:00', false), (3, timestamp_ntz '2026-06-11 18:31:00', false), "
        "(4, timestamp_ntz '2026-06-11 10:00:00', true), (5, null, false) t(match_id, kickoff, is_completed)"
    )
    assert {r[0] for r in K.upcoming_matches(df, next_only=True).select("match_id").collect()} == {1, 2}
    now = F.lit("2026-06-11 17:15:00").cast("timestamp_ntz")
    assert {r[0] for r in K.due_notifications(df, now).select("match_id").collect()} == {2, 3}
