import datetime as dt
import json
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import MATCH_SCHEMA, day, random_matches, ratings_by_hand
from matchlab.operators import context as K
from matchlab.session import durable, ensure_checkpoint_dir, scratch_path
from matchlab.sources import feeds as S
from matchlab.sources import results as R
from matchlab.streaming import jobs as J


def payload(spark, docs, key="match_id"):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], f"{key} int, payload string")


def test_nested_fixture_takes_the_ninety_minute_score(spark):
    docs = [
        {"fixture": {"date": "2026-07-01T18:00:00+00:00", "status": {"short": "AET"}, "venue": {"name": None}},
         "teams": {"home": {"name": "Korea Republic"}, "away": {"name": "Spain"}}, "league": {"round": "Final"},
         "score": {"fulltime": {"home": 1, "away": 1}}, "goals": {"home": 2, "away": 1}},
        {"fixture": {"date": "bad", "status": {"short": "NS"}}, "teams": {"home": {"name": "A"}, "away": {"name": "B"}},
         "score": {"fulltime": {"home": None, "away": None}}},
        {"teams": {"home": {"name": "A"}, "away": {"name": "B"}}},
    ]
    a, b, c = S.normalise_fixtures_nested(payload(spark, docs)).orderBy("match_id").collect()
    assert (a["home_team"], a["home_score"], a["away_score"], a["is_completed"], a["venue"]) == ("South Korea", 1, 1, True, "")
    assert (b["kickoff"], b["home_score"], b["is_completed"], b["stage"]) == (None, None, False, "Group Stage")
    assert c["is_completed"] is False


def test_flat_fixture(spark):
    docs = [
        {"date": "2026-06-11", "time": "13:00 UTC-6", "team1": "USA", "team2": "Spain", "round": "Matchday 1",
         "group": "Group A", "ground": {"name": "Azteca"}, "score": {"ft": [2, 1]}},
        {"date": "2026-06-12", "team1": "A", "team2": "B", "round": "Final", "ground": "Dallas"},
        {"date": "2026-06-12", "team1": "1A", "team2": "B", "round": "Final"},
    ]
    a, b = S.normalise_fixtures_flat(payload(spark, docs)).orderBy("match_id").collect()
    assert (a["home_team"], a["stage"], a["venue"], a["home_score"]) == ("United States", "Group A - Matchday 1", "Azteca", 2)
    assert str(a["kickoff"]) == "2026-06-11 19:00:00"
    assert (b["stage"], b["venue"], b["home_score"], b["is_completed"]) == ("Final", "Dallas", None, False)


def test_best_price_over_bookmakers(spark):
    def book(h, d, a, key="h2h"):
        prices = {"H": h, "Draw": d, "A": a}
        return {"markets": [{"key": key, "outcomes": [{"name": n, "price": p} for n, p in prices.items() if p]}]}

    docs = [
        {"home_team": "H", "away_team": "A", "bookmakers": [book(2.0, 3.0, 4.0), book(2.2, 2.9, 3.9), book(9, 9, 9, "totals")]},
        {"home_team": "H", "away_team": "A", "bookmakers": [book(2.0, None, 4.0)]},
        {"home_team": "H", "away_team": "A", "bookmakers": [book(None, 3.0, 4.0)]},
        {"home_team": "H", "away_team": "A", "bookmakers": []},
    ]
    out = {r["match_id"]: r for r in S.event_best_odds(payload(spark, docs)).collect()}
    assert set(out) == {0, 1}
    assert (out[0]["odds_home"], out[0]["odds_draw"], out[0]["odds_away"]) == (2.2, 3.0, 4.0)
    assert out[1]["odds_draw"] is None


def test_documents_are_parsed_once(spark):
    df = S.event_best_odds(payload(spark, [{}])).filter("odds_home > 1.5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_absences_of_past_matches_and_unknown_kinds_are_left_out(spark):
    def doc(date, kind, name="P"):
        return {"fixture": {"date": date}, "team": {"name": "IR Iran"}, "player": {"name": name}, "type": kind}

    docs = [doc("2026-06-20T00:00:00Z", "Injury"), doc("2026-06-01T00:00:00Z", "Injury", "old"), doc("?", "Suspension", "Q"),
            doc("2026-06-20T00:00:00Z", "Doubt", "R"), doc("2026-06-20T00:00:00Z", "Injury"), doc("2026-06-20T00:00:00Z", "Injury", "")]
    out = S.normalise_injuries(payload(spark, docs, "pos"), F.lit("2026-06-15").cast("timestamp_ntz")).collect()
    assert {(r["team"], r["player_name"], r["pos"]) for r in out} == {("Iran", "P", 0), ("Iran", "Q", 2)}


def test_first_source_with_rows_wins_whole(spark):
    empty, a, b = (spark.createDataFrame(rows, "x int") for rows in ([], [(1,), (2,)], [(3,)]))
    assert {r["x"] for r in S.source_fallback([empty, a, b]).collect()} == {1, 2}
    assert S.source_fallback([empty, empty]).count() == 0


def test_results_file(spark, tmp_path):
    results = tmp_path / "results.csv"
    results.write_text(
        "date,home_team,away_team,home_score,away_score,tournament,city,country,neutral\n"
        "2018-07-11,Croatia,England,2,1,FIFA World Cup,M,Russia,True\n"
        "2018-07-10,France,Belgium,,0,FIFA World Cup,M,Russia,TRUE\n"
        "2018-06-01,A,B,3.0,1.0,Friendly,M,X,False\n"
    )
    goals = tmp_path / "goals.csv"
    goals.write_text(
        "date,home_team,away_team,team,scorer,minute,own_goal,penalty\n"
        "2018-07-11,Croatia,England,England,T,5,False,False\n"
        "2018-07-11,Croatia,England,Croatia,P,68,False,False\n"
        "2018-07-11,Croatia,England,Croatia,M,109,False,False\n"
    )
    a, b = R.load_results(spark, str(results), str(goals)).collect()
    assert (a["home_team"], a["home_score"], a["neutral"]) == ("A", 3, False)
    assert (b["home_score"], b["away_score"], b["neutral"], b["country"]) == (1, 1, True, "Russia")


def test_injected_matches_extend_the_history(spark):
    rows = random_matches(60, seed=12)
    history = K.match_flags(
        spark.createDataFrame(rows, MATCH_SCHEMA).withColumns({"elo_home_pre": F.lit(1500.0), "elo_away_pre": F.lit(1500.0)})
    )
    new = spark.createDataFrame(
        [(1000, None, "P0T0", "P0T1", 1, 0, "Group"), (1001, None, "P0T2", "Mexico", 0, 0, "Final")],
        "match_id bigint, match_date date, home_team string, away_team string, home_score int, away_score int, stage string",
    )
    out = {r["match_id"]: r for r in K.inject_completed(history, new).collect()}
    assert len(out) == 62
    assert str(out[1000]["match_date"]) == "2026-06-11" and out[1000]["tournament"] == "FIFA World Cup"
    assert out[1000]["is_knockout"] is False and out[1001]["is_knockout"] is True and out[1001]["is_host_away"]
    _, ends = ratings_by_hand([(*r[:8], "x") for r in rows])
    # Decay after the long gap applies before the match.
    gap = (out[1000]["match_date"] - max(r[1] for r in rows if "P0T0" in r)).days
    end = ends["x", "P0T0"]
    assert out[1000]["elo_home_pre"] == pytest.approx(end - 0.1 * gap / 365 * (end - 1500))


def test_cluster_checkpoint_folder_is_respected(spark, tmp_path):
    folder = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == folder
    df = durable(spark.range(3).withColumn("x", F.col("id") * 2))
    assert folder.removeprefix("file:") in df.inputFiles()[0]
    assert df.agg(F.sum("x")).first()[0] == 6


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, J.STATE_STORE)
    yield
    spark.conf.set(key, before)


def test_rating_stream_over_several_batches(spark, rocksdb):
    rows = random_matches(120, days=900, pools=2, seed=21)
    path, out, progress = (scratch_path(spark, n) for n in ("in", "out", "progress"))
    # Three files in time order, then a straggler from the first day.
    late = (999, day(-5), "P0T0", "P0T1", 1, 0, True, "Cup", "0")
    for part in (rows[:40], rows[40:80], rows[80:], [late]):
        spark.createDataFrame(part, MATCH_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(MATCH_SCHEMA).parquet(path)
        run = J.rating_stream(stream).writeStream.format("parquet").option("path", out)
        run.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    got = {r["match_id"]: r for r in spark.read.parquet(out).collect()}
    assert got[999]["status"] == "late"
    expected, _ = ratings_by_hand(rows)
    last = {pool: max(r[1] for r in rows if r[8] == pool) for pool in "01"}
    closed = [r for r in rows if (last[r[8]] - r[1]).days > 1]
    rated = {k: v for k, v in got.items() if v["status"] == "rated"}
    assert {r[0] for r in closed} == set(rated)
    for ident, r in rated.items():
        assert (r["elo_home_pre"], r["elo_away_pre"]) == pytest.approx(expected[ident])


def _timed(spark, parts, **options):
    """Rows of a timed rating stream over ``parts``, one run of the stream each."""
    path, out, progress = (scratch_path(spark, n) for n in ("in", "out", "progress"))
    for part in parts:
        spark.createDataFrame(part, MATCH_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(MATCH_SCHEMA).parquet(path)
        run = J.timed_rating_stream(stream, **options).writeStream.format("parquet").option("path", out)
        run.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).collect()


def test_timers_rate_days_the_watermark_has_passed(spark, rocksdb):
    rows = random_matches(120, days=900, pools=2, seed=21)
    rows = [(i, r[1], *r[2:]) for i, r in enumerate(rows)]
    rows = sorted(rows, key=lambda r: (r[1] + dt.timedelta(days=r[0] * 7 % 6), -r[0]))
    late = (999, day(-5), "P0T0", "P0T1", 1, 0, True, "Cup", "0")
    odd = [(998, None, "P0T0", "P0T1", 1, 0, True, "Cup", "0"), (997, day(899), None, "P0T1", 1, 0, True, "Cup", "0"), (None, day(899), "a", "b", 1, 0, True, "Cup", "0")]
    # Out of order by up to five days; a repeated row; then a straggler and incomplete rows.
    got = _timed(spark, [rows[:40] + rows[:1], rows[40:80], rows[80:], [late, *odd]], delay_days=5)
    told = lambda status: {r["match_id"]: r for r in got if r["status"] == status}
    assert set(told("late")) == {999} and set(told("incomplete")) == {997, 998, None}
    expected, _ = ratings_by_hand(rows)
    end = max(r[1] for r in rows)
    rated = told("rated")
    assert set(rated) == {r[0] for r in rows if (end - r[1]).days > 5} and len(got) == len(rated) + 4
    for ident, r in rated.items():
        assert (r["elo_home_pre"], r["elo_away_pre"]) == pytest.approx(expected[ident])


def test_idle_teams_are_forgotten_and_old_dates_count(spark, rocksdb):
    match = lambda i, when, home="A", away="B": (i, when, home, away, 2, 0, True, "Cup", "0")
    first = dt.date(1872, 11, 30)
    at = lambda n: first + dt.timedelta(days=n)
    parts = [[match(1, at(0)), match(2, at(50), "C", "D")], [match(3, at(100)), match(4, at(140), "C", "D")], [match(5, at(201)), match(6, at(400), "X", "Y")]]
    got = {r["match_id"]: r for r in _timed(spark, parts, forget_days=100)}
    assert [got[i]["elo_home_pre"] > 1500 for i in (1, 2, 3, 4, 5)] == [False, False, True, True, False]


def test_timed_stream_of_nothing(spark, rocksdb):
    assert _timed(spark, [[]]) == []


class _Kept(dict):
    """State of one key, map or value, that counts what is written."""

    def __init__(self):
        self.writes = 0

    updateValue = lambda self, k, v: (self.__setitem__(k, v), setattr(self, "writes", self.writes + 1))
    containsKey, getValue, removeKey, iterator = dict.__contains__, dict.__getitem__, dict.pop, dict.items
    exists = lambda self: len(self) > 0
    update = lambda self, v: self.updateValue(None, v)
    get = lambda self: self[None]


class _Handle:
    def __init__(self):
        self.kept, self.timers = {}, set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def getMapState(self, name, *_):
        return self.kept.setdefault(name, _Kept())

    getValueState = getMapState


def test_timed_state_is_written_once_a_run(monkeypatch):
    """Parts of open days are not read again for later rows; one timer rates all days that are ready."""
    rows = random_matches(300, days=60, seed=4)
    expected, _ = ratings_by_hand(rows)
    for name, value in (("MOST_PACKED", 20), ("MOST_HELD", 1500), ("MOST_YIELDED", 7)):
        monkeypatch.setattr(J, name, value)
    names = ["pool", "day", "match_id", "home_team", "away_team", "bonus", "score", "k"]
    score = lambda r: 1.0 if r[4] > r[5] else 0.5 if r[4] == r[5] else 0.0
    k = {"Friendly": 20.0, "FIFA World Cup": 60.0, "Cup": 35.0}
    data = [("0", (r[1] - dt.date(1970, 1, 1)).days, r[0], r[2], r[3], 0.0 if r[6] else 100.0, score(r), k[r[7]]) for r in rows]
    data = sorted(data, key=lambda r: r[2] * 7 % 300)
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in data[i : i + 10]]) for i in range(0, 300, 10)]
    frames = [b.to_pandas() for b in J._packed(iter(batches))]
    assert len(frames) == 15
    handle, clock = _Handle(), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    job = J._TimedRatingProcessor(None)
    job.init(handle)
    assert list(job.handleInputRows(("0",), iter(frames), clock)) == [] and len(handle.timers) == 1
    parts = handle.kept["open"]
    assert parts.writes == len(parts) > 60 and sum(len(json.loads(t)) for (v,) in parts.values() for t in v.split("\n")) == 300
    (due,) = handle.timers
    last = max(r[1] for r in data)
    late = SimpleNamespace(getCurrentWatermarkInMs=lambda: J._moment(last))
    out = pd.concat(job.handleExpiredTimer(("0",), late, SimpleNamespace(getExpiryTimeInMs=lambda: due)))
    assert {day for day, _ in parts} == {last} and handle.timers == {J._moment(last) + J._FLUSH, due} and handle.kept["teams"].writes == len(handle.kept["teams"])
    assert set(out["match_id"]) == {r[2] for r in data if r[1] < last}
    for r in out.itertuples():
        assert (r.elo_home_pre, r.elo_away_pre) == pytest.approx(expected[r.match_id])
    # A day earlier than the timer's moves it; Spark removes the one that has run.
    handle.timers.discard(due)
    list(job.handleInputRows(("0",), iter(frames[:1]), clock))
    assert len(handle.timers) == 1 and min(handle.timers) < J._moment(last)


def test_timed_stream_keeps_large_ids_beside_nulls(spark, rocksdb):
    big = (1 << 60) + 1
    match = lambda i, n, home="A": (i, day(n), home, "B", 2, 0, True, "Cup", "0")
    got = _timed(spark, [[match(big, 0), match(None, 0), match(big + 1, 0, None)], [match(1, 20), match(None, 20)], [match(big + 2, 1), match(2, 30)]])
    assert {(r["match_id"], r["status"]) for r in got} == {
        (big, "rated"), (None, "incomplete"), (big + 1, "incomplete"), (1, "rated"), (big + 2, "late"),
    }
