"""Streaming jobs: best prices, price snapshots, ratings and the signal log.

Each job takes a streaming DataFrame and returns either a streaming DataFrame or
a started query.  Event times must be ``timestamp`` (not ``timestamp_ntz``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from matchlab import constants as C
from matchlab.operators.odds import latest_per_key
from matchlab.operators.ratings import _scan_input, decayed, updated

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def best_odds_windows(ticks: DataFrame, minutes: int = C.ODDS_FRESH_MINUTES) -> DataFrame:
    """Best price per match, outcome and window; works on batch and stream alike."""
    span = f"{minutes} minutes"
    best = (
        ticks.withWatermark("ts", span)
        .groupBy(F.window("ts", span).alias("w"), "match_no", "event_type")
        .agg(F.max("price").alias("price"), F.count("*").alias("n"))
    )
    return best.select("w.start", "w.end", "match_no", "event_type", "price", "n")


SNAPSHOT_BUCKETS = 64
_MANIFEST = "bucket int, version long, v long"


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Version of every bucket as the last batch (of those before ``before``) left it."""
    system, folder = _folder(spark, f"{path}/manifest")
    if not system.exists(folder):
        return {}
    rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    if before is not None:
        rows = rows.filter(F.col("v") < before)
    last = rows.agg(F.max("v")).first()[0]
    return {r["bucket"]: r["version"] for r in rows.filter(F.col("v") == last).collect()}


def _places(path: str, versions: dict[int, int], buckets: list[int]) -> list[str]:
    return [f"{path}/data/v={versions[b]}/snapshot_bucket={b}" for b in buckets if b in versions]


def snapshot_stream(
    batches: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str],
    buckets: int = SNAPSHOT_BUCKETS,
) -> StreamingQuery:
    """Keep the latest row per key, in buckets of keys; a batch rewrites the buckets it touches.

    A batch writes its buckets under its id and then a manifest, one row per
    bucket, that says which version of every bucket holds.  It reads the manifest
    of the batch before it, so a batch that runs again writes the same files
    again.  What no manifest but older ones name is deleted one batch later.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("snapshot_bucket")
        held = _versions(spark, path, batch_id)
        # No more rows than there are buckets.
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]
        old, rows = _places(path, held, touched), batch
        if old:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*old))
        kept = latest_per_key(rows, keys, order).select(*batch.columns, bucket)
        if touched:
            kept.repartition("snapshot_bucket").write.mode("overwrite").partitionBy("snapshot_bucket").parquet(
                f"{path}/data/v={batch_id}"
            )
        now = {**held, **{b: batch_id for b in touched}}
        spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/manifest/v={batch_id}"
        )
        gone = _versions(spark, path, batch_id - 1)
        stale = [b for b in gone if held.get(b) != gone[b]]
        for place in [*_places(path, gone, stale), f"{path}/manifest/v={batch_id - 2}"]:
            system, folder = _folder(spark, place)
            system.delete(folder, True)

    return (
        batches.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    """The snapshot that the newest manifest names; empty before the first batch."""
    versions = _versions(spark, path)
    places = _places(path, versions, list(versions))
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


class _RatingProcessor(StatefulProcessor):
    """Ratings of one pool; matches wait until the pool's clock has passed their day.

    State holds one number and day per team, the open matches, and the day
    before which all is rated.  A micro-batch is the unit of memory: its rows
    and the open ones are put in order, and only touched teams are written back.
    """

    def __init__(self, delay_days: int) -> None:
        self.delay_days = delay_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.teams = handle.getMapState("teams", "team string", "rating double, day int")
        self.open = handle.getMapState(
            "open", "day int, match_id bigint",
            "home string, away string, bonus double, score double, k double",
        )
        self.done_before = handle.getValueState("done_before", "day int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = self.done_before.get()[0] if self.done_before.exists() else None
        late, fresh, newest = [], {}, None
        for batch in rows:
            for r in batch.itertuples(index=False):
                day, ident = int(r.day), int(r.match_id)
                newest = day if newest is None else max(newest, day)
                if not isinstance(r.home_team, str):
                    continue
                if closed is not None and day < closed:
                    late.append((key[0], ident, day, r.home_team, r.away_team, None, None, "late"))
                else:
                    fresh[day, ident] = (
                        r.home_team, r.away_team, float(r.bonus), float(r.score), float(r.k)
                    )
        bound = newest - self.delay_days
        if closed is not None:
            bound = max(bound, closed)
        waiting = dict(self.open.iterator())
        ready = sorted(k for k in (*waiting, *fresh) if k[0] < bound)
        done, now = [], {}
        for place in ready:
            home, away, bonus, score, k = fresh.get(place) or waiting[place]
            own, other = self._current(home, place[0], now), self._current(away, place[0], now)
            after = updated(own, other, bonus, score, k)
            now[home], now[away] = (after[0], place[0]), (after[1], place[0])
            done.append((key[0], place[1], place[0], home, away, own, other, "rated"))
        for team, value in now.items():
            self.teams.updateValue((team,), value)
        for place in waiting:
            if place[0] < bound:
                self.open.removeKey(place)
        for place, match in fresh.items():
            if place[0] >= bound:
                self.open.updateValue(place, match)
        self.done_before.update((bound,))
        yield _rated(late + done)

    def _current(self, team: str, day: int, now: dict[str, tuple[float, int]]) -> float:
        if team not in now:
            if not self.teams.containsKey((team,)):
                return C.INITIAL_RATING
            now[team] = self.teams.getValue((team,))
        rating, last = now[team]
        return decayed(rating, day - last)

    def close(self) -> None:
        pass


_RATED = (
    "pool string, match_id bigint, day int, home_team string, away_team string, "
    "elo_home_pre double, elo_away_pre double, status string"
)


def _rated(rows: list[tuple]) -> pd.DataFrame:
    names = [part.split()[0] for part in _RATED.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"elo_home_pre": "float64", "elo_away_pre": "float64"})


def rating_stream(matches: DataFrame, pool: str = "pool", delay_days: int = 1) -> DataFrame:
    """Pre-match ratings of a match stream, in event-time order per pool.

    A match is rated once its pool has seen a match more than ``delay_days``
    later.  A row without teams only moves its pool's clock: one with a late date
    closes the pool.  A match that arrives after its day was rated comes out with status
    "late" and no rating, instead of being dropped as a watermark would: a batch
    run over the corrected history places it.  The session needs the RocksDB
    state store.
    """
    rows = _scan_input(matches, pool).select(
        "pool", "match_id", "day", "home_team", "away_team", "bonus", "score", "k"
    )
    return rows.groupBy("pool").transformWithStateInPandas(
        statefulProcessor=_RatingProcessor(delay_days), outputStructType=_RATED,
        outputMode="Append", timeMode="None",
    )


_DAY_MS = 86_400_000
# Watermarks start at 0, so the clock of a match stream starts on 1800-01-01.
_CLOCK_START = -62091
_FLUSH, _SWEEP = 1, 2
MOST_MET = 50_000
MOST_PACKED = 100_000
MOST_HELD = 8 << 20
MOST_YIELDED = 10_000

_PACKED = "pool string, day int, whole boolean, matches string"


def _listed(column: pa.Array) -> list:
    """A column as Python values; integers beside nulls stay integers."""
    if column.null_count:
        return column.to_pylist()
    if pa.types.is_string(column.type):
        coded = column.dictionary_encode()
        return np.array(coded.dictionary.to_pylist(), object)[coded.indices.to_numpy()].tolist()
    return column.to_numpy(zero_copy_only=False).tolist()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the matches of a pool and day in some ``MOST_PACKED`` rows; those that lack something apart."""

    def rows() -> pa.RecordBatch:
        pools, numbers, whole = zip(*days)
        lines = [json.dumps(matches) for matches in days.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array(pools, pa.string()), pa.array(numbers, pa.int32()), pa.array(whole, pa.bool_()), pa.array(lines, pa.string())],
            ["pool", "day", "whole", "matches"],
        )

    days, held = {}, 0
    for batch in batches:
        for pool, day, *match in zip(*map(_listed, batch.columns)):
            whole = not (day is None or match[0] is None or match[1] is None or match[2] is None)
            days.setdefault((pool, day, whole), []).append(match)
        held += batch.num_rows
        if held >= MOST_PACKED:
            yield rows()
            days, held = {}, 0
    if days:
        yield rows()


class _TimedRatingProcessor(StatefulProcessor):
    """Ratings of one pool; a timer rates the open days that the watermark has passed, in order.

    State holds one number and day per team and the rows of each open day, in parts that are
    written once and read once. A task holds ``MOST_HELD`` characters of packed rows or one
    day of one pool, and little more than ``MOST_MET`` teams.
    """

    def __init__(self, forget_days: int | None) -> None:
        self.forget_days = forget_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.teams = handle.getMapState("teams", "team string", "rating double, day int")
        self.open = handle.getMapState("open", "day int, part bigint", "matches string")
        self.parts = handle.getValueState("parts", "next bigint")
        # The day of the only flush timer.
        self.due = handle.getValueState("due", "day int")
        self.swept = handle.getValueState("swept", "next int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        days, held, first = {}, 0, None
        for batch in rows:
            for day, whole, text in zip(batch["day"].tolist(), batch["whole"].tolist(), batch["matches"].tolist()):
                day = None if day != day or day is None else int(day)
                if not whole or _moment(day) < watermark:
                    status = "late" if whole else "incomplete"
                    yield _frame([(key[0], m[0], day, m[1], m[2], None, None, status) for m in json.loads(text)])
                    continue
                days.setdefault(day, []).append(text)
                first = day if first is None else min(first, day)
                held += len(text)
                if held >= MOST_HELD:
                    self._keep(days)
                    days, held = {}, 0
        if days:
            self._keep(days)
        if first is not None:
            self._wake(first)

    def _keep(self, days: dict[int, list[str]]) -> None:
        part = self.parts.get()[0] if self.parts.exists() else 0
        for day, texts in days.items():
            self.open.updateValue((day, part), ("\n".join(texts),))
        self.parts.update((part + 1,))

    def _wake(self, day: int) -> None:
        """Have the flush timer run once the watermark has passed ``day`` or an earlier one."""
        if self.due.exists():
            due = self.due.get()[0]
            if due <= day:
                return
            self.handle.deleteTimer(_moment(due) + _FLUSH)
        self.handle.registerTimer(_moment(day) + _FLUSH)
        self.due.update((day,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, what = divmod(expiredTimerInfo.getExpiryTimeInMs(), _DAY_MS)
        if what == _SWEEP:
            self._sweep(number + _CLOCK_START)
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        ready, later = [], None
        for day, part in self.open.keys():
            if _moment(day) + _FLUSH <= watermark:
                ready.append((day, part))
            else:
                later = day if later is None else min(later, day)
        now, done = {}, []
        for day, places in groupby(sorted(ready), lambda place: place[0]):
            matches = {}
            for place in places:
                for line in self.open.getValue(place)[0].split("\n"):
                    matches.update((m[0], m[1:]) for m in json.loads(line))
                self.open.removeKey(place)
            for ident, (home, away, bonus, score, k) in sorted(matches.items()):
                own, other = self._current(home, day, now), self._current(away, day, now)
                after = updated(own, other, bonus, score, k)
                now[home], now[away] = (after[0], day), (after[1], day)
                done.append((key[0], ident, day, home, away, own, other, "rated"))
                if len(done) >= MOST_YIELDED:
                    yield _frame(done)
                    done = []
            if len(now) > MOST_MET:
                self._store(now)
                now = {}
            if self.forget_days is not None and not self.swept.exists():
                self._next_sweep(day)
        self._store(now)
        self.due.clear()
        if later is not None:
            self._wake(later)
        if done:
            yield _frame(done)

    def _store(self, now: dict[str, tuple[float, int]]) -> None:
        for team, value in now.items():
            self.teams.updateValue((team,), value)

    def _current(self, team: str, day: int, now: dict[str, tuple[float, int]]) -> float:
        if team not in now:
            if not self.teams.containsKey((team,)):
                return C.INITIAL_RATING
            now[team] = tuple(self.teams.getValue((team,)))
        rating, last = now[team]
        if self.forget_days is not None and day - last > self.forget_days:
            return C.INITIAL_RATING
        return decayed(rating, day - last)

    def _next_sweep(self, day: int) -> None:
        after = day + self.forget_days + 1
        self.handle.registerTimer(_moment(after) + _SWEEP)
        self.swept.update((after,))

    def _sweep(self, day: int) -> None:
        """Remove what ``_current`` would not look at any more."""
        idle, others = [], False
        for (team,), (_, last) in self.teams.iterator():
            if day - last > self.forget_days:
                idle.append(team)
            else:
                others = True
        for team in idle:
            self.teams.removeKey((team,))
        self.swept.clear()
        if others:
            self._next_sweep(day)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows as the output's columns; integers beside nulls stay integers."""
    names = [part.split()[0] for part in _RATED.split(", ")]
    columns = zip(names, zip(*rows))
    return pd.DataFrame({n: pd.Series(c, dtype=object if None in c else None) for n, c in columns})


def _moment(day: int) -> int:
    """Milliseconds on the stream's clock at which ``day`` begins."""
    return (day - _CLOCK_START) * _DAY_MS


def timed_rating_stream(
    matches: DataFrame, pool: str = "pool", delay_days: int = 1, forget_days: int | None = None
) -> DataFrame:
    """Pre-match ratings of a match stream by event-time timers; no closing row is needed.

    The watermark stands ``delay_days`` behind the latest match of any pool. Once it has
    passed a day, a timer rates that day's matches in order of ``match_id``; so matches may
    arrive in any order within the delay, and a pool without news is rated too. Days that
    the watermark has not passed stay open. A match of a day before the watermark comes out
    with status "late", one without id, date or team with "incomplete", both without
    ratings. Of repeated rows of one id and day the last to arrive counts. With
    ``forget_days``, a team that has not played for longer starts as a new one, and a
    timer removes it from the state. Dates lie after 1800. Extra columns are ignored.
    The session needs the RocksDB state store.
    """
    rows = _scan_input(matches, pool).select(
        "pool", "day", "match_id", "home_team", "away_team", "bonus", "score", "k"
    )
    # Rows cross to the state one by one, so a day's matches cross as one.
    packed = rows.repartition("pool", "day").mapInArrow(_packed, _PACKED)
    timed = packed.withColumn("clock", F.timestamp_seconds((F.col("day").cast("long") - _CLOCK_START) * (_DAY_MS // 1000)))
    # Late rows are told apart by the processor, so it does not see the clock that would drop them.
    return timed.withWatermark("clock", f"{delay_days} days").drop("clock").groupBy("pool").transformWithStateInPandas(
        statefulProcessor=_TimedRatingProcessor(forget_days), outputStructType=_RATED,
        outputMode="Append", timeMode="EventTime",
    )


def form_log_stream(signals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append signal reads to a JSON log partitioned by day."""
    rows = signals.withColumn("log_date", F.to_date("logged_at"))
    return (
        rows.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("log_date")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
