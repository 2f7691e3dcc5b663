"""Streaming queries, each run to the end of its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlab.catalog.registry import query
from matchlab.catalog.timelines import ELO
from matchlab.catalog.views import table, twin, view
from matchlab.session import durable, scratch_path
from matchlab.streaming import jobs as J


def as_stream(df, name, clock, closing=None, files=4):
    """The same rows as a stream of files in the order of ``clock``, one file a micro-batch.

    The rows of ``closing`` come last and end the stream.
    """
    path = scratch_path(df.sparkSession, name)
    df = durable(df)
    low, high = df.agg(F.min(clock), F.max(clock)).first()
    part = F.least(F.lit(files - 1), F.floor((clock - low) * files / (high - low + 1)))
    for i in range(files):
        # The whole table is read by all tasks, only a slice's rows are written by one.
        df.filter(part == i).repartition(1).write.mode("append").parquet(path)
    if closing is not None:
        closing.select(*df.columns).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def to_table(stream, name):
    """Run a stream until its input is used up; its output as a table."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    writer = (
        stream.writeStream.format("parquet").option("path", path).outputMode("append")
        .option("checkpointLocation", scratch_path(spark, f"{name}-progress"))
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def ticks(spark, sf):
    return view(spark, sf, "tb_ticks").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_best_odds",
    twin("tb_ticks", """
    select time_bucket(interval 15 minutes, ts) as start, match_no, event_type, round(max(price), 6) as price,
      count(*) as n from tb_ticks group by 1, 2, 3"""),
)
def stream_best_odds(spark, sf):
    rows = ticks(spark, sf)
    # A tick a day later ends all windows of the real ones; its own stays open.
    last = rows.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.expr("ts + interval 1 day"))
    stream = as_stream(rows, "ticks", F.unix_micros("ts"), closing=last)
    out = to_table(J.best_odds_windows(stream), "best")
    return out.select(
        F.col("start").cast("timestamp_ntz").alias("start"), "match_no", "event_type",
        F.round("price", 6).alias("price"), "n",
    )


@query(
    "stream_odds_snapshot",
    twin("tb_ticks", """
    select match_no, event_type, arg_max(event_id, ts) as event_id, arg_max(price, ts) as price
    from tb_ticks group by 1, 2"""),
)
def stream_odds_snapshot(spark, sf):
    rows = ticks(spark, sf).select("match_no", "event_type", "event_id", "ts", "price")
    path = scratch_path(spark, "snapshot")
    run = J.snapshot_stream(
        as_stream(rows, "ticks", F.unix_micros("ts")), path, scratch_path(spark, "progress"),
        ["match_no", "event_type"], ["ts", "event_id"],
    )
    run.awaitTermination()
    return J.latest_snapshot(spark, path, rows.schema).drop("ts")


@query(
    "stream_elo",
    twin("tb_matches", ELO + """
    select match_id, round(hp, 6) as elo_home_pre, round(ap, 6) as elo_away_pre from rated""", True),
)
def stream_elo(spark, sf):
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, J.STATE_STORE)
    try:
        rows = view(spark, sf, "tb_matches")
        # A row without teams a year later closes each pool.
        ends = rows.groupBy("pool").agg(F.date_add(F.max("match_date"), 366).alias("match_date"))
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ends.columns]
        closing = ends.select("*", *blank).withColumn("match_id", F.lit(-1).cast("bigint"))
        stream = as_stream(rows, "matches", F.unix_date("match_date"), closing)
        out = to_table(J.rating_stream(stream), "rated")
    finally:
        spark.conf.set(store, before)
    return out.filter("status = 'rated'").select(
        "match_id", F.round("elo_home_pre", 6).alias("elo_home_pre"),
        F.round("elo_away_pre", 6).alias("elo_away_pre"),
    )


DELAY = 3


@query(
    "stream_elo_timed",
    twin("tb_matches", ELO + f"""
    select match_id, round(hp, 6) as elo_home_pre, round(ap, 6) as elo_away_pre from rated
    where match_date < (select max(match_date) from tb_matches) - {DELAY}""", True),
)
def stream_elo_timed(spark, sf):
    """Matches that arrive up to ``DELAY`` days out of order; the last days stay open."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, J.STATE_STORE)
    try:
        rows = view(spark, sf, "tb_matches")
        arrival = F.unix_date("match_date") + F.pmod(F.xxhash64("match_id"), F.lit(DELAY + 1))
        out = to_table(J.timed_rating_stream(as_stream(rows, "matches", arrival), delay_days=DELAY), "rated")
    finally:
        spark.conf.set(store, before)
    return out.filter("status = 'rated'").select(
        "match_id", F.round("elo_home_pre", 6).alias("elo_home_pre"),
        F.round("elo_away_pre", 6).alias("elo_away_pre"),
    )


@query(
    "stream_form_log",
    twin("tb_ticks", """
    select cast(ts as date) as log_date, count(*) as n, round(sum(value), 4) as form_score from events group by 1"""),
)
def stream_form_log(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("logged_at"), F.col("user_id").cast("string").alias("team"),
        F.col("value").alias("form_score"),
    )
    path = scratch_path(spark, "form-log")
    J.form_log_stream(as_stream(rows, "signals", F.unix_micros("logged_at")), path, scratch_path(spark, "progress")).awaitTermination()
    written = spark.read.schema("team string, form_score double, log_date date").json(path)
    return written.groupBy("log_date").agg(
        F.count("*").alias("n"), F.round(F.sum("form_score"), 4).alias("form_score")
    )
