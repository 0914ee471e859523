"""Streaming boards on the events table, read as a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortgrid.bindings.registry import query
from cohortgrid.bindings.tables import r6, table
from cohortgrid.streaming import boards as B

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark, folder):
    """The events table as a stream of files, all present at the start, so their order does not matter."""
    from cohortgrid.bindings.reading import scratch

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = scratch(spark, "events")
    table(spark, folder, "events").write.parquet(path)
    return B.read_stream(spark, path, EVENTS)


def batch(spark, folder):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("str_01_rate_windows")
def _(spark, folder):
    return B.run_available(B.rate_windows(stream(spark, folder), "user_id", 2), "rates")


@query("str_01_rate_windows_batch", """
WITH e AS (SELECT user_id, ts, epoch(date_trunc('hour', ts)) + CASE WHEN minute(ts) >= 30 THEN 1800 ELSE 0 END AS s FROM events), w AS (SELECT user_id, unnest([s, s - 1800]) AS ws FROM e)
SELECT user_id, CAST(ws AS BIGINT) AS window_start, count(*) AS n, count(*) > 2 AS breach FROM w GROUP BY 1, 2""")
def _(spark, folder):
    w = B.rate_windows(batch(spark, folder), "user_id", 2)
    return w.select("user_id", F.unix_seconds("window_start").alias("window_start"), "n", "breach")


@query("str_02_first_seen")
def _(spark, folder):
    s = stream(spark, folder).select("ts", "user_id", "event_type")
    return B.run_available(B.first_seen(s, ["user_id", "event_type"], "60 days"), "first")


@query("str_03_retention", """
WITH r AS (SELECT user_id AS run_id, max(ts) AS ts FROM events GROUP BY 1), l AS (SELECT run_id FROM r WHERE ts >= (SELECT max(ts) FROM r) - INTERVAL 20 HOUR)
SELECT event_id, user_id AS run_id FROM events WHERE user_id IN (SELECT run_id FROM l)""")
def _(spark, folder):
    e = batch(spark, folder)
    runs = e.groupBy(F.col("user_id").alias("run_id")).agg(F.max("ts").alias("ts"))
    _, children = B.live_rows(runs, e.select("event_id", F.col("user_id").alias("run_id")), 20)
    return children


@query("str_04_gate_board", """
SELECT event_type, user_id, arg_max(value, event_id) AS value, count(*) AS n_records FROM events GROUP BY 1, 2""")
def _(spark, folder):
    s = stream(spark, folder).select("ts", "event_type", "user_id", "value", F.col("event_id").alias("seq"))
    keys = ["event_type", "user_id"]
    out = B.last_updates(B.run_available(B.gate_board(s, keys), "gates", "update"), keys)
    return out.select("event_type", "user_id", "value", "n_records")


def stages(df):
    return df.select("event_id", "ts", F.col("user_id").cast("string").alias("run_id"), F.lit("load").alias("stage"), F.when(F.col("event_type").isin("click", "view"), "start").otherwise("end").alias("phase"))


@query("str_05_stage_durations_stream")
def _(spark, folder):
    s = stages(stream(spark, folder)).select("run_id", "stage", "phase", "ts")
    return B.run_available(B.stage_durations_stream(s, 48), "stages")


@query("str_05_stage_durations", """
WITH e AS (SELECT event_id, ts, user_id, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS st FROM events), n AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, 1 - st, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e), g AS (SELECT user_id, k, max(ts) FILTER (WHERE st = 1) AS started, min(ts) FILTER (WHERE st = 0) AS ended FROM n WHERE k > 0 GROUP BY 1, 2)
SELECT CAST(user_id AS VARCHAR) AS run_id, round(epoch(ended) - epoch(started), 3) AS seconds, CASE WHEN ended IS NOT NULL THEN 'done' WHEN started + INTERVAL 48 HOUR < (SELECT max(ts) FROM events) THEN 'timed_out' ELSE 'open' END AS state FROM g""")
def _(spark, folder):
    return B.stage_durations(stages(batch(spark, folder)), 48).select("run_id", r6("seconds", 3).alias("seconds"), "state")


def chunks(df):
    return df.select(F.concat(F.lit("job"), (F.col("user_id") % 25).cast("string")).alias("job"), F.when(F.col("event_type").isin("click", "view"), "chunk_start").otherwise("chunk_done").alias("status"), (F.col("event_id") % 60 + 1).cast("int").alias("chunk"), F.lit(60).alias("n_chunks"), "ts")


@query("str_06_chunk_progress", """
SELECT 'job' || (user_id % 25) AS job, count(DISTINCT event_id % 60) FILTER (WHERE event_type IN ('click', 'view')) AS started, count(DISTINCT event_id % 60) FILTER (WHERE event_type NOT IN ('click', 'view')) AS done, round(count(DISTINCT event_id % 60) FILTER (WHERE event_type NOT IN ('click', 'view')) / 60, 6) AS share FROM events GROUP BY 1""")
def _(spark, folder):
    s = chunks(stream(spark, folder))
    out = B.last_updates(B.run_available(B.chunk_progress(s), "chunks", "update"), ["job"])
    return out.select("job", "started", "done", r6("share").alias("share"))


@query("str_06_remaining_chunks", """
WITH d AS (SELECT DISTINCT user_id % 25 AS j, event_id % 60 + 1 AS c FROM events WHERE event_type NOT IN ('click', 'view')) SELECT 'job' || j.j AS job, CAST(c.c AS INTEGER) AS chunk FROM (SELECT DISTINCT user_id % 25 AS j FROM events) j CROSS JOIN range(1, 61) c(c) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.j = j.j AND d.c = c.c)""")
def _(spark, folder):
    return B.remaining_chunks(chunks(batch(spark, folder)))
