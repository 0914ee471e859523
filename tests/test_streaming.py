"""Streams against their batch twins on the same rows."""

import time

import pytest
from pyspark.sql import functions as F

from cohortgrid.bindings import streams as B
from cohortgrid.streaming import boards

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(params=["at once", "in parts"])
def live_events(request, spark, tmp_path):
    """The events as a stream: one batch, or four arriving one after the other in event-time order."""
    if request.param == "at once":
        return lambda: B.stream(spark, FOLDER)
    e = spark.read.parquet(f"{FOLDER}/events.parquet")
    n = e.count()
    for i in range(4):
        part = e.where((F.col("event_id") >= i * n // 4) & (F.col("event_id") < (i + 1) * n // 4))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    return lambda: boards.read_stream(spark, str(tmp_path / "in"), B.EVENTS, files_per_trigger=1)


def rows(df, *cols):
    return sorted(tuple(str(v) for v in r) for r in df.select(*cols).collect())


def test_rate_windows_equal_the_closed_batch_windows(spark, live_events):
    live = boards.run_available(boards.rate_windows(live_events(), "user_id", 2), "t1")
    e = B.batch(spark, FOLDER)
    table = boards.closed_windows(boards.rate_windows(e, "user_id", 2), e)
    cols = ("user_id", "window_start", "n", "breach")
    assert rows(live, *cols) == rows(table, *cols)


def test_first_seen_keeps_one_row_per_key(spark, live_events):
    s = live_events().select("ts", "user_id", "event_type")
    live = boards.run_available(boards.first_seen(s, ["user_id", "event_type"], "60 days"), "t2")
    want = B.batch(spark, FOLDER).select("user_id", "event_type").distinct()
    assert rows(live, "user_id", "event_type") == rows(want, "user_id", "event_type")


def test_gate_board_equals_batch(spark, live_events):
    keys = ["event_type", "user_id"]
    pick = lambda d: d.select("ts", *keys, "value", F.col("event_id").alias("seq"))
    live = boards.last_updates(boards.run_available(boards.gate_board(pick(live_events()), keys), "t3", "update"), keys)
    table = boards.gate_board(pick(B.batch(spark, FOLDER)), keys)
    assert rows(live, *keys, "value", "n_records") == rows(table, *keys, "value", "n_records")


@pytest.mark.parametrize("hours", [48])
def test_stage_durations_agree(spark, live_events, hours):
    s = B.stages(live_events()).select("run_id", "stage", "phase", "ts")
    live = boards.run_available(boards.stage_durations_stream(s, hours), "t4").where("state = 'done'")
    table = boards.stage_durations(B.stages(B.batch(spark, FOLDER)), hours).where("state = 'done'").where(F.col("seconds") <= hours * 3600)
    short = live.where(F.col("seconds") <= hours * 3600)
    assert rows(short, "run_id", "started", "ended") == rows(table, "run_id", "started", "ended")


def test_a_chunk_reported_again_counts_once(spark):
    rows = [("j", "chunk_done", 1, 4)] * 4 + [("j", "chunk_start", 2, 4)]
    got = boards.chunk_progress(spark.createDataFrame(rows, "job string, status string, chunk int, n_chunks int")).first()
    assert (got["started"], got["done"], got["share"]) == (1, 1, 0.25)
