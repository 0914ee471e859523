"""Event-time boards: rate windows, first-seen, retention, live gates, stage durations and chunk progress.

Each stream has a batch twin with the same cut-off, used by the tests. State of windows, first-seen keys
and open stages is bounded by the watermark; the gate board keeps one row a gate, and chunk progress the
planned chunks of each job, for as long as the stream runs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cohortgrid.session import shared_folder


def read_stream(spark: SparkSession, path: str, schema: str, ts: str = "ts", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet folder as a stream with a declared schema and an event time column of TIMESTAMP type."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all available input once and hand back the sink table; progress is kept in the shared folder."""
    spark = df.sparkSession
    import uuid

    # the key-value store on disk takes any amount of state and the several tables of custom operators
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if mode == "append":
        q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{base}/out")
    table = f"{base}/out"

    def store(batch: DataFrame, number: int) -> None:
        # a batch that is replayed writes over what it wrote before
        batch.write.mode("overwrite").parquet(f"{table}/_batch={number}")

    q = df.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(table)


# ---- rate windows ----------------------------------------------------------------------------------
def rate_windows(events: DataFrame, key: str, limit: int, size: str = "1 hour", slide: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Events per key and sliding window with a breach flag; works on a stream or a table."""
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    g = e.groupBy(F.window("ts", size, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", (F.col("n") > limit).alias("breach"))


def closed_windows(table: DataFrame, events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The windows a stream with this watermark has closed after all events."""
    last = events.select(F.max("ts") - F.expr(f"INTERVAL {delay}")).scalar()
    return table.where(F.col("window_end") <= last)


# ---- first seen --------------------------------------------------------------------------------------
def first_seen(events: DataFrame, keys: list[str], ttl: str) -> DataFrame:
    """First event per key within the retention time; later copies are served from what is known."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


# ---- retention ---------------------------------------------------------------------------------------
def live_rows(runs: DataFrame, children: DataFrame, hours: int, now: F.Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs younger than N hours against the newest one, with their child rows."""
    top = runs.select(F.max("ts")).scalar() if now is None else now
    alive = runs.where(F.col("ts") >= top - F.expr(f"INTERVAL {hours} HOURS"))
    dead = runs.join(alive.select("run_id"), "run_id", "left_anti").select("run_id")
    return alive, children.join(dead, "run_id", "left_anti")


# ---- gate board ------------------------------------------------------------------------------------
def gate_board(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Latest value per gate key; on a stream run it in update mode."""
    last = F.max_by(F.struct("value", "seq"), F.struct("ts", "seq"))
    return ledger.groupBy(*keys).agg(F.max("ts").alias("ts"), last.alias("_l"), F.count(F.lit(1)).alias("n_records")).select(*keys, "ts", "_l.value", "n_records")


def last_updates(table: DataFrame, keys: list[str]) -> DataFrame:
    """Current row per key from the updates of all batches."""
    from cohortgrid.operators.scans import keep_first

    return keep_first(table, keys, [F.col("_batch").desc()]).drop("_batch")


# ---- stage durations -----------------------------------------------------------------------------------
STAGE_OUT = "run_id string, stage string, started long, ended long, seconds double, state string"
STAGE_STATE = "started long"


class StageTimer(StatefulProcessor):
    """Start and end events of one (run, stage): emits the duration, or a time-out when no end comes.

    Works on rows: a data frame per key and batch costs more than its few events. Times are microseconds,
    so no time zone has a say. An open stage has the one timer that its start gives, so timers are never listed.
    """

    def __init__(self, limit_ms: int):
        self._limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", STAGE_STATE)

    @staticmethod
    def _row(key, started: int, ended: int | None, state: str) -> Row:
        return Row(run_id=key[0], stage=key[1], started=started, ended=ended, seconds=None if ended is None else (ended - started) / 1e6, state=state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self._open.get()
        before = started = known[0] if known is not None else None
        for row in sorted(rows, key=lambda r: (r["at"], r["phase"] != "start")):
            if row["phase"] == "start":
                started = row["at"]
            elif started is not None and row["at"] >= started:
                yield self._row(key, started, row["at"], "done")
                started = None
        if started == before:
            return
        if before is not None:
            self._handle.deleteTimer(before // 1000 + self._limit)
        if started is None:
            self._open.clear()
        else:
            self._open.update((started,))
            self._handle.registerTimer(started // 1000 + self._limit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        started = self._open.get()
        self._open.clear()
        if started is not None:
            yield self._row(key, started[0], None, "timed_out")

    def close(self) -> None:
        pass


def stage_durations_stream(events: DataFrame, limit_hours: int, delay: str = "1 hour") -> DataFrame:
    """(run_id, stage, phase, ts) stream to durations; unfinished stages time out on event time."""
    e = events.withWatermark("ts", delay).select("run_id", "stage", "phase", "ts", F.unix_micros("ts").alias("at"))
    out = e.groupBy("run_id", "stage").transformWithState(StageTimer(limit_hours * 3_600_000), outputStructType=STAGE_OUT, outputMode="Append", timeMode="EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("started", "ended")})


def stage_durations(events: DataFrame, limit_hours: int) -> DataFrame:
    """Batch form: each start paired with the next event of its (run, stage) when that is an end.

    Starts without an end are timed out when the limit lies before the newest event, else open.
    """
    from cohortgrid.operators.scans import Scan, running

    order = [F.col("ts"), F.when(F.col("phase") == "start", 0).otherwise(1), F.col("event_id")]
    e = events.withColumn("_s", F.when(F.col("phase") == "start", F.col("ts")))
    nxt = running(e, ["run_id", "stage"], order, {"_n": Scan("sum", F.when(F.col("phase") == "start", 1).otherwise(0))})
    g = nxt.where(F.col("_n") > 0).groupBy("run_id", "stage", "_n").agg(F.max("_s").alias("started"), F.min(F.when(F.col("phase") == "end", F.col("ts"))).alias("ended"))
    top = events.select(F.max("ts")).scalar()
    state = F.when(F.col("ended").isNotNull(), "done").when(F.col("started") + F.expr(f"INTERVAL {limit_hours} HOURS") < top, "timed_out").otherwise("open")
    return g.select("run_id", "stage", "started", "ended", (F.col("ended").cast("timestamp").cast("double") - F.col("started").cast("timestamp").cast("double")).alias("seconds"), state.alias("state"))


# ---- chunk progress --------------------------------------------------------------------------------------
def chunk_progress(events: DataFrame) -> DataFrame:
    """Started and finished chunks per job with the completion share; stream or batch.

    A chunk counts once, however often it is reported; a job's set holds its planned chunks at most.
    """
    def chunks(status: str) -> F.Column:
        return F.size(F.collect_set(F.when(F.col("status") == status, F.col("chunk")))).cast("long")

    g = events.groupBy("job").agg(chunks("chunk_start").alias("started"), chunks("chunk_done").alias("done"), F.max("n_chunks").alias("n_chunks"))
    return g.withColumn("share", F.col("done") / F.col("n_chunks"))


def remaining_chunks(events: DataFrame) -> DataFrame:
    """Chunks a job still has to do, in order of resuming: planned minus done."""
    plan = events.groupBy("job").agg(F.max("n_chunks").alias("n_chunks")).select("job", F.explode(F.sequence(F.lit(1), F.col("n_chunks"))).alias("chunk"))
    done = events.where(F.col("status") == "chunk_done").select("job", F.col("chunk").cast("int").alias("chunk")).distinct()
    return plan.join(done, ["job", "chunk"], "left_anti")
