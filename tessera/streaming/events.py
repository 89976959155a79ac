"""Event streams: windows, sessions, duplicates and lookups, with batch forms where order decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.storage import new_path

DELAY = "10 minutes"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the events table, its times as timestamps so that they can be watermarked."""
    schema = spark.read.parquet(path).schema
    # A pattern, since a stream takes a plain path for a directory and a table may be one file.
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str = "complete", base: str | None = None) -> DataFrame:
    """Process all that is there now and return the result, which a sink in the shared folder holds.

    With `append` and Parquet files the sink is exactly-once; with `complete` each batch overwrites the result. Checkpoint
    and result are under `base`; the same one again continues where the last run ended.
    """
    spark = stream.sparkSession
    base = base or new_path(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


#: The state store that stateful processors need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_stateful(stream: DataFrame, base: str | None = None) -> DataFrame:
    """`run_to_end` for a stream with a stateful processor, whose rows are appended; the session's state store is put back after it."""
    conf, (name, store) = stream.sparkSession.conf, STATE_STORE
    before = conf.get(name, None)
    conf.set(name, store)
    try:
        return run_to_end(stream, "append", base)
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events and value by type and window: window_start, event_type, n, total."""
    return sliding(events, width, width)


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    by = events.withWatermark("ts", DELAY).groupBy(F.window("ts", width, step).alias("w"), "event_type") if events.isStreaming else events.groupBy(F.window("ts", width, step).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "60 minutes") -> DataFrame:
    """Sessions by user: events less than or exactly `gap` apart belong together: user_id, session_start, n, total."""
    held = events.withWatermark("ts", DELAY) if events.isStreaming else events
    found = held.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("s.start").alias("session_start"), "n", F.round("total", 4).alias("total"))


def idle_sessions(events: DataFrame, gap_seconds: int = 3600, piece_seconds: int = 86_400) -> DataFrame:
    """Sliding idle sessions: one ends when nothing happens for `gap_seconds`; an event at just that time begins the next.

    Returns user_id, session_no (from 0), started, ended and n, of batch events in order of time, then id. A user's time is
    cut into pieces: gaps and numbers are told inside a piece, and of the pieces before it only their last time and their
    number of sessions count. So a user with a large share of all events is many groups.
    """
    at = F.col("ts").cast("timestamp").cast("double")
    held = events.withColumns({"_at": at, "_piece": F.floor(at / piece_seconds)})
    inside, along = Window.partitionBy("user_id", "_piece").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy("_piece")
    ends = held.groupBy("user_id", "_piece").agg(F.max("_at").alias("_end"))
    ends = ends.select("user_id", "_piece", F.lag("_end").over(along).alias("_before"))
    held = held.join(ends, ["user_id", "_piece"])
    gone = F.col("_at") - F.coalesce(F.lag("_at").over(inside), F.col("_before"))
    held = held.withColumn("_new", F.coalesce((gone >= gap_seconds).cast("long"), F.lit(0).cast("long")))
    begun = held.groupBy("user_id", "_piece").agg(F.sum("_new").alias("_n"))
    begun = begun.select("user_id", "_piece", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    numbered = held.join(begun, ["user_id", "_piece"]).withColumn("session_no", F.col("_first") + F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session_no").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


def without_repeats(events: DataFrame, key: list[str]) -> DataFrame:
    """Events without those that repeat a key, within the watermark where they stream."""
    return events.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def enrich(events: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Stream-static join with a dimension table."""
    return events.join(table, on, "left")


def with_writes(answers: DataFrame, writes: DataFrame, within: str, delay: str = DELAY) -> DataFrame:
    """Answers (request_id, at, ...) with the memory writes (request_id, written, ...) that follow them `within` a time.

    An answer whose write doesn't come in time has nulls; where both stream, that is known when both watermarks have passed
    the interval, and state is kept no longer. Both sides may be late by `delay`. Batches give the same rows.
    """
    if answers.isStreaming:
        answers, writes = answers.withWatermark("at", delay), writes.withWatermark("written", delay)
    a, w = answers.alias("a"), writes.alias("w")
    near = (F.col("a.request_id") == F.col("w.request_id")) & (F.col("w.written") >= F.col("a.at")) & (F.col("w.written") <= F.col("a.at") + F.expr(f"INTERVAL {within}"))
    more = [F.col(f"w.{c}") for c in writes.columns if c != "request_id"]
    return a.join(w, near, "left").select("a.*", *more)


def replies(log: DataFrame) -> DataFrame:
    """Fold an event log of answers (request_id, seq, event, data) to request_id, state, text and n_events.

    Messages are joined in order; the state is that of the last of start, tool_call, tool_result, message, done and
    error. Requests without an end are `interrupted`.
    """
    states = F.create_map(*(F.lit(v) for k, s in STATES for v in (k, s)))
    held = log.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("seq", "event", "data"))).alias("log"))
    said = F.filter("log", lambda e: e["event"] == "message")
    last = states[F.element_at("log", -1)["event"]]
    state = F.when(F.exists("log", lambda e: e["event"] == "error"), "error").when(F.exists("log", lambda e: e["event"] == "done"), "done").otherwise(F.concat(F.lit("interrupted:"), F.coalesce(last, F.lit("unknown"))))
    return held.select("request_id", state.alias("state"), F.array_join(F.transform(said, lambda e: F.coalesce(e["data"], F.lit(""))), "").alias("text"), F.size("log").cast("long").alias("n_events"))


# Events of an answer and the states they lead to.
STATES = (("start", "thinking"), ("tool_call", "retrieving"), ("tool_result", "generating"), ("message", "streaming"), ("done", "done"), ("error", "error"))


def maintain_periodically(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 hour"):
    """Start a query that calls `step` with each micro-batch, such as a maintenance pass over memory records.

    Progress is kept under `checkpoint`, in a shared folder: a restarted job that names the same one goes on from there.
    """
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
