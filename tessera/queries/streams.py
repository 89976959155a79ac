"""Queries over the event stream: each streams the whole table to its end, and SQL over the batch says the same."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.queries import tables
from tessera.queries.registry import Registry, table
from tessera.storage import new_path
from tessera.streaming import events as E
from tessera.streaming import framing
from tessera.streaming import memory as S

_registry = Registry()
_TIME = "yyyy-MM-dd HH:mm:ss"
#: Events of answers that events of the table stand for.
_NAMES = (("signup", "start"), ("click", "tool_call"), ("view", "message"), ("purchase", "done"), ("error", "error"))


def _shown(df: DataFrame, *times: str) -> DataFrame:
    return df.withColumns({t: F.date_format(t, _TIME) for t in times})


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.read_events(spark, f"{sf_dir}/events.parquet")


@_registry.add(
    "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(E.run_to_end(E.tumbling(_events(spark, sf_dir))), "window_start")


@_registry.add(
    """WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS s, event_type, value FROM events, range(4) r(i))
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2"""
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(E.run_to_end(E.sliding(_events(spark, sf_dir))), "window_start")


_SESSIONS = """WITH l AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gone FROM events),
n AS (SELECT *, sum(CASE WHEN gone {} 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM l)
"""


@_registry.add(
    _SESSIONS.format(">") + "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n, round(sum(value), 4) AS total FROM n GROUP BY user_id, no"
)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(E.run_to_end(E.sessions(_events(spark, sf_dir))), "session_start")


@_registry.add(
    _SESSIONS.format(">=") + "SELECT user_id, CAST(no AS BIGINT) AS session_no, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n FROM n GROUP BY user_id, no"
)
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.idle_sessions(table(spark, sf_dir, "events"))
    return _shown(found.withColumn("session_no", F.col("session_no").cast("long")), "started", "ended")


@_registry.add("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream joined with itself twice over, then freed of repeats."""
    twice = _events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return E.run_to_end(E.without_repeats(twice, ["event_id"]).select("event_id", "user_id", "event_type"), "append")


@_registry.add("SELECT event_id, c_mktsegment AS segment FROM events LEFT JOIN customer ON user_id = c_custkey")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return E.run_to_end(E.enrich(_events(spark, sf_dir), customers, "user_id").select("event_id", "segment"), "append")


@_registry.add(
    """WITH g AS (SELECT user_id, count(*) AS n_events, bool_or(event_type = 'error') AS failed, bool_or(event_type = 'purchase') AS done,
  arg_max(event_type, event_id) AS last FROM events GROUP BY 1)
SELECT user_id AS request_id, CASE WHEN failed THEN 'error' WHEN done THEN 'done' ELSE 'interrupted:' || CASE last WHEN 'signup' THEN 'thinking' WHEN 'click' THEN 'retrieving' ELSE 'streaming' END END AS state, n_events FROM g"""
)
def reply_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as logs of answers, folded to their states."""
    names = F.create_map(*(F.lit(v) for p in _NAMES for v in p))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), names[F.col("event_type")].alias("event"), F.lit("").alias("data"))
    return E.replies(log).select("request_id", "state", "n_events")




@_registry.add(
    """WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type, props FROM events),
n AS (SELECT user_id, count(*) AS seq FROM events GROUP BY 1 HAVING NOT bool_or(event_type = 'purchase'))
SELECT CAST(user_id AS VARCHAR) AS request_id, CAST(seq AS BIGINT) AS seq, CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'tool_call' WHEN 'view' THEN 'message'
  WHEN 'purchase' THEN 'done' ELSE 'error' END AS event, trim(props) AS data FROM l
UNION ALL SELECT CAST(user_id AS VARCHAR), CAST(seq AS BIGINT), 'done', '{}' FROM n"""
)
def stream_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as bodies of answers, cut into chunks of a few bytes, dealt over micro-batches and put together again."""
    names = F.create_map(*(F.lit(v) for p in _NAMES for v in p))
    events = table(spark, sf_dir, "events")
    log = events.select(F.col("user_id").cast("string").alias("request_id"), F.col("event_id").alias("seq"), names[F.col("event_type")].alias("event"), F.col("props").alias("data"))
    chunks = framing.cut(framing.rendered(log), 40 + F.crc32("request_id") % 60)
    path = new_path(spark, "chunks")
    files = 1 + events.count() // 500_000  # of each of three micro-batches
    chunks.repartition(3 * files, F.xxhash64("request_id", "number")).write.parquet(path)
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", files).parquet(path)
    return E.run_stateful(framing.reassemble(stream))


@_registry.add(
    """SELECT a.event_id, coalesce(w.event_id, -1) AS write_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a
LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') w ON a.user_id = w.user_id AND w.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOUR"""
)
def stream_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as answers and views as memory writes: an outer join of two streams; a tick on either side ends them."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    later = F.lit(datetime(2100, 1, 1)).cast("timestamp")

    def stream(kind: str, time: str, name: str) -> DataFrame:
        rows = events.filter(F.col("event_type") == kind).select(F.col("user_id").alias("request_id"), F.col("ts").alias(time), F.col("event_id").alias(name))
        # No request has this number; a filter that drops the tick could be pushed below the watermark.
        tick = spark.range(1).select(F.lit(-1 if time == "at" else -2).cast("long").alias("request_id"), later.alias(time), F.lit(-1).cast("long").alias(name))
        path = new_path(spark, kind)
        rows.write.parquet(path)
        tick.write.mode("append").parquet(path)
        return spark.readStream.schema(rows.schema).parquet(path)

    joined = E.with_writes(stream("purchase", "at", "event_id"), stream("view", "written", "write_id"), "2 HOURS")
    return E.run_to_end(joined.select("event_id", F.coalesce("write_id", F.lit(-1)).alias("write_id")), "append").filter("event_id >= 0")


def _streamed(spark: SparkSession, changes: DataFrame, **options) -> DataFrame:
    """The records that a stream of these changes ends with; a last tick lets the watermark pass them all."""
    path = new_path(spark, "changes")
    changes.unionByName(S.tick(spark, changes, tables.AS_OF + timedelta(days=9))).write.parquet(path)
    stream = spark.readStream.schema(changes.schema).parquet(path)
    return S.end_state(S.run(stream, "3 days", **options))


@_registry.add(tables.ORACLES["profile_upsert"])
def stream_profile_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`profile_upsert` as a stateful stream."""
    changes = S.record_changes(tables.records(spark, sf_dir), tables.AS_OF - timedelta(days=1))
    out = _streamed(spark, changes.unionByName(S.candidate_changes(tables.candidates(spark, sf_dir), tables.AS_OF)))
    return out.groupBy("user_id", "memory_key", "status", F.col("version").cast("long").alias("version")).agg(F.count("*").alias("n"))


@_registry.add(tables.ORACLES["memory_expire_purge"])
def stream_memory_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`memory_expire_purge` by the timers of a stateful stream."""
    changes = S.record_changes(tables.records(spark, sf_dir), tables.AS_OF - timedelta(days=1))
    return _streamed(spark, changes, first=tables.AS_OF).select("memory_id", "status")


QUERIES, ORACLES = _registry.queries, _registry.oracles
