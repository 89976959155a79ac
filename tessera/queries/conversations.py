"""Conversation queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.functions import text as X
from tessera.lexicon import ENGLISH
from tessera.operators import conversations as C
from tessera.operators import memory
from tessera.plans import memory as plan
from tessera.queries.registry import Registry, table
from tessera.schemas import MEMORY_RECORDS

_registry = Registry()

_CLEAN = r"""
c AS (SELECT conv_id, turn, lower(trim(role)) AS role, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text FROM conversations),
m AS (SELECT * FROM c WHERE role IN ('user', 'assistant') AND text <> ''),
b AS (SELECT *, CASE WHEN role = 'user' OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 1 ELSE 0 END AS begins FROM m),
t AS (SELECT conv_id, turn, role, text, CAST(sum(begins) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS turn_no FROM b),
last AS (SELECT conv_id, max(turn_no) AS last FROM t GROUP BY 1)
"""


@_registry.add("WITH" + _CLEAN + "SELECT conv_id, turn, role, turn_no FROM t")
def turn_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.segment_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "turn_no")


@_registry.add(
    "WITH" + _CLEAN + "SELECT conv_id, turn, role FROM t JOIN last USING (conv_id) WHERE turn_no > last - 2 UNION ALL SELECT conv_id, turn, role FROM c WHERE role = 'system' AND text <> ''"
)
def last_n_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.last_turns(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role")


@_registry.add("WITH" + _CLEAN + "SELECT conv_id, turn, CAST(floor(turn_no / 2) AS BIGINT) AS batch FROM t JOIN last USING (conv_id) WHERE turn_no <= last - 1")
def turn_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.older_batches(table(spark, sf_dir, "conversations"), 1, 3).select("conv_id", "turn", "batch")


@_registry.add(
    "WITH" + _CLEAN + ", n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, turn, role, md5(text) AS text_md5 FROM m JOIN n USING (conv_id, turn) WHERE n > 2"
)
def history_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.history(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@_registry.add(r"""
WITH c AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS text FROM conversations),
g AS (SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS f, arg_max(text, turn) AS l, max(turn) AS last_turn FROM c GROUP BY 1)
SELECT conv_id, n_user, CASE WHEN len(f) > 34 THEN substr(f, 1, 34) || '…' ELSE f END AS title, CASE WHEN len(l) > 46 THEN substr(l, 1, 46) || '…' ELSE l END AS preview, last_turn FROM g""")
def conversation_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overview(table(spark, sf_dir, "conversations"))


@_registry.add(
    "WITH" + _CLEAN + ", u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM m WHERE role = 'user') SELECT conv_id, md5(string_agg(text, '|' ORDER BY turn)) AS questions_md5 FROM u WHERE n <= 4 GROUP BY 1"
)
def recent_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recent_questions(table(spark, sf_dir, "conversations")).select("conv_id", F.md5(F.array_join("questions", "|")).alias("questions_md5"))


@_registry.add(
    "WITH" + _CLEAN + r""", n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n FROM m),
i AS (
  SELECT *, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^(?:[-*+]|\d+[.、)])\s+')), lambda x: regexp_replace(x, '^(?:[-*+]|\d+[.、)])\s+', '')) AS items,
         list_filter(list_transform(regexp_split_to_array(text, '[。！？!?\n]+|\.\s'), lambda x: trim(x)), lambda x: x <> '') AS sentences FROM n WHERE n <= 4),
h AS (SELECT *, list_transform((CASE WHEN len(items) > 0 THEN items ELSE sentences END)[1:2], lambda x: CASE WHEN len(x) > 90 THEN substr(x, 1, 90) || '…' ELSE x END) AS told FROM i),
g AS (
  SELECT conv_id, coalesce(string_agg(text, '|' ORDER BY turn) FILTER (role = 'user'), '') AS q,
         coalesce(array_to_string(flatten(list(told ORDER BY turn) FILTER (role = 'assistant'))[1:6], '|'), '') AS a FROM h GROUP BY 1)
SELECT conv_id, last + 1 AS n_turns, md5(q) AS questions_md5, md5(a) AS highlights_md5 FROM g JOIN last USING (conv_id)"""
)
def conversation_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = (F.md5(F.array_join(c, "|")).alias(f"{c}_md5") for c in ("questions", "highlights"))
    return C.summaries(table(spark, sf_dir, "conversations")).select("conv_id", "n_turns", *lists)


@_registry.add(
    "WITH" + _CLEAN + """, o AS (SELECT conv_id, turn_no, string_agg(CASE role WHEN 'user' THEN '用户' ELSE '助手' END || ': ' || text, chr(10) ORDER BY turn) AS x FROM t GROUP BY 1, 2)
SELECT conv_id, count(*) AS n_turns, md5(string_agg(x, chr(10) || chr(10) ORDER BY turn_no)) AS transcript_md5 FROM o GROUP BY 1"""
)
def transcript_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.transcripts(table(spark, sf_dir, "conversations")).select("conv_id", "n_turns", F.md5("transcript").alias("transcript_md5"))


@_registry.add()
def memory_chunks_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.memory_chunks(table(spark, sf_dir, "conversations"))


@_registry.add()
def sql_memory_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`memory_chunks_greedy` by a table function, from SQL text."""
    tables.register(spark)
    return spark.sql("SELECT * FROM memory_chunks(TABLE(SELECT * FROM {rows}) PARTITION BY conv_id ORDER BY turn)", rows=table(spark, sf_dir, "conversations"))


def _changes(held: str, turn: str) -> bool:
    return held[4:5].lower() != turn[4:5].lower()


def _opening(text: str) -> dict:
    return {"topic": text[4:24], "summary": text[4:84]}


@_registry.add()
def sql_semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`semantic_memory_chunks` by a table function, from SQL text."""
    tables.register(spark, _changes, _opening)
    return spark.sql("SELECT * FROM semantic_chunks(TABLE(SELECT * FROM {rows}) PARTITION BY conv_id ORDER BY turn, token_limit => 200)", rows=table(spark, sf_dir, "conversations"))


@_registry.add()
def semantic_memory_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories by topic, where a topic changes when two turns begin with different letters, and a summary is an opening."""
    return C.semantic_chunks(table(spark, sf_dir, "conversations"), _changes, _opening, 200)


_COUNT = " + ".join(f"(len(x) - len(replace(x, '{m}', ''))) / {len(m)}" for m in ENGLISH.strong_markers)
_PASSING = " + ".join(f"(len(x) - len(replace(x, '{m}', ''))) / {len(m)}" for m in ENGLISH.temporary_markers)


@_registry.add(rf"""
WITH c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^ | $', '', 'g') AS x FROM conversations)
SELECT conv_id, turn, CAST(greatest(0.0, least(100.0, 45.0 + least(25.0, 5.0 * CAST({_COUNT} AS INTEGER)) - least(20.0, 4.0 * CAST({_PASSING} AS INTEGER)))) AS DOUBLE) AS importance,
       CAST(CASE WHEN len(x) < 20 THEN 0.55 ELSE 0.65 END AS DOUBLE) AS confidence FROM c""")
def event_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    importance, confidence = memory.event_importance(F.col("text"), ENGLISH)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", importance.alias("importance"), confidence.alias("confidence"))


_WHOLE = (
    "WITH" + _CLEAN + r""", u AS (SELECT conv_id, turn_no, string_agg(CASE role WHEN 'user' THEN '用户' ELSE '助手' END || ': ' || text, chr(10) ORDER BY turn) AS said,
  string_agg(CASE role WHEN 'user' THEN '用户' ELSE '助手' END || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS apart FROM t GROUP BY 1, 2),
w AS (SELECT conv_id, string_agg({said}, chr(10) || chr(10) ORDER BY turn_no) AS whole FROM u GROUP BY 1),
y AS (SELECT conv_id, {text} AS told FROM w),
z AS (SELECT conv_id, regexp_replace(regexp_replace(told, '\s+', ' ', 'g'), '^ | $', '', 'g') AS x FROM y)
SELECT 'u' || conv_id % 7 AS user_id, 'event:u' || conv_id % 7 || ':' || conv_id || ':' || {part} AS memory_key, x AS content, 'active' AS status,
  CAST(greatest(0.0, least(100.0, 45.0 + least(25.0, 5.0 * CAST({_COUNT} AS INTEGER)) - least(20.0, 4.0 * CAST({_PASSING} AS INTEGER)))) AS DOUBLE) AS importance FROM z"""
)


def _whole(said: str, text: str, part: str) -> str:
    return _WHOLE.replace("{said}", said).replace("{text}", text).replace("{part}", part).replace("{_COUNT}", _COUNT).replace("{_PASSING}", _PASSING)


def _owned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations, their owners (seven users), and no records yet."""
    held = table(spark, sf_dir, "conversations")
    owners = held.select("conv_id").distinct().select("conv_id", F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")).alias("user_id"), F.lit("s").alias("session_id"))
    return held, owners, spark.createDataFrame([], MEMORY_RECORDS)


def _told(records: DataFrame) -> DataFrame:
    return records.select("user_id", "memory_key", "content", "status", F.col("base_importance_score").alias("importance"))


@_registry.add(_whole("apart", "whole", "'u' || conv_id % 7 || ':' || conv_id || ':0:v'"))
def store_conversation_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations chunked (a chunk each), embedded and registered: the records."""
    held, owners, records = _owned(spark, sf_dir)
    return _told(plan.store_conversations(held, owners, records, datetime(2024, 5, 1), size=10**9, lexicon=ENGLISH, version="v")[1])


@_registry.add(_whole("said", "'【主题】t' || chr(10) || '【摘要】s' || chr(10) || '【原文】' || chr(10) || whole", "'0'"))
def store_topic_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one topic each, summarised, embedded and registered: the records."""
    held, owners, records = _owned(spark, sf_dir)
    topics = plan.store_topics(held, owners, records, datetime(2024, 5, 1), lambda a, b: False, lambda t: ("t", "s"), short_window=0, limit=10**9, lexicon=ENGLISH, version="v")
    return _told(topics[1])


@_registry.add(r"SELECT conv_id, turn, CAST(CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9_]+'))) ELSE 0 END AS BIGINT) AS n FROM conversations")
def message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.estimated_tokens(F.col("text")).cast("long").alias("n"))


_MEMORIES = "m AS (SELECT CAST(conv_id % 7 AS VARCHAR) AS user_id, CAST(conv_id AS VARCHAR) AS conversation_id, role AS chunk_type, conv_id || ':' || turn AS memory_id FROM conversations)"


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message as a memory of one of seven users."""
    rows = table(spark, sf_dir, "conversations")
    conv = F.col("conv_id").cast("string")
    return rows.select((F.col("conv_id") % 7).cast("string").alias("user_id"), conv.alias("conversation_id"), F.col("role").alias("chunk_type"), F.concat_ws(":", conv, F.col("turn").cast("string")).alias("memory_id"))


@_registry.add("WITH " + _MEMORIES + " SELECT * FROM m WHERE user_id = '3' AND chunk_type = 'assistant'")
def memory_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.memory_filter(_memories(spark, sf_dir), "3", chunk_type="assistant")


@_registry.add("WITH " + _MEMORIES + " SELECT * FROM m WHERE NOT coalesce(user_id = '3' AND conversation_id IN ('3', '10'), FALSE)")
def memory_vectors_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories without those of two conversations of one user."""
    return memory.delete_vectors(memory.delete_vectors(_memories(spark, sf_dir), "3", "3"), "3", "10")


@_registry.add(
    "WITH c AS (SELECT conv_id, turn, lower(trim(role)) AS role, text FROM conversations) "
    "SELECT conv_id || ':' || turn AS chunk, conv_id % 3 || ':' || conv_id || ':' || turn || ':v1' AS memory_id, CASE WHEN role = 'user' THEN 'asked' ELSE 'told' END AS topic, md5(text) AS text_md5 FROM c WHERE regexp_matches(text, '\\S') AND conv_id % 3 > 0"
)
def memory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message as a chunk to be stored, of conversations that have a user."""
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("turn", "chunk_index")
    topic = F.when(F.lower(F.trim("role")) == "user", "asked").otherwise("  ")
    chunks = rows.withColumns({"topic": topic, "turn_start": F.col("chunk_index"), "turn_end": F.col("chunk_index")})
    user = F.when(F.col("conv_id") % 3 > 0, (F.col("conv_id") % 3).cast("string"))
    owners = rows.select("conv_id").distinct().select("conv_id", user.alias("user_id"), F.lit(None).cast("string").alias("session_id"))
    out = plan.memory_rows(chunks, owners, datetime(2024, 1, 1), topic="told", version="v1")
    return out.select(F.concat_ws(":", "conversation_id", F.col("chunk_index").cast("string")).alias("chunk"), "memory_id", "topic", F.md5("text").alias("text_md5"))


QUERIES, ORACLES = _registry.queries, _registry.oracles
