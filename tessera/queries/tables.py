"""Queries over records, sheets and JSON: events stand for memory records, order lines for sheets."""

from __future__ import annotations

from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.lexicon import ENGLISH
from tessera.operators import memory, sheets, timejoin
from tessera.queries.registry import Registry, table
from tessera.schemas import MEMORY_RECORDS
from tessera.sources import batched, deletion, rewrite
from tessera.sources import sheets as sheet_source
from tessera.storage import new_path

AS_OF = datetime(2024, 4, 1)
_registry = Registry()


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as memory records."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "profile").otherwise("event")
    held = events.select(
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("memory_id"), F.col("user_id").cast("string").alias("user_id"), kind.alias("memory_type"),
        F.col("event_type").alias("memory_key"), F.col("props").alias("content"), F.lit(None).cast("string").alias("conversation_id"), F.lit(None).cast("string").alias("session_id"),
        F.least(F.lit(100.0), F.col("value") * 2).alias("base_importance_score"), F.lit(0.0).alias("importance_score"), F.lit(0.65).alias("confidence_score"),
        (F.col("event_id") % 5).cast("int").alias("access_count"), F.lit(None).cast("timestamp").alias("last_accessed_at"),
        F.when(kind == "event", F.col("ts") + F.expr("INTERVAL 90 DAYS")).alias("expires_at"),
        F.when(F.col("event_id") % 7 == 0, "superseded").otherwise("active").alias("status"), (1 + F.col("event_id") % 3).cast("int").alias("version"),
        F.lit(None).cast("string").alias("supersedes_memory_id"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )
    return held.select(*MEMORY_RECORDS.names)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as profile candidates of one batch."""
    events = table(spark, sf_dir, "events").filter("event_type in ('purchase', 'signup', 'view')")
    none = F.lit(None).cast("string")
    return events.select(
        F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("memory_key"), F.col("props").alias("value"),
        F.when(F.col("event_id") % 11 == 0, "delete").otherwise("upsert").alias("action"), F.lit(0.7).alias("confidence"), F.lit(75.0).alias("importance"),
        none.alias("conversation_id"), none.alias("session_id"), F.col("event_id").alias("position"),
    )


_RECORDS = """
e AS (SELECT 'm' || event_id AS memory_id, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'profile' ELSE 'event' END AS memory_type,
  event_type AS memory_key, props AS content, least(100.0, value * 2) AS base, event_id % 5 AS access, ts, event_id,
  CASE WHEN event_id % 7 = 0 THEN 'superseded' ELSE 'active' END AS status, 1 + event_id % 3 AS version FROM events),
a AS (SELECT *, greatest(0, epoch(TIMESTAMP '2024-04-01') - epoch(ts)) / 86400 AS age FROM e),
s AS (SELECT *, round(greatest(0, least(100, base * 0.65 * exp(-age / CASE WHEN memory_type = 'event' THEN 90 ELSE 365 END) + least(15, 2.5 * ln(1 + access)))), 2) AS score FROM a)
"""


@_registry.add("WITH" + _RECORDS + "SELECT memory_id, CAST(score AS DOUBLE) AS score FROM s")
def memory_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("memory_id", memory.decayed_score(F.lit(AS_OF).cast("timestamp")).alias("score"))


@_registry.add(
    "WITH"
    + _RECORDS
    + """, n AS (SELECT memory_id, CASE WHEN status <> 'active' THEN status
   WHEN (memory_type = 'event' AND ts + INTERVAL 90 DAY <= TIMESTAMP '2024-04-01') OR (score < 20 AND (memory_type = 'event' OR age >= 180)) THEN 'expired' ELSE 'active' END AS status,
   status <> 'active' AND ts < TIMESTAMP '2024-04-01' - INTERVAL 30 DAY AS old FROM s)
SELECT memory_id, status FROM n WHERE NOT old"""
)
def memory_expire_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.maintain(records(spark, sf_dir), AS_OF).select("memory_id", "status")


@_registry.add(
    "WITH"
    + _RECORDS
    + ", r AS (SELECT user_id, memory_key, memory_id, row_number() OVER (PARTITION BY user_id, memory_key ORDER BY version DESC, ts DESC, memory_id) AS n FROM e WHERE status = 'active') SELECT user_id, memory_key, memory_id FROM r WHERE n = 1"
)
def profile_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.current_versions(records(spark, sf_dir)).select("user_id", "memory_key", "memory_id")


_UPSERT = """
cur AS (SELECT * FROM (SELECT user_id, memory_key, memory_id, content, version, row_number() OVER (PARTITION BY user_id, memory_key ORDER BY version DESC, ts DESC, memory_id) AS n
        FROM e WHERE status = 'active' AND memory_type = 'profile') WHERE n = 1),
given AS (SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS memory_key, props AS content, CASE WHEN event_id % 11 = 0 THEN 'delete' ELSE 'upsert' END AS action,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events WHERE event_type IN ('purchase', 'signup', 'view')) WHERE n = 1),
told AS (SELECT g.user_id, g.memory_key, g.action, c.memory_id AS old, c.version, CASE WHEN g.action = 'delete' THEN 'delete' WHEN c.memory_id IS NOT NULL AND c.content = g.content THEN 'refresh' ELSE 'new' END AS act
        FROM given g LEFT JOIN cur c USING (user_id, memory_key)),
kept AS (SELECT e.user_id, e.memory_key, CASE t.act WHEN 'delete' THEN 'deleted' WHEN 'new' THEN 'superseded' ELSE e.status END AS status, CAST(e.version AS BIGINT) AS version FROM e LEFT JOIN told t ON t.old = e.memory_id),
made AS (SELECT user_id, memory_key, 'active' AS status, CAST(coalesce(version, 0) + 1 AS BIGINT) AS version FROM told WHERE act = 'new')
"""


@_registry.add("WITH" + _RECORDS + "," + _UPSERT + "SELECT user_id, memory_key, status, version, count(*) AS n FROM (SELECT * FROM kept UNION ALL SELECT * FROM made) GROUP BY 1, 2, 3, 4")
def profile_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event of a type as a candidate against the records: numbers of records by key, state and version."""
    out = memory.upsert_profiles(records(spark, sf_dir), candidates(spark, sf_dir), AS_OF)
    return out.groupBy("user_id", "memory_key", "status", F.col("version").cast("long").alias("version")).agg(F.count("*").alias("n"))


@_registry.add(
    "WITH"
    + _RECORDS
    + """, h AS (SELECT CAST(label AS VARCHAR) AS query_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings),
j AS (SELECT h.query_id, s.memory_id, h.rank FROM h JOIN s ON s.memory_id = 'm' || h.vec_id WHERE h.rank <= 30 AND s.memory_type = 'event' AND s.status = 'active' AND ts + INTERVAL 90 DAY > TIMESTAMP '2024-03-01'),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, memory_id) AS live_rank FROM j)
SELECT query_id, memory_id, live_rank FROM r WHERE live_rank <= 10"""
)
def active_memory_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by label as hits, joined with the live records of the same number."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    hits = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("query_id"), F.concat(F.lit("m"), F.col("vec_id").cast("string")).alias("memory_id"), rank.alias("rank"))
    found = memory.live_hits(hits, records(spark, sf_dir), 10, datetime(2024, 3, 1))
    return found.select("query_id", "memory_id", F.col("live_rank").cast("long").alias("live_rank"))


@_registry.add(
    """WITH l AS (SELECT event_id % 100 AS memory, ts FROM events WHERE event_type = 'view'), n AS (SELECT 'm' || memory AS memory_id, count(*) AS n FROM l GROUP BY 1)
SELECT 'm' || event_id AS memory_id, CAST(event_id % 5 + coalesce(n, 0) AS BIGINT) AS access_count FROM events LEFT JOIN n ON n.memory_id = 'm' || event_id"""
)
def memory_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").filter("event_type = 'view'")
    log = views.select(F.concat(F.lit("m"), (F.col("event_id") % 100).cast("string")).alias("memory_id"), F.col("ts").cast("timestamp").alias("at"))
    return memory.mark_accessed(records(spark, sf_dir), log).select("memory_id", F.col("access_count").cast("long").alias("access_count"))


# Sheets


@_registry.add(
    """WITH b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS p FROM orders)
SELECT o_orderkey, last_value(nullif(p, '') IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS priority FROM b"""
)
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three priorities blanked, then filled down within a customer's orders."""
    orders = table(spark, sf_dir, "orders").withColumn("priority", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(""))
    return sheets.forward_fill(orders, ["priority"], ["o_custkey"], "o_orderkey").select("o_orderkey", "priority")


@_registry.add(
    """WITH h AS (SELECT p_brand AS sheet, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS position, CASE WHEN p_size % 10 = 0 THEN '' WHEN p_size % 10 = 1 THEN 'Unnamed: 3' ELSE p_name END AS header FROM part),
n AS (SELECT sheet, position, CASE WHEN trim(header) = '' OR lower(header) LIKE 'unnamed%' THEN '列' || (position + 1) ELSE header END AS name FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY sheet, name ORDER BY position) AS k FROM n)
SELECT sheet, position, CASE WHEN k = 1 THEN name ELSE name || '_' || k END AS name FROM k"""
)
def header_uniquify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as the headers of a sheet for each brand."""
    from pyspark.sql import Window

    position = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    header = F.when(F.col("p_size") % 10 == 0, "").when(F.col("p_size") % 10 == 1, "Unnamed: 3").otherwise(F.col("p_name"))
    held = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet"), position.alias("position"), header.alias("header"))
    return sheets.unique_headers(held).select("sheet", F.col("position").cast("long").alias("position"), "name")


_PROFILE = """
WITH c AS (SELECT 'events' AS sheet, 'kind' AS header, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS v FROM events
  UNION ALL SELECT 'events', 'amount', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT 'events', 'status', CAST(user_id AS VARCHAR) FROM events),
g AS (SELECT sheet, header, v, count(*) AS n FROM c GROUP BY 1, 2, 3),
p AS (SELECT sheet, header, sum(n) AS n_rows, sum(CASE WHEN v <> '' THEN n ELSE 0 END) AS f, sum(CASE WHEN v <> '' AND NOT regexp_full_match(v, '[0-9]+') THEN n ELSE 0 END) AS t, max(CASE WHEN v <> '' THEN n ELSE 0 END) AS m FROM g GROUP BY 1, 2)
SELECT sheet, header, CAST(n_rows AS BIGINT) AS n_rows, round(CAST(t AS DOUBLE) / f, 6) AS text_ratio, round(CAST(n_rows - f AS DOUBLE) / n_rows, 6) AS blank_ratio, round(CAST(m AS DOUBLE) / f, 6) AS repeated_ratio,
  CASE header WHEN 'amount' THEN false WHEN 'status' THEN true ELSE f >= 2 AND t / f >= 0.7 AND (n_rows - f) / n_rows >= 0.25 AND m / f >= 0.25 END AS fill FROM p"""


@_registry.add(_PROFILE)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns of events in long form; two of them are decided by their names."""
    events = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    kinds = F.array(
        F.struct(F.lit("kind").alias("header"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("").alias("value")),
        F.struct(F.lit("amount").alias("header"), user.alias("value")),
        F.struct(F.lit("status").alias("header"), user.alias("value")),
    )
    cells = events.select(F.lit("events").alias("sheet"), F.col("event_id").alias("row_no"), F.inline(kinds))
    found = sheets.profile_columns(cells, ENGLISH)
    return found.select("sheet", "header", "n_rows", *(F.round(c, 6).alias(c) for c in ("text_ratio", "blank_ratio", "repeated_ratio")), "fill")


@_registry.add(rf"""
WITH k AS (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS sheet FROM supplier),
r AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS sheet, CAST(s_suppkey AS INTEGER) AS row_no, [s_name, CAST(s_acctbal AS VARCHAR)] AS cells FROM supplier
  UNION ALL SELECT sheet, -2, ['Suppliers', ''] FROM k
  UNION ALL SELECT sheet, -1, ['name', 'balance'] FROM k),
v AS (SELECT sheet, row_no, list_filter(list_transform(cells, lambda c: trim(coalesce(c, ''))), lambda c: c <> '') AS v FROM r),
w AS (
  SELECT sheet, row_no, len(v) AS width, len(list_distinct(list_transform(v, lambda c: lower(c)))) AS n_distinct,
         len(list_filter(v, lambda c: NOT regexp_matches(replace(trim(c), ',', ''), '{sheets.NUMBER}'))) AS n_text FROM v),
l AS (
  SELECT *, greatest(2, floor(width * 0.5)) AS least_width, max(width) OVER (PARTITION BY sheet) AS widest,
         coalesce(lead(width, 1) OVER b, 0) AS w1, coalesce(lead(width, 2) OVER b, 0) AS w2, coalesce(lead(width, 3) OVER b, 0) AS w3
  FROM w WINDOW b AS (PARTITION BY sheet ORDER BY row_no)),
s AS (
  SELECT sheet, row_no, width, CASE WHEN width >= 2 THEN round(
         2.0 * width + 3.0 * n_distinct / width + 3.0 * n_text / width
         + 2.0 * (CAST(w1 >= least_width AS INTEGER) + CAST(w2 >= least_width AS INTEGER) + CAST(w3 >= least_width AS INTEGER))
         + CASE WHEN width >= greatest(2, floor(widest * 0.5)) THEN 4.0 ELSE 0.0 END, 9) END AS score FROM l WHERE width > 0)
SELECT sheet, row_no AS header_row FROM s
QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY score DESC NULLS LAST, CASE WHEN score IS NULL THEN 0 ELSE width END DESC, row_no) = 1""")
def header_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sheets of their suppliers, each below a title and a header."""
    s = table(spark, sf_dir, "supplier")
    body = s.select(F.col("s_nationkey").cast("string").alias("sheet"), F.col("s_suppkey").cast("int").alias("row_no"), F.array("s_name", F.col("s_acctbal").cast("string")).alias("cells"))
    names = body.select("sheet").distinct()
    title = names.select("sheet", F.lit(-2).alias("row_no"), F.array(F.lit("Suppliers"), F.lit("")).alias("cells"))
    header = names.select("sheet", F.lit(-1).alias("row_no"), F.array(F.lit("name"), F.lit("balance")).alias("cells"))
    return sheets.infer_header(body.union(title).union(header))


@_registry.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# Rewrites


@_registry.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without those labelled toxic."""
    return rewrite.delete_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("toxic = 1"), ["doc_id"]).select("doc_id")


@_registry.add("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'labelled' END AS source FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    new = table(spark, sf_dir, "labels").select("doc_id", F.lit("labelled").alias("source")).distinct()
    return rewrite.replace_keys(docs, new, ["doc_id"])


@_registry.add("SELECT d.doc_id, coalesce(CAST(l.quality AS BIGINT), d.n_chars) AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def update_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return rewrite.update_fields(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("n_chars")), ["doc_id"])


@_registry.add(
    """WITH r AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT l.event_id, coalesce(r.event_id, -1) AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'error') l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts"""
)
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with its user's last purchase until then."""
    events = table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return timejoin.as_of(events.filter("event_type = 'error'"), bought, ["user_id"], "ts", "ts", ["last_purchase"], "last_purchase").select("event_id", F.coalesce("last_purchase", F.lit(-1)).alias("last_purchase"))


@_registry.add(
    """SELECT l.event_id, coalesce(r.event_id, -1) AS purchase, coalesce(r.value, -1.0) AS value FROM (SELECT * FROM events WHERE event_type = 'click') l
LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND r.ts BETWEEN l.ts - INTERVAL 30 MINUTE AND l.ts + INTERVAL 2 HOUR"""
)
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with their user's purchases from half an hour before to two hours after."""
    events = table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"), "value")
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    return timejoin.interval_join(clicks, bought, ["user_id"], "ts", "ts", 1800, 7200, ["purchase", "value"], "left").select("event_id", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("purchase", "value")))


@_registry.add("SELECT doc_id, source, CAST(length(text) AS BIGINT) AS n FROM documents")
def batched_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the batched sink into a folder store, and read back."""
    path = new_path(spark, "store")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    batched.insert_rows(rows, partial(batched.FolderStore, path), batch=500)
    return batched.read_store(spark, path, rows.schema).select("doc_id", "source", F.length("text").cast("long").alias("n"))


@_registry.add(
    """SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 7 = 0 AND doc_id % 2 = 0 THEN 'ready' ELSE 'processing' END AS status,
  CASE WHEN doc_id % 7 = 0 AND doc_id % 2 = 0 THEN '删除失败: even numbers stay' END AS message, CAST(1 AS BIGINT) AS n_chunks FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 3 = 0 OR doc_id % 14 = 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'ready', NULL, 1 FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 3 <> 0"""
)
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletion by the journal: documents of every seventh number are asked for, in two requests; the even ones' files can't go."""
    docs = table(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string")
    status = F.when((F.col("doc_id") % 7 != 0) & (F.col("doc_id") % 3 == 0), "processing").otherwise("ready")
    held = docs.select(name.alias("document_id"), status.alias("status"), F.lit(None).cast("string").alias("error_message"), F.concat(F.lit("/files/"), name).alias("stored_path"))
    base = new_path(spark, "deletion")
    gone: list[DataFrame] = []

    def no_file(due: DataFrame) -> None:
        if due.filter(F.col("document_id").cast("long") % 2 == 0).limit(1).count():
            raise RuntimeError("even numbers stay")

    for even in (False, True):
        job = deletion.Deletion(f"{base}/journal", lambda due: None if even else gone.append(due), no_file)
        job.request(held, held.filter((F.col("document_id").cast("long") % 7 == 0) & ((F.col("document_id").cast("long") % 2 == 0) == F.lit(even))), AS_OF)
        job.run(held, AS_OF)
    chunks = held.select("document_id")
    for due in gone:
        chunks = rewrite.delete_keys(chunks, due, ["document_id"])
    left = job.table(held).join(chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks")), "document_id", "left")
    return left.select("document_id", "status", F.col("error_message").alias("message"), "n_chunks")


@_registry.add()
def sheet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sheets of a user's workbook, one for each type: header, blanks to be filled down, and rows, as texts."""
    events = table(spark, sf_dir, "events")
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    number = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    cells = F.array(F.when(F.col("n") % 3 == 1, kind).otherwise(""), F.col("event_id").cast("string"), F.col("value").cast("string"), F.get_json_object("props", "$.k"))
    row = F.struct(F.col("n").cast("long").alias("row_no"), F.transform(cells, lambda c: F.coalesce(c, F.lit(""))).alias("cells"))
    head = F.struct(F.lit(0).cast("long").alias("row_no"), F.array(*(F.lit(c) for c in ("类型", "id", "value", ""))).alias("cells"))
    rows = events.withColumn("n", number).select(user.alias("document_id"), kind.alias("sheet"), F.inline(F.when(F.col("n") == 1, F.array(head, row)).otherwise(F.array(row))))
    held = rows.select("document_id", F.lit("events.xlsx").alias("source_name"), (F.crc32("sheet") % 1_000_000_007).cast("int").alias("sheet_no"), "sheet", "row_no", "cells", F.lit(None).cast("string").alias("error"))
    return sheet_source.sheet_texts(held)


QUERIES, ORACLES = _registry.queries, _registry.oracles
