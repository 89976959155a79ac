"""Memory records: importance, decay, expiry, versions and access, as rewrites of a table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.lexicon import CHINESE, Lexicon
from tessera.schemas import MEMORY_RECORDS, require_columns

# Scores, time constants and key patterns of memory records.
THRESHOLD, STALE_DAYS, RETENTION_DAYS, EXPIRY_DAYS = 20.0, 180, 30, 90
EVENT_DAYS, PROFILE_DAYS, MOST_BONUS, BONUS = 90.0, 365.0, 15.0, 2.5
MOST_VALUE = 4000
PROFILE_KEY = r"^[a-z][a-z0-9_.-]{1,127}$"


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), "^ | $", "")


def event_importance(content: Column, lexicon: Lexicon = CHINESE) -> tuple[Column, Column]:
    """(importance, confidence) of an event's text: 45, up to 25 more for strong words, up to 20 less for passing ones."""
    text = squeezed(content)
    strong = F.least(F.lit(25.0), 5.0 * X.count_occurrences(text, lexicon.strong_markers))
    passing = F.least(F.lit(20.0), 4.0 * X.count_occurrences(text, lexicon.temporary_markers))
    importance = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 45.0 + strong - passing))
    return importance, F.when(F.length(text) < 20, 0.55).otherwise(0.65)


def decayed_score(as_of: Column) -> Column:
    """The score at a time: base x confidence, fading with the days since the last access, and a bonus for accesses."""
    age = F.greatest(F.lit(0.0), (as_of.cast("double") - F.coalesce("last_accessed_at", "created_at", as_of).cast("double")) / 86400)
    fading = F.when(F.col("memory_type") == "event", EVENT_DAYS).otherwise(PROFILE_DAYS)
    bonus = F.least(F.lit(MOST_BONUS), BONUS * F.log1p(F.greatest(F.col("access_count"), F.lit(0))))
    score = F.col("base_importance_score") * F.col("confidence_score") * F.exp(-age / fading) + bonus
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2)


def maintain(records: DataFrame, as_of: datetime | Column) -> DataFrame:
    """One maintenance pass: rescore active records, expire stale ones, purge old ones that aren't active.

    An active record expires when its time is up, or when its score is under 20 and it is an event or at least 180
    days old. Records that were not active before and haven't changed for 30 days are left out.
    """
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    age = F.greatest(F.lit(0.0), (now.cast("double") - F.coalesce("last_accessed_at", "created_at", now).cast("double")) / 86400)
    active = F.col("status") == "active"
    held = records.withColumn("importance_score", F.when(active, decayed_score(now)).otherwise(F.col("importance_score")))
    weak = (F.col("importance_score") < THRESHOLD) & ((F.col("memory_type") == "event") | (age >= STALE_DAYS))
    over = F.coalesce(F.col("expires_at") <= now, F.lit(False)) | weak
    held = held.withColumns(
        {"updated_at": F.when(active, now).otherwise(F.col("updated_at")), "status": F.when(active & over, "expired").otherwise(F.col("status"))}
    )
    old = (F.col("status") != "active") & F.coalesce(F.col("updated_at") < now - F.expr(f"INTERVAL {RETENTION_DAYS} DAYS"), F.lit(False))
    return held.filter(~old)


def current_versions(records: DataFrame, memory_type: str | None = None) -> DataFrame:
    """The newest active record of each (user, key): by version, then by change, then by id."""
    kept = records.filter("status = 'active'")
    kept = kept.filter(F.col("memory_type") == memory_type) if memory_type else kept
    best = Window.partitionBy("user_id", "memory_key").orderBy(F.desc("version"), F.desc("updated_at"), "memory_id")
    return kept.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def _versioned(records: DataFrame, given: DataFrame, memory_type: str, now: Column, in_place: bool) -> DataFrame:
    """Old records with their new states, and new versions; `given` has one row for each (user_id, memory_key)."""
    current = current_versions(records, memory_type).select("user_id", "memory_key", F.col("memory_id").alias("_old"), F.col("version").alias("_version"), F.col("content").alias("_content"))
    told = given.join(current, ["user_id", "memory_key"], "left")
    same = F.col("_old").isNotNull() & (squeezed(F.col("_content")) == F.col("content")) if in_place else F.lit(False)
    told = told.withColumn("_act", F.when(F.col("action") == "delete", "delete").when(same, "refresh").otherwise("new"))
    change = told.filter("_old is not null").select(
        F.col("_old").alias("memory_id"), "_act", *(F.col(c).alias(f"_{c}") for c in ("base_importance_score", "confidence_score"))
    )
    out = records.join(change, "memory_id", "left")
    touched, fresh = F.col("_act").isNotNull(), F.col("_act") == "refresh"
    out = out.withColumns(
        {
            "status": F.when(F.col("_act") == "delete", "deleted").when(F.col("_act") == "new", "superseded").otherwise(F.col("status")),
            "base_importance_score": F.when(fresh, F.col("_base_importance_score")).otherwise(F.col("base_importance_score")),
            "importance_score": F.when(fresh, F.col("_base_importance_score")).otherwise(F.col("importance_score")),
            "confidence_score": F.when(fresh, F.col("_confidence_score")).otherwise(F.col("confidence_score")),
            "last_accessed_at": F.when(fresh, now).otherwise(F.col("last_accessed_at")),
            "updated_at": F.when(touched, now).otherwise(F.col("updated_at")),
        }
    ).select(*MEMORY_RECORDS.names)
    new = told.filter("_act = 'new'").select(
        "memory_id", "user_id", F.lit(memory_type).alias("memory_type"), "memory_key", "content", "conversation_id", "session_id",
        "base_importance_score", F.col("base_importance_score").alias("importance_score"), "confidence_score", F.lit(0).alias("access_count"),
        F.lit(None).cast("timestamp").alias("last_accessed_at"), "expires_at", F.lit("active").alias("status"),
        (F.coalesce("_version", F.lit(0)) + 1).alias("version"), F.col("_old").alias("supersedes_memory_id"), now.alias("created_at"), now.alias("updated_at"),
    )
    return out.unionByName(new)


def prepared_profiles(candidates: DataFrame, now: Column) -> DataFrame:
    """Profile candidates as they are compared and stored: keys and actions in lower case, texts squeezed, numbers clamped,
    and the id of the record that each would make. Candidates without user, valid key or, unless deleting, value are left out.
    """
    given = candidates.select(
        "user_id", F.lower(F.trim("memory_key")).alias("memory_key"), squeezed(F.col("value")).alias("content"),
        F.lower(F.trim(F.coalesce("action", F.lit("upsert")))).alias("action"), "conversation_id", "session_id", "position",
        X.clamp(F.col("importance"), 0.0, 100.0, 75.0).alias("base_importance_score"), X.clamp(F.col("confidence"), 0.0, 1.0, 0.7).alias("confidence_score"),
        now.alias("_now"),
    )
    given = given.filter(F.col("memory_key").rlike(PROFILE_KEY) & ((F.col("action") == "delete") | (F.col("content") != "")) & (F.coalesce("user_id", F.lit("")) != ""))
    name = F.sha2(F.concat_ws("\x1f", "user_id", "memory_key", "content", F.col("_now").cast("string")), 256)
    return given.withColumn("memory_id", F.concat_ws(":", F.lit("profile"), "user_id", "memory_key", F.substring(name, 1, 32))).drop("_now")


def upsert_profiles(records: DataFrame, candidates: DataFrame, as_of: datetime) -> DataFrame:
    """Versioned upsert of profile facts: the table after it.

    `candidates`: user_id, memory_key, value, action, confidence, importance, conversation_id, session_id and
    position in the batch. Keys must look like `profile.name`; blank values are left out unless deleting. The same
    value refreshes the scores, another one supersedes the record by a new version, `delete` marks it deleted.
    Of a key's candidates in a batch the last counts, so that never two records of a key are active.
    """
    require_columns(records, MEMORY_RECORDS.names)
    now = F.lit(as_of).cast("timestamp")
    given = prepared_profiles(candidates, now)
    others = [c for c in given.columns if c not in ("user_id", "memory_key", "position")]
    last = given.groupBy("user_id", "memory_key").agg(F.max(F.struct("position", *others)).alias("c")).select("user_id", "memory_key", "c.*")
    last = last.withColumn("expires_at", F.lit(None).cast("timestamp"))
    return _versioned(records, last, "profile", now, in_place=True)


def register_events(records: DataFrame, rows: DataFrame, as_of: datetime, lexicon: Lexicon = CHINESE) -> DataFrame:
    """Lifecycle records for stored memory chunks: the table after it.

    `rows`: memory_id, user_id, text, conversation_id, session_id, chunk_type, chunk_index. Dialogue chunks have a
    key of their own; others are keyed by conversation and chunk number, so storing them again supersedes them.
    """
    now = F.lit(as_of).cast("timestamp")
    base, sure = event_importance(F.col("content"), lexicon)
    given = rows.withColumn("content", squeezed(F.col("text"))).filter((F.col("content") != "") & (F.coalesce(F.trim("memory_id"), F.lit("")) != ""))
    part = F.when(F.col("chunk_type") == "dialogue", F.col("memory_id")).otherwise(F.coalesce(F.col("chunk_index").cast("string"), "memory_id"))
    key = F.concat_ws(":", F.lit("event"), F.col("user_id"), F.coalesce(F.nullif(F.trim("conversation_id"), F.lit("")), F.lit("unknown")), part)
    given = given.withColumns({"memory_key": key, "base_importance_score": base, "confidence_score": sure, "action": F.lit("upsert"), "expires_at": now + F.expr(f"INTERVAL {EXPIRY_DAYS} DAYS")})
    columns = ["memory_id", "content", "conversation_id", "session_id", "base_importance_score", "confidence_score", "action", "expires_at"]
    last = given.groupBy("user_id", "memory_key").agg(F.max(F.struct(*columns)).alias("c")).select("user_id", "memory_key", "c.*")
    return _versioned(records, last, "event", now, in_place=False)


def parse_candidates(answers: DataFrame) -> DataFrame:
    """Profile candidates out of a model's answers (user_id, conversation_id, session_id, answer), fences and prose around allowed.

    One row for each of the answer's `memories`, in their order; answers without a JSON object give none.
    """
    kind = "struct<memories:array<struct<memory_key:string,value:string,confidence:string,importance:string,action:string>>>"
    body = F.regexp_extract("answer", r"(?s)(\{.*\})", 1)
    held = answers.select("user_id", "conversation_id", "session_id", F.posexplode(F.from_json(body, kind)["memories"]).alias("position", "m"))
    return held.select("user_id", "m.memory_key", F.substring("m.value", 1, MOST_VALUE).alias("value"), "m.action", "m.confidence", "m.importance", "conversation_id", "session_id", "position")


def is_live(as_of: Column) -> Column:
    return (F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def active_profiles(records: DataFrame, user_id: str, as_of: datetime, limit: int = 20) -> DataFrame:
    """A user's live profile facts, the most important and then the newest first; 1 to 100 of them."""
    if not (user_id or "").strip():
        raise ValueError("a user is needed")
    live = records.filter((F.col("user_id") == user_id) & (F.col("memory_type") == "profile") & is_live(F.lit(as_of).cast("timestamp")))
    return live.orderBy(F.desc("importance_score"), F.desc("updated_at"), "memory_id").limit(min(100, max(1, limit)))


def live_hits(hits: DataFrame, records: DataFrame, k: int, as_of: datetime | Column) -> DataFrame:
    """Of each query's first 3 k hits (query_id, memory_id, rank) the first `k` whose record is a live event."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    live = records.filter((F.col("memory_type") == "event") & is_live(now)).select("memory_id", "content", "importance_score")
    found = hits.filter(F.col("rank") <= 3 * k).join(live, "memory_id")
    again = Window.partitionBy("query_id").orderBy("rank", "memory_id")
    return found.withColumn("live_rank", F.row_number().over(again)).filter(F.col("live_rank") <= k)


def mark_accessed(records: DataFrame, accesses: DataFrame) -> DataFrame:
    """Add a log of accesses (memory_id, at) to the records' counts and times."""
    seen = accesses.groupBy("memory_id").agg(F.count("*").cast("int").alias("_n"), F.max("at").alias("_at"))
    out = records.join(seen, "memory_id", "left")
    return out.withColumns(
        {
            "access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)),
            "last_accessed_at": F.greatest("last_accessed_at", "_at"),
            "updated_at": F.greatest("updated_at", "_at"),
        }
    ).drop("_n", "_at")


def memory_filter(
    rows: DataFrame, user_id: str, conversation_id: str | None = None, session_id: str | None = None, chunk_type: str | None = None, topic: str | None = None
) -> DataFrame:
    """A user's rows, of a conversation, session, chunk type or topic where these are given and not empty.

    Filters are plain equalities, so they reach the scan. Without a user it is an error, since rows are a user's own.
    """
    if not (user_id or "").strip():
        raise ValueError("a user is needed")
    out = rows.filter(F.col("user_id") == user_id.strip())
    for name, value in (("conversation_id", conversation_id), ("session_id", session_id), ("chunk_type", chunk_type), ("topic", topic)):
        if value:
            out = out.filter(F.col(name) == value)
    return out


def _named(user_id: str, conversation_id: str | None, memory_ids: Sequence[str] | None) -> Column:
    if not (user_id or "").strip() or not (conversation_id or memory_ids):
        raise ValueError("a user, and a conversation or memory ids, are needed")
    hit = F.col("user_id") == user_id
    if conversation_id:
        hit = hit & (F.col("conversation_id") == conversation_id)
    if memory_ids:
        hit = hit & F.col("memory_id").isin(list(memory_ids))
    return F.coalesce(hit, F.lit(False))


def delete_vectors(vectors: DataFrame, user_id: str, conversation_id: str | None = None, memory_ids: Sequence[str] | None = None) -> DataFrame:
    """The vectors without a user's of one conversation, of some memory ids, or of both."""
    return vectors.filter(~_named(user_id, conversation_id, memory_ids))


def forget(records: DataFrame, user_id: str, conversation_id: str | None, as_of: datetime, memory_ids: Sequence[str] | None = None) -> DataFrame:
    """Mark a user's active events of a conversation, or of some memory ids, deleted; profile facts stay."""
    gone = _named(user_id, conversation_id, memory_ids) & F.coalesce((F.col("memory_type") == "event") & (F.col("status") == "active"), F.lit(False))
    return records.withColumns({"updated_at": F.when(gone, F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at")), "status": F.when(gone, "deleted").otherwise(F.col("status"))})
