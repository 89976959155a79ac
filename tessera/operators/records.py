"""Records as they are shown: projections of documents and users, hits of a store, lists of conversations, message parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
#: What of a user is nobody's business.
SECRET = ("password_hash", "password_salt")


def iso(at: Column) -> Column:
    """A time in ISO form, without a fraction where there is none."""
    return F.when(F.date_format(at, "SSSSSS") == "000000", F.date_format(at, ISO[: ISO.index(".")])).otherwise(F.date_format(at, ISO))


def projected(records: DataFrame, leave_out: tuple[str, ...] = SECRET) -> DataFrame:
    """Records with ISO times and without secrets; the other columns stay in their order."""
    kinds = dict(records.dtypes)
    return records.select(*(iso(F.col(c)).alias(c) if kinds[c].startswith("timestamp") else F.col(c) for c in records.columns if c not in leave_out))


def flat_hits(found: DataFrame, hits: str = "hits") -> DataFrame:
    """Hits of a store, array<array<struct<distance, entity>>> with one inner array a query, as rows.

    Returns the other columns, query_no and hit_no (from 0), distance and the entity's fields. Null arrays have no hits; a
    hit without an entity keeps its distance.
    """
    others = [c for c in found.columns if c != hits]
    by_query = found.select(*others, F.posexplode(hits).alias("query_no", "_q"))
    one = by_query.select(*others, "query_no", F.posexplode("_q").alias("hit_no", "_h")).filter("_h is not null")
    return one.select(*others, "query_no", "hit_no", F.col("_h.distance").alias("distance"), "_h.entity.*")


def recent_conversations(conversations: DataFrame, limit: int | None = None, by: str = "user_id", updated: str = "updated_at") -> DataFrame:
    """Conversations of each user with their place, the last changed first; ties go by conversation."""
    order = Window.partitionBy(by).orderBy(F.desc_nulls_last(updated), "conversation_id")
    placed = conversations.withColumn("place", F.row_number().over(order))
    return placed if limit is None else placed.filter(F.col("place") <= limit)


def content_text(conversations: DataFrame, column: str = "text") -> DataFrame:
    """Messages whose content may be parts: strings stay, lists of strings or of parts with a `text` are joined.

    Parts without a text, such as pictures, say nothing; null content is empty.
    """
    kind = conversations.schema[column].dataType
    if isinstance(kind, StringType):
        said = F.col(column)
    elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
        said = F.array_join(F.col(column), "", "")
    elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and "text" in kind.elementType.names:
        said = F.array_join(F.transform(column, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    else:
        raise ValueError(f"column {column} holds neither texts nor lists of parts with a text")
    return conversations.withColumn(column, F.coalesce(said, F.lit("")))
