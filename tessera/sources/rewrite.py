"""Key-wise changes of plain tables: rewrites of what a join leaves, for catalogs without MERGE or DELETE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents being deleted, or gone.
GONE = ("deleting", "deleted")


def delete_keys(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows whose key isn't among `keys`."""
    return table.join(keys.select(*on).distinct(), list(on), "left_anti")


def replace_keys(table: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """All rows of the keys in `new` are replaced by those in `new`."""
    return delete_keys(table, new, on).unionByName(new.select(*table.columns))


def update_fields(table: DataFrame, changes: DataFrame, on: Sequence[str]) -> DataFrame:
    """Set the fields that `changes` (one row a key) has; its nulls change nothing."""
    fields = [c for c in changes.columns if c not in on]
    told = changes.select(*on, *(F.col(c).alias(f"_{c}") for c in fields))
    out = table.join(told, list(on), "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns))


def delete_requested(ids: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Those of `ids` that are missing from the documents table or on their way out of it."""
    return ids.join(documents.select(key, "status"), key, "left").filter(F.col("status").isNull() | F.col("status").isin(*GONE)).select(ids.columns)


def purge_documents(documents: DataFrame, chunks: DataFrame, requests: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Two-phase deletion: requested documents become `deleting`, and their chunks go. Returns both tables.

    Documents still `processing` are left alone, as are requests for ids that aren't there.
    """
    asked = requests.select(key).distinct().withColumn("_asked", F.lit(True))
    marked = documents.join(asked, key, "left")
    go = F.coalesce("_asked", F.lit(False)) & (F.col("status") != "processing")
    marked = marked.withColumn("status", F.when(go, "deleting").otherwise(F.col("status"))).drop("_asked")
    return marked, delete_keys(chunks, marked.filter(F.col("status").isin(*GONE)), [key])


def append(table: DataFrame, path: str, cluster_by: str | None = None) -> None:
    """Append to a Parquet table, rows of a key together so that later scans by key skip row groups."""
    (table.repartition(cluster_by).sortWithinPartitions(cluster_by) if cluster_by else table).write.mode("append").parquet(path)
