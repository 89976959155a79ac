"""Table schemas, and checks of what a table must have."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}


def _schema(fields: str) -> T.StructType:
    """A schema of `name type, ...`, made without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in map(str.split, fields.split(","))])


DOCUMENTS = _schema(
    "document_id string, original_name string, stored_path string, file_type string, content_type string, file_size long, "
    "status string, error_message string, chunk_count int, created_at timestamp, updated_at timestamp"
)
PARENTS = _schema("parent_id string, document_id string, parent_index int, parent_text string, source_name string, file_type string")
CHILDREN = _schema(
    "child_id string, parent_id string, document_id string, parent_index int, chunk_index int, child_text string, "
    "source_name string, file_type string"
)
RESULTS = _schema(
    "query_id string, content string, document_id string, chunk_index int, child_id string, parent_id string, "
    "source_name string, file_type string, score double, source string"
)
MEMORY_RECORDS = _schema(
    "memory_id string, user_id string, memory_type string, memory_key string, content string, conversation_id string, "
    "session_id string, base_importance_score double, importance_score double, confidence_score double, access_count int, "
    "last_accessed_at timestamp, expires_at timestamp, status string, version int, supersedes_memory_id string, "
    "created_at timestamp, updated_at timestamp"
)
DOCUMENT_STATUSES = ("processing", "ready", "failed", "deleting", "deleted")
MEMORY_STATUSES = ("active", "superseded", "expired", "deleted")


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The table itself; raises ValueError where a column is missing."""
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """A catalog table, or an empty one where it isn't there yet: what isn't ready has no rows, it is no error."""
    return require_columns(spark.table(name), schema.names) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def wrong_dimensions(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    """The rows whose vector is null or has another number of components."""
    return df.filter(F.col(vector).isNull() | (F.size(vector) != dimension))
