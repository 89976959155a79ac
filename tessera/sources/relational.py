"""Relational tables by JDBC: partitioned reads with pushed predicates, and upserts in one transaction."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Rows that a partition of a read stands for; a table has at most so many partitions, each of which is a connection.
ROWS, MOST_PARTITIONS = 1_000_000, 200


def _options(url: str, more: dict | None) -> dict:
    return {"url": url} | (more or {})


def read_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None, rows: int = ROWS, options: dict | None = None) -> DataFrame:
    """A table, or a query in parentheses with a name, as rows. Filters and columns are pushed to the database.

    With a numeric `partition_column` the table is read by ranges of it, of about `rows` rows each if values are spread
    evenly; the range is asked of the database. Rows without a value are in the first range.
    """
    held = spark.read.format("jdbc").options(**_options(url, options))
    if partition_column is None:
        return held.option("dbtable", table).load()
    asked = f"(SELECT MIN({partition_column}) AS LOW, MAX({partition_column}) AS HIGH, COUNT(*) AS N FROM {table}) B"
    low, high, n = held.option("dbtable", asked).load().first()
    held = spark.read.format("jdbc").options(**_options(url, options)).option("dbtable", table)
    parts = min(MOST_PARTITIONS, -(-int(n) // rows))
    if parts < 2 or low == high:
        return held.load()
    return held.options(partitionColumn=partition_column, lowerBound=str(low), upperBound=str(int(high) + 1), numPartitions=str(parts)).load()


def _run(spark: SparkSession, url: str, statements: Sequence[str], options: dict | None) -> None:
    """Statements in one transaction, from the driver."""
    jvm = spark._jvm
    properties = jvm.java.util.Properties()
    for k, v in (options or {}).items():
        properties.setProperty(k, str(v))
    if options and "driver" in options:
        jvm.java.lang.Class.forName(options["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        connection.setAutoCommit(False)
        try:
            for text in statements:
                statement = connection.createStatement()
                statement.execute(text)
                statement.close()
            connection.commit()
        except Exception:
            connection.rollback()
            raise
    finally:
        connection.close()


def upsert(rows: DataFrame, url: str, table: str, on: Sequence[str], partitions: int = 8, options: dict | None = None, types: str | None = None) -> None:
    """Insert rows into a table that is there, in place of those with their keys: all of them, or none if anything fails.

    Tasks append to a staging table of this write's own, `partitions` at a time; then one transaction deletes the keys and
    inserts the staged rows, and the staging table goes. A task that ran twice has left rows twice, which the transaction
    takes once; rows that repeat a key with different values are an error of the table's key, if it has one. Rows without a
    key are inserted. `types` is for the staging table as for `create`.
    """
    spark, stage = rows.sparkSession, f"STAGE_{uuid.uuid4().hex[:20].upper()}"
    columns = ", ".join(rows.columns)
    create(rows, url, stage, options=options, types=types)
    try:
        rows.coalesce(partitions).write.format("jdbc").options(**_options(url, options)).option("dbtable", stage).mode("append").save()
        same = " AND ".join(f"{stage}.{k} = {table}.{k}" for k in on)
        _run(spark, url, [f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {stage} WHERE {same})", f"INSERT INTO {table} ({columns}) SELECT DISTINCT {columns} FROM {stage}"], options)
    finally:
        _run(spark, url, [f"DROP TABLE {stage}"], options)


def create(rows: DataFrame, url: str, table: str, on: Sequence[str] = (), options: dict | None = None, types: str | None = None) -> None:
    """Make an empty table with the columns of `rows`; `types` gives column types as in CREATE TABLE, `on` a primary key."""
    held = rows.limit(0).write.format("jdbc").options(**_options(url, options)).option("dbtable", table)
    (held.option("createTableColumnTypes", types) if types else held).mode("errorifexists").save()
    if on:
        _run(rows.sparkSession, url, [*(f"ALTER TABLE {table} ALTER COLUMN {k} NOT NULL" for k in on), f"ALTER TABLE {table} ADD PRIMARY KEY ({', '.join(on)})"], options)
