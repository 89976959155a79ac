"""Round trips through the database that comes with Spark: pushed filters, partitioned reads, upserts that fail whole."""

import uuid

import pytest
from pyspark.sql import functions as F

from tessera.sources import relational


@pytest.fixture
def url():
    return f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"


KINDS = "ID BIGINT, NAME VARCHAR(40), SCORE DOUBLE"


def rows(spark, ids, name="n"):
    held = [(i, f"{name}{i}", i / 2) for i in ids]
    return spark.createDataFrame(held, "ID long, NAME string, SCORE double").repartition(3)


def content(spark, url):
    return sorted(tuple(r) for r in relational.read_table(spark, url, "T").collect())


def test_upserts(spark, url):
    # VARCHAR: the database has no DISTINCT over its default for strings
    relational.create(rows(spark, []), url, "T", ["ID"], types="NAME VARCHAR(40)")
    given = lambda ids, name="n": rows(spark, ids, name)
    relational.upsert(given(range(50)), url, "T", ["ID"], types="NAME VARCHAR(40)")
    relational.upsert(given(range(40, 60), "new"), url, "T", ["ID"], types="NAME VARCHAR(40)")
    want = [(i, f"{'new' if i >= 40 else 'n'}{i}", i / 2) for i in range(60)]
    assert content(spark, url) == want
    relational.upsert(given(range(3)).union(given(range(3))), url, "T", ["ID"], types="NAME VARCHAR(40)")  # as after a second attempt
    assert content(spark, url) == want
    with pytest.raises(Exception, match="(?i)duplicate|unique|primary"):
        relational.upsert(given([1, 70]).union(given([70], "other")), url, "T", ["ID"], types="NAME VARCHAR(40)")
    assert content(spark, url) == want  # the deletion of 1 was taken back, too
    left = relational.read_table(spark, url, "(SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T') X").collect()
    assert [r[0] for r in left] == ["T"]


def test_reads_are_pushed_and_partitioned(spark, url):
    relational.create(rows(spark, []), url, "T", types="NAME VARCHAR(40)")
    relational.upsert(rows(spark, range(100)), url, "T", ["ID"], types="NAME VARCHAR(40)")
    held = relational.read_table(spark, url, "T", "ID", rows=20)
    assert held.rdd.getNumPartitions() == 5
    some = held.filter((F.col("ID") > 90) & F.col("NAME").startswith("n9")).select("ID")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(ID)" in plan.replace("\n", " ") or "*GreaterThan(ID,90)" in plan
    assert "SCORE" not in plan.split("ReadSchema")[-1]
    assert sorted(r[0] for r in some.collect()) == list(range(91, 100)) and held.count() == 100
    assert relational.read_table(spark, url, "T", "ID").rdd.getNumPartitions() == 1
    relational.create(rows(spark, []), url, "EMPTY")
    assert relational.read_table(spark, url, "EMPTY", "ID").count() == 0
