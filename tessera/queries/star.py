"""Relational coverage on the star schema: the built-in operators that the other plans are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.queries.registry import Registry, table

_registry = Registry()


@_registry.add("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def star_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    c = table(spark, sf_dir, "customer")
    return c.join(orders, c.c_custkey == orders.o_custkey, "left_semi").select("c_custkey")


@_registry.add("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def star_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    c = table(spark, sf_dir, "customer")
    return c.join(orders, c.c_custkey == orders.o_custkey, "left_anti").select("c_custkey")


@_registry.add(
    "SELECT coalesce(s.k, c.k) AS nation, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) c ON s.k = c.k"
)
def star_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    c = table(spark, sf_dir, "customer").filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    return s.join(c, "nation", "full").fillna(0, ["suppliers", "customers"])


_SETS = "(SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') {} (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')"


def _priority(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == name).select("o_custkey").distinct()


@_registry.add(_SETS.format("INTERSECT"))
def star_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priority(spark, sf_dir, "1-URGENT").intersect(_priority(spark, sf_dir, "5-LOW"))


@_registry.add(_SETS.format("EXCEPT"))
def star_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priority(spark, sf_dir, "1-URGENT").subtract(_priority(spark, sf_dir, "5-LOW"))


@_registry.add(_SETS.format("UNION"))
def star_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priority(spark, sf_dir, "1-URGENT").union(_priority(spark, sf_dir, "5-LOW")).distinct()


_GROUPED = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY {}"


@_registry.add(_GROUPED.format("CUBE (l_returnflag, l_linestatus)"))
def star_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@_registry.add(_GROUPED.format("ROLLUP (l_returnflag, l_linestatus)"))
def star_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@_registry.add(_GROUPED.format("GROUPING SETS ((l_returnflag), (l_linestatus))"))
def star_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf_dir, "lineitem").groupingSets([[one], [two]], one, two).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@_registry.add(
    "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2"
)
def star_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    found = table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(best)).filter("rank <= 2")
    return found.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@_registry.add(
    """SELECT r_name, year(o_orderdate) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"""
)
def star_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by region and year, lines summed by order before the joins."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    joined = lines.join(table(spark, sf_dir, "orders"), "o_orderkey").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum("revenue"), 2).alias("revenue"))


QUERIES, ORACLES = _registry.queries, _registry.oracles
