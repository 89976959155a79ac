"""Fusion of ranked routes by weighted reciprocal ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def fuse_routes(routes: DataFrame, weights: dict[str, float], key: Sequence[str], k: int | None = None) -> DataFrame:
    """Fuse rows (query_id, route, rank, key columns): query_id, key, score, routes, rank.

    A key's score is the sum of weight / (60 + rank) over all places it has in any route, repeats in one route
    added; `routes` are its distinct routes in the order of `weights`, then by rank. Routes without a weight count
    1. Ties go by where a key was first seen: the route's order, then the rank there.
    """
    order = F.create_map(*(F.lit(v) for i, r in enumerate(weights) for v in (r, i)))[F.col("route")]
    weight = F.create_map(*(F.lit(v) for r, w in weights.items() for v in (r, float(w))))[F.col("route")]
    placed = routes.select("query_id", *key, "route", "rank", F.coalesce(order, F.lit(len(weights))).alias("at"), (F.coalesce(weight, F.lit(1.0)) / (RRF_K + F.col("rank"))).alias("part"))
    seen = F.struct("at", "rank", "route")
    fused = placed.groupBy("query_id", *key).agg(
        F.sum("part").alias("score"),
        F.min(F.struct("at", "rank")).alias("first"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(seen)), lambda s: s["route"])).alias("routes"),
    )
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first", *key)
    ranked = fused.withColumn("rank", F.row_number().over(best)).drop("first")
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def fuse_dense_sparse(dense: DataFrame, sparse: DataFrame, key: Sequence[str], weights: tuple[float, float] = (0.6, 0.4), k: int | None = None) -> DataFrame:
    """The two routes of hybrid retrieval, (query_id, rank, key) each."""
    columns = ["query_id", *key, "rank"]
    both = dense.select(*columns, F.lit("dense").alias("route")).unionByName(sparse.select(*columns, F.lit("sparse").alias("route")))
    return fuse_routes(both, {"dense": weights[0], "sparse": weights[1]}, key, k)


def keep_protected(fused: DataFrame, protected: DataFrame, key: Sequence[str], limit: int) -> DataFrame:
    """The pool of `limit` results in which all `protected` ones (query_id, key, rank) have a place.

    Those outside of the pool take places at its tail, the first protected one the last place given up; what the
    pool loses is its own tail. Protected results are bounded by what a caller asks for, a few dozen a query.
    """
    pool = fused.filter(F.col("rank") <= limit)
    missing = protected.join(pool.select("query_id", *key), ["query_id", *key], "left_anti")
    size = pool.groupBy("query_id").agg(F.count("*").alias("held"))
    again = missing.groupBy("query_id").agg(F.count("*").alias("extra"))
    room = pool.join(size, "query_id").join(again, "query_id", "left")
    kept = room.filter(F.col("rank") <= F.greatest(F.lit(0), F.least(F.col("held"), limit - F.coalesce("extra", F.lit(0))))).drop("held", "extra")
    added = missing.withColumn("rank", limit + F.row_number().over(Window.partitionBy("query_id").orderBy("rank", *key)))
    both = kept.unionByName(added, allowMissingColumns=True)
    tail = Window.partitionBy("query_id").orderBy("rank", *key)
    return both.withColumn("rank", F.row_number().over(tail)).filter(F.col("rank") <= limit)
