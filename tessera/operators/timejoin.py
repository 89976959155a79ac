"""As-of and interval joins by key and time. Time is cut into pieces, so a key with a large share of all rows is many groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _piece(at: Column, seconds: float) -> Column:
    return F.floor(F.unix_micros(at) / F.lit(round(seconds * 1e6))).cast("long")


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], order: str | None = None, piece_seconds: float = 86_400.0) -> DataFrame:
    """Each row of `left` with `columns` of the last row of `right` that has its keys and isn't later; null where there is none.

    Of right rows with one time the last in `order` counts. Both sides are put in one table and the last right row is
    carried down inside pieces of `piece_seconds`; what a piece begins with is the last row of the pieces before it, of
    which a key has one row each. Keys compare as null-safe equals; rows without a time have no match, and match nothing.
    """
    side = lambda df, time: {**{f"_k{i}": df[k] for i, k in enumerate(on)}, "_at": df[time].cast("timestamp")}
    keys = [f"_k{i}" for i in range(len(on))]
    given = F.struct(*(right[c] for c in columns))
    rights = right.select(*(c.alias(n) for n, c in side(right, right_time).items()), F.lit(0).alias("_side"), (right[order] if order else F.lit(None)).alias("_order"), given.alias("_given"))
    rights = rights.filter("_at is not null")
    lefts = left.select(*(c.alias(n) for n, c in side(left, left_time).items()), F.lit(1).alias("_side"), F.struct("*").alias("_row"))
    both = lefts.unionByName(rights, allowMissingColumns=True).withColumn("_piece", _piece(F.col("_at"), piece_seconds))
    seen = F.when(F.col("_side") == 0, F.struct(F.col("_given").alias("g")))
    inside = Window.partitionBy(*keys, "_piece").orderBy("_at", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    # One row for each piece of a key: the last right row in it, carried over the pieces.
    ends = rights.withColumn("_piece", _piece(F.col("_at"), piece_seconds)).groupBy(*keys, "_piece").agg(F.max_by(F.struct(F.col("_given").alias("g")), F.struct("_at", "_order")).alias("_end"))
    pieces = both.filter("_side = 1").select(*keys, "_piece").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
    carried = ends.unionByName(pieces).groupBy(*keys, "_piece").agg(F.first("_end", ignorenulls=True).alias("_end"))
    along = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(*(F.col(k).alias(f"_c{k}") for k in keys), F.col("_piece").alias("_cpiece"), F.last("_end", ignorenulls=True).over(along).alias("_before"))
    held = both.withColumn("_seen", F.last(seen, ignorenulls=True).over(inside)).filter("_side = 1")
    same = F.col("_piece").eqNullSafe(F.col("_cpiece"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_c{k}"))
    found = held.join(carried, same, "left").withColumn("_found", F.when(F.col("_at").isNotNull(), F.coalesce("_seen", "_before")))
    return found.select("_row.*", *(F.col(f"_found.g.{c}").alias(c) for c in columns))


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, before: float, after: float, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of `left` with `columns` of all rows of `right` that have its keys and are at most `before` seconds earlier or
    `after` seconds later, both included; with how=`left` also rows without a match.

    Times are cut into bins as wide as the interval: a left row looks into two bins at most, so the join is one by equal
    key and bin, whose large groups adaptive execution can split on either side.
    """
    if how not in ("inner", "left") or before + after <= 0:
        raise ValueError("how is inner or left, and the interval has a length")
    width = before + after
    at = F.col(left_time).cast("timestamp")
    shift = lambda c, seconds: F.timestamp_micros(F.unix_micros(c) + F.lit(round(seconds * 1e6)))
    rows = left.select(F.struct("*").alias("_row"), *(left[k].alias(f"_k{i}") for i, k in enumerate(on)), shift(at, -before).alias("_from"), shift(at, after).alias("_to"))
    first, last = _piece(F.col("_from"), width), _piece(F.col("_to"), width)
    bins = rows.withColumn("_bin", F.explode(F.sequence(first, last)))
    held = right.select(*(right[k].alias(f"_r{i}") for i, k in enumerate(on)), F.struct(*(right[c] for c in columns)).alias("_given"), right[right_time].cast("timestamp").alias("_at"))
    held = held.withColumn("_rbin", _piece(F.col("_at"), width))
    same = (F.col("_bin") == F.col("_rbin")) & F.col("_at").between(F.col("_from"), F.col("_to"))
    for i in range(len(on)):
        same = same & (F.col(f"_k{i}") == F.col(f"_r{i}"))
    found = bins.join(held, same).select("_row", "_given")
    if how == "left":
        # Left rows without a match: no right time of their keys lies in either bin's part of the interval.
        keys = [f"_k{i}" for i in range(len(on))]
        times = held.select(*(F.col(f"_r{i}").alias(f"_t{i}") for i in range(len(on))), F.col("_rbin").alias("_tbin"), F.col("_at").alias("_time")).distinct()
        there = (F.col("_time") >= F.col("_from")) & (F.col("_time") <= F.col("_to"))
        for k, i in zip(keys, range(len(on)), strict=True):
            there = there & (F.col(k) == F.col(f"_t{i}"))
        alone = rows
        for bin_of in (first, last):
            alone = alone.join(times, there & (bin_of == F.col("_tbin")), "left_anti")
        found = found.unionByName(alone.select("_row", F.lit(None).cast(held.schema["_given"].dataType).alias("_given")))
    return found.select("_row.*", *(F.col(f"_given.{c}").alias(c) for c in columns))
