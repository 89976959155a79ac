"""Connected components of a table of links, on the executors alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import stored


#: Fewer keys than this have more than this part of a table's rows each.
MOST_HEAVY = 1000


def with_names(rows: DataFrame, names: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """`rows`, which are `total`, with the columns of `names`: one row for each key, with its number of rows in `count`.

    Keys with more than a part in MOST_HEAVY of all rows are fewer than MOST_HEAVY, so they are broadcast and their rows
    stay where they are; only the rest is dealt out by key. Rows whose key `names` lacks go.
    """
    heavy = F.col(count) * MOST_HEAVY > total
    often, seldom = F.broadcast(names.filter(heavy).drop(count)), names.filter(~heavy).drop(count)
    return rows.join(often, key).unionByName(rows.join(F.broadcast(often.select(key)), key, "left_anti").join(seldom, key))


def components(links: DataFrame) -> DataFrame:
    """Rows (node, comp): for each node of `links` (a, b) the smallest node it can reach.

    Every round a node takes the least label of its neighbours' labels, so chains halve and stars end at once; where
    nothing changes, neighbours agree. Each round is one table in the shared folder, and only a flag comes to the driver.
    Nodes may have any type that can be ordered; repeated links and links of a node to itself do no harm, and an
    empty table gives an empty result.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = both.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("degree"))
    label = stored(label.select(F.col("a").alias("node"), F.least("a", "b").alias("comp"), "degree"))
    n_links, n_nodes = both.count(), label.count()
    while True:
        # The middle of a star is the label of all its nodes, and a neighbour of each: a key with any share of the rows.
        far = label.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        far = stored(label.groupBy("comp").agg(F.count("*").alias("size")).join(far, "comp"))
        jumped = stored(with_names(label, far, "comp", "size", n_nodes).select("node", "comp", "far", "degree"))
        seen = with_names(both, jumped.select(F.col("node").alias("b"), "far", "degree"), "b", "degree", n_links)
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("far").alias("near"))
        least = F.least("far", "near")
        step = stored(jumped.join(near, "node").select("node", least.alias("comp"), "degree", (least < F.col("comp")).alias("changed")))
        label = step.drop("changed")
        if step.filter("changed").isEmpty():
            return label.select("node", "comp")
