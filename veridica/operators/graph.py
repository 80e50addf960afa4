"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two windows over the links of a node; the table of links is written to the shared folder
after it, once, until it is a forest of stars. Nothing is collected but one row of totals a round. A node with so many links that it would fill a good part of a task (of such nodes there
are at most ``HOT`` times the tasks) meets its least neighbour by a broadcast, so its links stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved


#: A node is hot from this part of a task's mean links on, 1 / HOT, if it has FEW at least: less is no load for any task.
HOT, FEW = 4, 256


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``links``: two bigint columns. Returns (node, root) for every node of a link, root = least node.

    Loops and nulls are ignored; repeated links count once; no links give no rows.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = saved(links.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "links")
    tasks, lowest = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.min("v").over(Window.partitionBy("u"))
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.max("v").alias("most"), F.count("*").alias("n"))
        # in a forest of stars, a node next to a lesser one has no other
        every, most, more = least.agg(F.sum("n"), F.max("n"), F.count_if(F.expr("m < u and most != m"))).first()
        if not more:
            return least.select(F.col("u").alias("node"), F.col("m").alias("root"))
        rest, limit = both, max(FEW, every // (HOT * tasks))
        if most >= limit:
            hot = F.broadcast(least.where(F.col("n") >= limit).select(F.col("u").alias("h"), F.col("m").alias("hm")))
            rest = both.join(hot, F.col("u") == F.col("h"), "left_anti")
        large = rest.withColumn("m", F.least("u", lowest)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if most >= limit:
            large = large.union(both.where("v > u").join(hot, F.col("u") == F.col("h")).select(F.col("v").alias("u"), F.col("hm").alias("v")))
        small = large.distinct().withColumn("m", lowest)
        edges = saved(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")), "star")
