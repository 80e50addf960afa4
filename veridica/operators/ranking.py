"""Places in a total order without a window over one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import saved


def numbered(rows: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """``rows`` with ``out``, their place from 1 in ``order``, which must tell all rows apart.

    Rows are range-partitioned and sorted once and written, so that their partitions stay as they are; a place is a row's
    place in its task and the rows of the tasks before. Only one row a task meets in a window.
    """
    if out in rows.columns:
        raise ValueError(f"there is a column {out} already")
    # a place in a task's order is in the low 33 bits of Spark's row id, the task in the bits above
    put = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(out, F.monotonically_increasing_id()), "places")
    task = F.shiftright(out, 33)
    sizes = put.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"), F.min(out).alias("_low"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("_task", (before - F.col("_low") + 1).alias("_shift"))
    return put.join(F.broadcast(shift), task == F.col("_task")).withColumn(out, F.col(out) + F.col("_shift")).drop("_task", "_shift")


def cumulated(rows: DataFrame, order: list[Column], value: str, out: str = "up_to") -> DataFrame:
    """``rows`` with ``out``, the sum of ``value`` (whole numbers) over the rows up to each in ``order``, which must tell all rows apart.

    As in ``numbered``, a row's sum is that of its task so far and that of the tasks before; a window holds the rows of one
    task, and one row a task.
    """
    if out in rows.columns:
        raise ValueError(f"there is a column {out} already")
    put = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "sums")
    put = put.withColumn("_task", F.shiftright("_at", 33))
    sums = put.groupBy("_task").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    mine = F.sum(value).over(W.partitionBy("_task").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    return put.withColumn(out, mine).join(F.broadcast(sums.select("_task", before.alias("_before"))), "_task").withColumn(out, F.col(out) + F.col("_before")).drop("_at", "_task", "_before")
