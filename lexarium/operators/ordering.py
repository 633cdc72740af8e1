"""Positions and running values over one order of a whole table, without a task that sees all of it.

A window without a partition key gathers every row in one task.  Here rows are dealt by ranges of the order; a range's total is one small row, a running
sum over those gives each range its start, and what remains runs inside ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Positions of one bucket of ``running``.
BUCKET = 1 << 16


def numbered(rows: DataFrame, order: list[Column], name: str = "seq") -> DataFrame:
    """``rows`` with their position from 1 in ``order``. The order must be total: rows that are equal in it may change places."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number within a partition is the lower half of this id, the partition the upper
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = ranged.groupBy(part).agg(F.count("*").alias("_size"))
    # one row per range, of which there are as many as shuffle partitions
    starts = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_start"))
    placed = ranged.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("_part", "_start", "_at")


def running(rows: DataFrame, position: str, out: str, value: Column, fold, before: bool) -> DataFrame:
    """``rows`` with ``out``: ``fold`` (``F.sum`` or ``F.max``) of ``value`` over all smaller positions, or up to the own one."""
    combine = F.greatest if fold is F.max else lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    valued = rows.withColumn("_v", value).withColumn("_bucket", F.floor((F.col(position) - 1) / BUCKET).cast("int"))
    totals = valued.groupBy("_bucket").agg(fold("_v").alias("_total"))
    # one row per ``BUCKET`` positions
    carried = totals.select("_bucket", fold("_total").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = Window.partitionBy("_bucket").orderBy(position).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    found = valued.withColumn("_inside", fold("_v").over(inside)).join(carried, "_bucket")
    both = combine(F.col("_carried"), F.col("_inside"))
    return found.withColumn(out, F.when(F.col("_carried").isNull() & F.col("_inside").isNull(), F.lit(None)).otherwise(both)).drop("_v", "_bucket", "_inside", "_carried")
