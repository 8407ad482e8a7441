"""Ranks inside groups without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .materialize import materialize


def group_rank(df: DataFrame, group: str, order: Sequence[str], rank: str = "rank", size: str = "size") -> DataFrame:
    """``df`` with the 0-based rank of each row in its group (by ``order``) and the size of the group.

    The rows are range partitioned and sorted by group and order and written once with a running number; a table of
    one row per (group, partition) holds how many rows of the group lie in the partitions before. A group of any size
    is spread over as many partitions as its rows need. ``order`` should be unique within a group.
    """
    number = F.monotonically_increasing_id()  # partition number in the upper bits, row number in the lower 33
    rows = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", number)
    rows = materialize(rows.withColumn("_part", F.shiftright("_at", 33)), name="ranked")
    parts = rows.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                         F.sum("_n").over(Window.partitionBy(group)).alias(size))
    return (rows.join(parts, [group, "_part"])
            .select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(rank), size))


def running_total(df: DataFrame, group: str, order: Sequence[str], weight: str, total: str = "total") -> DataFrame:
    """``df`` with the sum of ``weight`` over the rows of the group that lie before each row (by ``order``).

    As in ``group_rank``, the rows are range sorted and written once; a window sums inside a (group, partition) only, and
    a table of one row per (group, partition) holds the sums of the partitions before.
    """
    number = F.monotonically_increasing_id()
    rows = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", number)
    rows = materialize(rows.withColumn("_part", F.shiftright("_at", 33)), name="running")
    parts = rows.groupBy(group, "_part").agg(F.sum(weight).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(parts, [group, "_part"])
            .select(*df.columns, (F.col("_before") + F.col("_in")).alias(total)))
