"""Prefix sums over a globally sorted table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage


def running_total(df: DataFrame, group: list[str], order_by: list[str], weight: str) -> DataFrame:
    """Add ``before``: the sum of ``weight`` over the rows of the group that sort before this one,
    and ``total``: the sum over the whole group.

    ``group`` and ``order_by`` together must be unique. Rows are range-partitioned by both, the
    partition number is written with them (range bounds are sampled, so a recomputation could draw
    others), each partition is summed on its own, and the totals per group and partition give the
    offsets. Ranges follow the group order, so there are at most groups + partitions such totals; they are
    written, so that the planner decides by their size how to join them.
    """
    ranged = stage(
        df.repartitionByRange(*group, *order_by).withColumn("_part", F.spark_partition_id()), "running-total"
    )
    scope = Window.partitionBy(*(group or [F.lit(0)]))
    earlier = scope.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*group, "_part")
        .agg(F.sum(weight).alias("_sum"))
        .select(
            *group, "_part",
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
            F.sum("_sum").over(scope).alias("total"),
        )
    )
    inside = Window.partitionBy(*group, "_part").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(stage(offsets, "running-total-offsets"), [*group, "_part"])
        .withColumn("before", F.col("_offset") + F.col("_inside"))
        .drop("_part", "_offset", "_inside")
    )
