"""What several operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import prepare, stage

# Words are maximal runs of anything but these six ASCII characters (fixed values).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
ROW_BITS = 33  # of monotonically_increasing_id: row number below, partition number above


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def position_in_group(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``place``: the rank from 1 of each row within its group, all other columns kept.

    No group is sorted in one task: rows are dealt by ranges of (group, order), sorted and numbered
    inside their partition and written; one row per group and partition then holds where its rows
    begin. There are at most groups + partitions such rows. Rows equal in group and order may
    change places with each other. Null groups form one group.
    """
    keys = [F.col(g) for g in group] + list(order)
    ranged = stage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()),
        name,
    )
    part, row = F.shiftright("_at", ROW_BITS), F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)
    earlier = Window.partitionBy(*[f"_g_{g}" for g in group]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group], part.alias("_part"))
        .agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    )
    starts = stage(starts, f"{name}-starts")  # the planner then knows its size before it moves rows to it
    same = part == F.col("_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return (
        ranged.join(starts, same)
        .withColumn("place", F.col("_before") + row - F.col("_first") + 1)
        .select(*df.columns, "place")
    )
