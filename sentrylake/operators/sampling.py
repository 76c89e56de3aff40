"""Repeatable samples of exact size, chosen by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

DIGITS = 4  # hex digits looked at in one pass: at most 65,536 histogram rows per group
WHOLE = 32  # hex digits of the hash
EDGE = 1_000  # rows of the last prefix from which they are ranked one by one
SPREAD = 64


def hash_order(uid: str, seed: int) -> Column:
    """The order of the sample: md5 of id and seed."""
    return F.md5(F.concat(F.col(uid).cast("string"), F.lit(str(seed))))


def smallest_by_hash(
    df: DataFrame, k: int, uid: str = "event_uid", seed: int = 42, by: str | None = None
) -> DataFrame:
    """The ``k`` rows of smallest hash (per value of ``by``); all rows where there are fewer.

    Ranking a whole day would sort it in one task. Counting hash prefixes finds the prefix in
    which the k-th row lies; that prefix alone is counted again by longer ones until it holds few rows, or
    copies of one id, which are ranked in parts. Rows below it are taken as they come. Each pass reads
    the ids and writes one row per value of ``by``.
    """
    hashed = df.withColumn("_hash", hash_order(uid, seed)).withColumn("_by", F.col(by) if by else F.lit(0))
    cuts, digits = None, 0
    while cuts is None or (digits < WHOLE and cuts.filter(F.col("_edge") > EDGE).limit(1).count()):
        digits += DIGITS
        rows = hashed.select("_by", "_hash")
        if cuts is None:
            rows = rows.withColumn("_need", F.lit(k).cast("long"))
        else:
            known = cuts.select(F.col("_by").alias("_of"), "_cut", "_need")
            rows = rows.join(known, F.col("_by").eqNullSafe(F.col("_of"))).filter(F.startswith("_hash", "_cut"))
        counted = rows.groupBy("_by", "_need", F.substring("_hash", 1, digits).alias("_prefix")).agg(F.count("*").alias("_n"))
        upto = Window.partitionBy("_by").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
        found = counted.withColumn("_upto", F.sum("_n").over(upto)).filter(
            (F.col("_upto") > F.col("_need")) & (F.col("_upto") - F.col("_n") <= F.col("_need"))
        )
        cuts = stage(
            found.select("_by", F.col("_prefix").alias("_cut"), (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need"),
                         F.col("_n").alias("_edge")),
            "sample-cuts",
        )
    known = cuts.withColumnRenamed("_by", "_of")
    marked = hashed.join(known, F.col("_by").eqNullSafe(F.col("_of")), "left")
    prefix = F.substring("_hash", 1, digits)
    below = marked.filter(F.col("_cut").isNull() | (prefix < F.col("_cut")))
    edge = marked.filter(prefix == F.col("_cut")).withColumn(
        "_part", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    )
    for scope in (["_by", "_part"], ["_by"]):
        rank = Window.partitionBy(*scope).orderBy("_hash")
        edge = edge.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= F.col("_need"))
    return below.select(*df.columns).unionByName(edge.select(*df.columns))


def sample_per_day(df: DataFrame, k: int, uid: str = "event_uid", seed: int = 42) -> DataFrame:
    """At most ``k`` rows of every day."""
    return smallest_by_hash(df, k, uid, seed, by="dt")


def capped(df: DataFrame, max_rows: int, uid: str = "event_uid", seed: int = 42) -> DataFrame:
    """The table itself, or a sample of ``max_rows`` rows if it has more."""
    return smallest_by_hash(df, max_rows, uid, seed)
