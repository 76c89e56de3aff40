"""One summary row per day of a table, refreshed for changed days only, and questions about spans of days.

A row has exact counts and ends, an HLL sketch of the hosts and a KLL sketch of the scores. Sketches of days merge,
so a span needs no second look at its events, except for an exact quantile: the merged sketch brackets it, and one
pass over the scores counts what lies below the bracket and groups what lies in it.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stage
from .ranges import running_total

SUMMARY_SCHEMA = (
    "n_rows bigint, n_scores bigint, max_score double, first_ts timestamp, last_ts timestamp, hosts binary, scores binary, "
    "digest bigint, dt date"
)
SPREAD = 0.02  # share of the rows on either side of a quantile in its first bracket


def _day_files(spark: SparkSession, path: str) -> DataFrame:
    """``dt`` and a digest of the names, sizes and times of its files; the files are not opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    day = F.regexp_extract("path", r"/dt=(\d{4}-\d{2}-\d{2})/", 1).try_cast("date")
    return files.select(day.alias("dt"), F.xxhash64("path", "length", "modificationTime").alias("file")).filter("dt IS NOT NULL").groupBy(
        "dt").agg(F.bit_xor("file").alias("digest"))


def _summaries(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(SUMMARY_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SUMMARY_SCHEMA)


def summarize(rows: DataFrame, score: str = "anom_score", host: str = "host_name") -> DataFrame:
    """One row per ``dt``. Rows without host count as the host ``unknown``; null and NaN scores are no scores."""
    value = F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double"))
    named = rows.select("dt", "event_ts", F.coalesce(F.col(host), F.lit("unknown")).alias("_host"), value.alias("_score"))
    return named.groupBy("dt").agg(
        F.count("*").alias("n_rows"), F.count("_score").alias("n_scores"), F.max("_score").alias("max_score"),
        F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"),
        F.hll_sketch_agg("_host").alias("hosts"), F.expr("kll_sketch_agg_double(_score)").alias("scores"),
    )


def refresh_days(spark: SparkSession, table: str, summaries: str, score: str = "anom_score", host: str = "host_name") -> list[str]:
    """Bring the summaries of a day-partitioned table up to date; the days that were read for it.

    A day is read again if a file of it came, went or changed. Days that are gone keep a row of 0 rows.
    """
    there = stage(_day_files(spark, table), "day-files")
    known = _summaries(spark, summaries).select("dt", F.col("digest").alias("_known"), "n_rows")
    both = there.join(known, "dt", "full")
    changed = stage(both.filter(~F.col("digest").eqNullSafe(F.col("_known")) & ~(F.col("digest").isNull() & (F.col("n_rows") == 0))), "changed-days")
    days = sorted(row["dt"] for row in changed.select("dt").collect())  # one row per changed day
    if days:
        rows = spark.read.parquet(table).filter(F.col("dt").isin(days))
        found = changed.select("dt", "digest").join(summarize(rows, score, host), "dt", "left").fillna(0, ["n_rows", "n_scores"])
        found.select(*_summaries(spark, summaries).columns).repartition("dt").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(summaries)
    return [str(day) for day in days]


def days_between(spark: SparkSession, summaries: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The summaries of the days from ``first`` to ``last``, both included."""
    found = _summaries(spark, summaries).filter("n_rows > 0")
    if first is not None:
        found = found.filter(F.col("dt") >= F.lit(first).cast("date"))
    return found if last is None else found.filter(F.col("dt") <= F.lit(last).cast("date"))


def overview_of_days(days: DataFrame) -> DataFrame:
    """One row: number of rows, highest score, first and last time (all exact), number of hosts (within some 2 %)."""
    return days.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.max("max_score").alias("max_score"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("hosts")), F.lit(0)).alias("n_hosts"),
    )


def quantile_of_days(scores: DataFrame, days: DataFrame, p: float, score: str = "anom_score") -> float | None:
    """The exact linear-interpolated quantile of the scores of the days; None if there are none.

    ``scores`` is the table that the summaries are of, with ``dt``. It is read once, unless the sketch was off by
    more than SPREAD; the bracket is then widened, in the end to everything.
    """
    merged = days.agg(F.sum("n_scores").alias("n"), F.min("dt").alias("first"), F.max("dt").alias("last"), F.expr("kll_merge_agg_double(scores)").alias("s"))
    row = merged.first()
    if not row["n"]:
        return None
    place, spread = (row["n"] - 1) * p, SPREAD
    value = F.col(score).cast("double")
    own = scores.filter(F.col("dt").between(F.lit(row["first"]), F.lit(row["last"])) & value.isNotNull() & ~F.isnan(value))
    own = own.join(days.select("dt"), "dt", "left_semi")
    while True:
        ends = [min(max(p + side * spread, 0.0), 1.0) for side in (-1, 1)]
        sketch = merged.select(*[F.expr(f"kll_sketch_get_quantile_double(s, {e!r}D)") for e in ends]).first()
        low = -math.inf if ends[0] == 0.0 else sketch[0]
        high = math.inf if ends[1] == 1.0 else sketch[1]
        inside: Column = F.when(value >= F.lit(low), value)
        counts = stage(own.filter(value <= F.lit(high)).groupBy(inside.alias("value")).agg(F.count("*").alias("n")), "bracket")
        below = counts.filter("value IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        placed = running_total(counts.filter("value IS NOT NULL"), [], ["value"], "n").withColumn("_from", F.col("before") + below)
        wanted = sorted({math.floor(place), math.ceil(place)})
        hit = F.greatest(*[((F.col("_from") <= w) & (F.col("_from") + F.col("n") > w)).cast("int") for w in (wanted[0], wanted[-1])]) == 1
        found = {w: r["value"] for r in placed.filter(hit).collect() for w in wanted if r["_from"] <= w < r["_from"] + r["n"]}
        if len(found) == len(wanted):
            first, last = found[wanted[0]], found[wanted[-1]]
            return first + (last - first) * (place - wanted[0]) if first != last else first
        spread *= 8
