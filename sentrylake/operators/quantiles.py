"""Exact linear-interpolated quantiles, thresholds and robust scaling, at any size."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

BUCKETS = 4096  # per bucket that is looked into, in one pass
FEW = 100_000  # rows of a bucket from which its values are counted one by one


@dataclass
class _Sought:
    """A rank of a column, and the range of values that holds it."""

    feature: str
    rank: int
    low: float
    high: float
    before: int
    inside: int

    def split(self) -> bool:
        return self.low < self.high


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """One row per column: ``feature``, ``n`` and ``q0``, ``q1``, ... in the order of ``probs``.

    The built-in exact ``percentile`` merges every distinct value into one task. Here each pass counts
    values per bucket (map-side: what is shuffled is counts, never rows) and goes on with the buckets that
    hold a sought rank, until such a bucket holds one value, or so few rows that its values can be
    counted. Each pass reads ``df`` again, so a costly input should be written first. Nulls are
    ignored. Per pass the driver gets one row per sought rank.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    values = df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
    spans = {
        row["feature"]: row
        for row in values.groupBy("feature").agg(
            F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
        ).collect()
    }
    sought = {}
    for feature, span in spans.items():
        for p in probs:
            place = (span["n"] - 1) * p
            for rank in (math.floor(place), math.ceil(place)):
                sought[feature, rank] = _Sought(feature, rank, span["low"], span["high"], 0, span["n"])
    while todo := {(s.feature, s.low, s.high): s for s in sought.values() if s.split()}:
        found = _look_into(values, list(todo.values()), [s for s in sought.values() if s.split()])
        for (feature, rank), (low, high, before, inside) in found.items():
            sought[feature, rank] = _Sought(feature, rank, low, high, before, inside)

    def quantile(feature: str, n: int, p: float) -> float:
        place = (n - 1) * p
        low, high = sought[feature, math.floor(place)].low, sought[feature, math.ceil(place)].low
        return low + (high - low) * (place - math.floor(place)) if low != high else low

    rows = [(f, span["n"], *[quantile(f, span["n"], p) for p in probs]) for f, span in spans.items()]
    schema = ", ".join(["feature string", "n bigint", *[f"q{i} double" for i in range(len(probs))]])
    return df.sparkSession.createDataFrame(rows, schema)


def _look_into(
    values: DataFrame, ranges: list[_Sought], sought: list[_Sought]
) -> dict[tuple[str, int], tuple[float, float, int, int]]:
    """One pass: (feature, rank) -> the narrower range that holds it (low, high, rows before, rows inside).

    A range of few rows is cut at each of its values, any other into BUCKETS parts; its smallest and largest
    value have parts of their own, so every pass narrows.
    """
    spark = values.sparkSession
    table = F.broadcast(spark.createDataFrame(  # one row per sought rank at most
        [(r.feature, r.low, r.high, r.before, r.inside) for r in ranges],
        "feature string, low double, high double, before bigint, inside bigint",
    ))
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    share = F.nanvl((value / 2 - low / 2) / (high / 2 - low / 2), F.lit(0.5))
    part = (
        F.when(F.col("inside") <= FEW, value).when(value == low, F.lit(-1.0)).when(value == high, F.lit(float(BUCKETS)))
        .otherwise(F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (BUCKETS - 1)).cast("double"))
    )
    counts = (
        values.join(table, "feature").filter((value >= low) & (value <= high))
        .groupBy("feature", "low", "high", "before", part.alias("part"))
        .agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    )
    scope = Window.partitionBy("feature", "low", "high").orderBy("part")
    placed = counts.withColumn("upto", F.col("before") + F.sum("n").over(scope))
    wanted = F.broadcast(spark.createDataFrame(
        [(s.feature, s.low, s.high, s.rank) for s in sought], "feature string, low double, high double, rank bigint"
    ))
    hit = placed.join(wanted, ["feature", "low", "high"]).filter(
        (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
    )
    return {
        (r["feature"], r["rank"]): (r["least"], r["most"], r["upto"] - r["n"], r["n"]) for r in hit.collect()
    }


def score_threshold(
    scores: DataFrame, column: str, method: str = "quantile", contamination: float = 0.05
) -> DataFrame:
    """One row: ``threshold`` and ``n_over``, the number of rows at or above it.

    ``quantile``: the exact (1 - contamination) quantile; any other name: mean + sample deviation.
    """
    limit = threshold(scores, column, method, contamination)
    return scores.agg(
        F.lit(limit).cast("double").alias("threshold"),
        F.count_if(F.col(column) >= F.lit(limit).cast("double")).cast("long").alias("n_over"),
    )


def threshold(scores: DataFrame, column: str, method: str = "quantile", contamination: float = 0.05) -> float | None:
    """The threshold of ``score_threshold`` alone; None if there are no scores."""
    if method == "quantile":
        row = exact_quantiles(scores, [column], [1.0 - contamination]).select("q0").first()
    else:
        row = scores.agg(F.avg(column) + F.stddev_samp(column)).first()
    return row[0] if row else None


@dataclass(frozen=True)
class RobustScaler:
    """(x - median) / IQR per column; an IQR of 0 scales by 1. Nulls count as 0."""

    centers: dict[str, float]
    scales: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> "RobustScaler":
        rows = robust_parameters(df, columns).collect()  # one row per column
        return cls(
            {row["feature"]: row["median"] for row in rows}, {row["feature"]: row["scale"] for row in rows}
        )

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(self.centers[c]))
                / F.lit(self.scales[c])
                for c in self.centers
            }
        )


def robust_parameters(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature``, ``median``, ``iqr``, ``scale`` per column; nulls count as 0."""
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    quartiles = exact_quantiles(filled, columns, [0.25, 0.5, 0.75])
    iqr = F.col("q2") - F.col("q0")
    return quartiles.select(
        "feature", F.col("q1").alias("median"), iqr.alias("iqr"), F.when(iqr == 0, 1.0).otherwise(iqr).alias("scale")
    )
