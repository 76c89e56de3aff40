"""Rolling sums of 0/1 flags per key over the last minutes, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MINUTE = 60_000_000


def rolling_counts(
    df: DataFrame,
    keys: list[str],
    flags: list[str],
    windows: list[int],
    suffix: str = "",
    reset_daily: bool = True,
    ts: str = "event_ts",
    dt: str = "dt",
    source: DataFrame | None = None,
    chunk_minutes: int = 15,
) -> DataFrame:
    """Add ``<flag>_count_<w>m<suffix>``: sum of the flag over (t - w, t] per key.

    All rows of one time count for each other. Rows with a null key get 0.0. With
    ``reset_daily`` a window does not reach back over midnight. ``source`` may name a cheaper frame
    with the same rows to count from, when ``df`` already has a long plan behind it.

    A sliding RANGE frame would put a key into one task and re-add the whole frame on every row.
    Here each flagged time adds +f when it happens and -f when it leaves the window, so the count
    is one running sum. It is cut into chunks of ``chunk_minutes``, whatever the windows are: times are
    summed inside their chunk, and one row per key and chunk carries the sums of the chunks before, so
    a hot key spreads over its chunks. Copies of a time collapse in the map-side part of the
    aggregation before any shuffle, and the counts return to the rows by an equi-join on key and time,
    which AQE splits if one time is hot.
    """
    chunk = chunk_minutes * MINUTE
    scope = keys + ([dt] if reset_daily else [])
    us = F.unix_micros(F.col(ts))

    # steps of a time: 0 is its arrival, w its end in that window
    arrival, flagged = F.array(F.lit(0)), F.array(F.lit(0), *[F.lit(w) for w in windows])
    any_flag = F.greatest(*[F.abs(F.col(f)) for f in flags], F.lit(0)) > 0
    step = F.col("step")
    rows = df if source is None else source
    points = (
        rows.filter(F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull())
        .select(
            *scope, us.alias("us"), *[F.coalesce(F.col(f), F.lit(0)).cast("long").alias(f) for f in flags]
        )
        .select("*", F.explode(F.when(any_flag, flagged).otherwise(arrival)).alias("step"))
        .withColumn("t", F.col("us") + step.cast("long") * F.lit(MINUTE))
        .withColumn("chunk", F.col("t") - F.pmod("t", F.lit(chunk)))
        # said here, not left to the join below, so that both uses of the step table share its shuffle
        .filter(F.col("chunk").isNotNull())
    )
    if reset_daily:
        points = points.filter(F.to_date(F.timestamp_micros("t")) == F.col(dt))

    def change(flag: str, w: int) -> Column:
        return F.when(step == 0, F.col(flag)).when(step == w, -F.col(flag)).otherwise(F.lit(0))

    names = [f"{f}_count_{w}m{suffix}" for w in windows for f in flags]
    changes = points.groupBy(*scope, "chunk", "t").agg(
        F.max(step == 0).alias("is_event"),
        *[F.sum(change(f, w)).alias(f"{f}_count_{w}m{suffix}") for w in windows for f in flags],
    )
    inside = Window.partitionBy(*scope, "chunk").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*scope).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        # is_event is asked for here too, for the same reason
        changes.groupBy(*scope, "chunk").agg(*[F.sum(name).alias(name) for name in names], F.max("is_event").alias("_events"))
        .select(*scope, "chunk", "_events", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_{name}") for name in names])
    )
    running = changes.select(*scope, "chunk", "t", "is_event", *[F.sum(name).over(inside).alias(name) for name in names])
    counts = (
        running.filter("is_event").join(carried.filter("_events IS NOT NULL"), [*scope, "chunk"])
        .select(*scope, "t", *[(F.col(name) + F.col(f"_{name}")).cast("double").alias(name) for name in names])
    )
    return _attach(df, counts, scope, us, names)


def _attach(df: DataFrame, counts: DataFrame, scope: list[str], us: Column, names: list[str]) -> DataFrame:
    left = df.withColumn("_us", us).alias("l")
    right = counts.alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in scope] + [F.col("l._us") == F.col("r.t")]
    return left.join(right, on, "left").select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[F.coalesce(F.col(f"r.{name}"), F.lit(0.0)).alias(name) for name in names],
    )


def rolling_rates(df: DataFrame, flags: list[str], windows: list[int], suffix: str = "") -> DataFrame:
    """Add ``<flag>_rate_<w>m<suffix>``: the rolling count per minute."""
    return df.withColumns(
        {
            f"{f}_rate_{w}m{suffix}": F.col(f"{f}_count_{w}m{suffix}") / F.lit(float(w))
            for w in windows
            for f in flags
        }
    )
