"""The rows around many alerts, each stored once.

When alerts come in a storm their surroundings overlap, and repeating every event for each alert grows with both.
A sweep over the ends of the intervals cuts time into segments inside which the set of alerts is the same. An event
lies in one segment; an alert is a range of segments. What is stored grows with events plus alerts, and
the pairs can be listed from it where they are wanted.

A segment is named by the time (microseconds) at which it begins. None that an alert covers is longer than an
alert's surroundings, so an event finds its segment in its own time bucket of that length or in the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .alerts import MINUTE
from .ranges import running_total


def alert_ranges(alerts: DataFrame, minutes: int = 5, alert_id: str = "alert_id", ts: str = "event_ts") -> DataFrame:
    """``alert_id``, ``alert_ts``, and the first and last time at which its segments may begin."""
    t0 = F.unix_micros(F.col(ts))
    return alerts.filter(F.col(ts).isNotNull()).select(
        F.col(alert_id).alias("alert_id"), F.col(ts).alias("alert_ts"),
        (t0 - minutes * MINUTE).alias("first_segment"), (t0 + minutes * MINUTE).alias("last_segment"),
    )


def sweep(alerts: DataFrame, minutes: int = 5, alert_id: str = "alert_id", ts: str = "event_ts") -> DataFrame:
    """Where segments begin: ``segment`` and ``n_alerts``, the number of alerts that cover it (0: none).

    The ends of intervals are added up per time, then summed along the time by ranges of it, in no single task.
    """
    ranges = alert_ranges(alerts, minutes, alert_id, ts)
    ends = F.array(
        F.struct(F.col("first_segment").alias("segment"), F.lit(1).alias("by")),
        F.struct((F.col("last_segment") + 1).alias("segment"), F.lit(-1).alias("by")),
    )
    changes = ranges.select(F.inline(ends)).groupBy("segment").agg(F.sum("by").alias("by"))
    return running_total(changes, [], ["segment"], "by").select("segment", (F.col("before") + F.col("by")).alias("n_alerts"))


def segment_context(
    events: DataFrame, alerts: DataFrame, minutes: int = 5, alert_id: str = "alert_id", ts: str = "event_ts", salt: int = 1,
    uid: str = "event_uid",
) -> DataFrame:
    """The events within ``minutes`` of any alert, once each, with ``segment`` and ``n_alerts``.

    Beginnings and events are sorted together inside their bucket, and each event takes the last beginning.
    The last beginning of a bucket goes on into the next. With ``salt`` the events of a bucket are spread over
    that many tasks and its beginnings repeated.
    """
    width = 2 * minutes * MINUTE + 1
    begins = stage(sweep(alerts, minutes, alert_id, ts), "segments")
    bucket = lambda t: t - F.pmod(t, F.lit(width))
    own = begins.select(bucket(F.col("segment")).alias("_bucket"), "segment", "n_alerts")
    carried = own.groupBy("_bucket").agg(F.max(F.struct("segment", "n_alerts")).alias("_last")).select(
        (F.col("_bucket") + width).alias("_bucket"), "_last.*"
    )
    each = F.explode(F.sequence(F.lit(0), F.lit(salt - 1)).cast("array<bigint>")) if salt > 1 else F.lit(0).cast("bigint")
    marks = own.unionByName(carried).select("_bucket", each.alias("_salt"), F.struct("segment", "n_alerts").alias("_mark"), F.col("segment").alias("_t"))
    near = events.filter(F.col(ts).isNotNull()).withColumn("_t", F.unix_micros(ts)).withColumn("_bucket", bucket(F.col("_t")))
    part: Column = F.pmod(F.xxhash64(uid), F.lit(salt)) if salt > 1 else F.lit(0)
    near = near.withColumn("_salt", part.cast("bigint"))
    # a bucket that no alert touches holds no context: its events need not be sorted
    touched = marks.select("_bucket").distinct()
    both = near.join(touched, "_bucket", "left_semi").unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy("_bucket", "_salt").orderBy("_t", F.col("_mark").isNull())
    found = both.withColumn("_in", F.last("_mark", ignorenulls=True).over(order)).filter(F.col("_mark").isNull())
    return found.filter(F.col("_in.n_alerts") > 0).select(
        *events.columns, F.col("_in.segment").alias("segment"), F.col("_in.n_alerts").alias("n_alerts")
    )


def listed_pairs(context: DataFrame, ranges: DataFrame, minutes: int = 5) -> DataFrame:
    """Every alert with every event around it, from ``segment_context`` and ``alert_ranges``.

    Segments, not events, are matched with alerts, by buckets of the length of an alert's surroundings.
    """
    width = 2 * minutes * MINUTE + 1
    segments = context.select("segment").distinct().withColumn("_bucket", F.col("segment") - F.pmod("segment", F.lit(width)))
    first = F.col("first_segment") - F.pmod("first_segment", F.lit(width))
    reach = ranges.withColumn("_bucket", F.explode(F.array(first, first + width)))
    held = reach.join(segments, "_bucket").filter(F.col("segment").between(F.col("first_segment"), F.col("last_segment")))
    return context.join(held.select("alert_id", "alert_ts", "segment"), "segment").select(
        "alert_id", "alert_ts", *[c for c in context.columns if c not in ("segment", "n_alerts")]
    )
