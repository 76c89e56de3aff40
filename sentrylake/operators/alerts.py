"""Alert selection, the rows around an alert, and the report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .quantiles import threshold

MINUTE = 60_000_000


def select_alerts(
    scores: DataFrame,
    score: str = "anom_score",
    top_n: int | None = 10,
    method: str = "quantile",
    contamination: float = 0.05,
    uid: str = "event_uid",
) -> DataFrame:
    """The ``top_n`` highest scores at or above the threshold, with the threshold attached.

    ``top_n=None`` gives all rows at or above the threshold. The threshold is one number, worked out
    first; ``scores`` is read for it and again for the filter, so scores of a model should be a written table.
    """
    limit = F.lit(threshold(scores, score, method, contamination)).cast("double")
    over = scores.filter(F.col(score) >= limit).withColumn("threshold", limit)
    if top_n is None:
        return over
    return over.orderBy(F.col(score).desc(), F.col(uid)).limit(top_n)


def alert_table(alerts: DataFrame, score: str = "anom_score") -> DataFrame:
    """The report columns; a missing host or user prints as ``unknown``."""
    return alerts.fillna("unknown", ["host_name", "user_name"]).select(
        "event_uid", "event_ts", "host_name", "user_name", "source_ip", "destination_ip", score
    )


def alert_context(
    events: DataFrame,
    alerts: DataFrame,
    minutes: int = 5,
    alert_id: str = "alert_id",
    ts: str = "event_ts",
    salt: int = 1,
    uid: str = "event_uid",
    carry: Sequence[str] = (),
) -> DataFrame:
    """All events within ``minutes`` of an alert (both ends included), with ``alert_id`` and ``alert_ts``.

    ``carry`` names further columns of the alerts: what depends on the alert alone is worked out once per
    alert and not per pair, of which there are far more.

    An interval join as an equi-join: time is cut into buckets of the interval's length, each
    alert is repeated for the three buckets it can reach, and the exact bounds are tested after
    the join on day and bucket. With ``salt`` 1 no hint is given: alerts that come out of a ``limit`` have a
    known small size, so Catalyst broadcasts them and prunes the event days. A larger ``salt`` is for alert
    sets without limit: both sides are shuffled, and each bucket of events is spread over that many tasks
    (the alerts, the smaller side, are repeated), for the case that one bucket is hot.
    """
    width = minutes * MINUTE
    t0 = F.unix_micros(F.col(ts))

    first = t0 - F.lit(width) - F.pmod(t0 - F.lit(width), F.lit(width))
    reach = alerts.select(
        F.col(alert_id).alias("alert_id"),
        F.col(ts).alias("alert_ts"),
        t0.alias("_t0"),
        *carry,
        F.explode(F.sequence(first, first + F.lit(2 * width), F.lit(width))).alias("_bucket"),
    )
    near = events.withColumn("_t", t0).withColumn("_bucket", F.col("_t") - F.pmod(F.col("_t"), F.lit(width)))
    on = ["_bucket"]
    if "dt" in events.columns:
        reach = reach.withColumn("dt", F.to_date(F.timestamp_micros("_bucket")))
        on.append("dt")
    if salt > 1:
        near = near.withColumn("_salt", F.pmod(F.xxhash64(uid), F.lit(salt)))
        reach = reach.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)).cast("array<bigint>")))
        reach = reach.hint("merge")  # both sides grow with the data
        on.append("_salt")
    joined = near.join(reach, on).filter(F.abs(F.col("_t") - F.col("_t0")) <= width)
    return joined.select("alert_id", "alert_ts", *carry, *[F.col(c) for c in events.columns])


def first_rows(context: DataFrame, k: int = 200, ts: str = "event_ts", uid: str = "event_uid") -> DataFrame:
    """The first ``k`` context rows of each alert by time, with their ``position``.

    Spark cuts each map task to ``k`` rows per alert before the shuffle (k up to 1,000).
    """
    order = Window.partitionBy("alert_id").orderBy(F.col(ts), F.col(uid))
    return context.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def last_rows(
    df: DataFrame, key: str = "host_name", k: int = 200, ts: str = "event_ts", uid: str = "event_uid"
) -> DataFrame:
    """The latest ``k`` rows of every key; position 1 is the latest."""
    order = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(uid).desc())
    return df.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def rows_of_host(scores: DataFrame, host: str) -> DataFrame:
    """The rows of one host; a missing host is called ``unknown``."""
    own = F.col("host_name") == host  # on the stored column, so that it reaches the scan
    if host == "unknown":
        own = own | F.col("host_name").isNull()
    return scores.filter(own).fillna("unknown", ["host_name", "user_name"])


def host_list(scores: DataFrame) -> DataFrame:
    """All host names, sorted; a missing one counts as ``unknown``."""
    return scores.select(F.coalesce("host_name", F.lit("unknown")).alias("host_name")).distinct().orderBy("host_name")


def overview(scores: DataFrame, score: str = "anom_score") -> DataFrame:
    """One row: number of scored rows, highest score, first and last time."""
    return scores.agg(
        F.count("*").alias("n_rows"),
        F.max(score).alias("max_score"),
        F.min("event_ts").alias("first_ts"),
        F.max("event_ts").alias("last_ts"),
    )


def timeline(scores: DataFrame, score: str = "anom_score", uid: str = "event_uid") -> DataFrame:
    """Scores in time order. The id makes the order total, so equal times spread over tasks."""
    return scores.select(uid, "event_ts", score).orderBy("event_ts", uid)
