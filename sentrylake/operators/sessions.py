"""Inactivity sessions per flow key, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import FLOW_KEYS
from ..session import stage
from .ranges import running_total

SECOND = 1_000_000
NUMBERS = ["session_ordinal", "session_number"]


def key_text(keys: list[str]) -> Column:
    """One text per key; nulls count as equal. Sorts like the columns one after the other."""
    return F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def _numbered_times(
    df: DataFrame, scope: list[str], timeout_seconds: float, chunk_minutes: int, ts: str, dense: bool
) -> DataFrame:
    """(key, time) -> ordinal of its session; with ``dense`` also its number over all keys.

    Times are cut into chunks so that a hot key is many window groups. Inside a chunk gaps are
    found by ``lag``; between chunks only one summary row per chunk (first, last, breaks) is
    needed, and a second window over these few rows says whether the first time of a chunk
    opens a session and how many sessions came before it.
    """
    chunk = chunk_minutes * 60 * SECOND
    timeout = F.lit(int(timeout_seconds * SECOND))
    times = (
        df.select(*scope, F.unix_micros(F.col(ts)).alias("t"))
        .distinct()
        .withColumn("chunk", F.col("t") - F.pmod(F.col("t"), F.lit(chunk)))
        # said here, not left to the join below, so that both uses of the times share their shuffles
        .filter(F.col("chunk").isNotNull())
    )
    inside = Window.partitionBy(*scope, "chunk").orderBy("t")
    gaps = times.withColumn(
        "breaks", F.coalesce((F.col("t") - F.lag("t").over(inside) > timeout).cast("long"), F.lit(0))
    )
    local = gaps.withColumn("inner", F.sum("breaks").over(inside.rowsBetween(Window.unboundedPreceding, 0)))

    chunks = local.groupBy(*scope, "chunk").agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.max("inner").alias("breaks")
    )
    along = Window.partitionBy(*scope).orderBy("chunk")
    opened = chunks.withColumn(
        "opens", F.coalesce((F.col("first") - F.lag("last").over(along) > timeout).cast("long"), F.lit(1))
    )
    based = opened.withColumn(
        "base",
        F.sum(F.col("opens") + F.col("breaks")).over(along.rowsBetween(Window.unboundedPreceding, 0))
        - F.col("breaks"),
    )
    if dense:
        based = _with_earlier(stage(based, "session-chunks"), scope)
    base = [c for c in ("base", "earlier") if c in based.columns]
    joined = local.join(based.select(*scope, "chunk", *base), [*scope, "chunk"])
    numbered = joined.withColumn("session_ordinal", F.col("base") + F.col("inner"))
    if dense:
        numbered = numbered.withColumn("session_number", F.col("earlier") + F.col("session_ordinal"))
    return numbered.select(*scope, "t", *[c for c in NUMBERS if c in numbered.columns])


def _with_earlier(chunks: DataFrame, scope: list[str]) -> DataFrame:
    """Add ``earlier``: the sessions of all keys sorted before this one (of the same day, if daily)."""
    per_key = chunks.groupBy(*scope).agg(F.sum(F.col("opens") + F.col("breaks")).alias("n_sessions"))
    starts = running_total(per_key, scope[:-1], scope[-1:], "n_sessions").withColumnRenamed("before", "earlier")
    return chunks.join(starts.select(*scope, "earlier"), scope)


def sessionize(
    df: DataFrame,
    keys: list[str] | None = None,
    timeout_seconds: float = 120,
    reset_daily: bool = True,
    dense: bool = False,
    chunk_minutes: int = 60,
    ts: str = "event_ts",
    dt: str = "dt",
) -> DataFrame:
    """Add ``session_ordinal`` (1, 2, ... per key) and text ``session_id``.

    A gap strictly longer than the timeout opens a new session. With ``reset_daily`` sessions
    end at midnight. ``dense`` adds ``session_number``: 1, 2, ... over all sessions of a day (or of
    everything), ordered by key and time.
    """
    keys = FLOW_KEYS if keys is None else keys
    scope = ([dt] if reset_daily else []) + ["_key"]
    keyed = df.withColumn("_key", key_text(keys))
    numbered = _numbered_times(keyed, scope, timeout_seconds, chunk_minutes, ts, dense)
    left = keyed.withColumn("_us", F.unix_micros(F.col(ts))).alias("l")
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in scope] + [F.col("l._us") == F.col("r.t")]
    out = left.join(numbered.alias("r"), on, "left").select(
        *[F.col(f"l.{c}") for c in df.columns], *[F.col(f"r.{c}") for c in NUMBERS if c in numbered.columns]
    )
    day = [F.col(dt).cast("string")] if reset_daily else []
    label = day + [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys] + [F.col("session_ordinal")]
    return out.withColumn("session_id", F.concat_ws("|", *label))
