"""The feature table: flags, entropy, session and rolling counts of every event."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.entropy import char_entropy
from ..functions.values import conn_suspicious, login_failed
from ..schema import ENTROPY, FLAGS, FLOW_KEYS, ID_COLUMNS, WINDOW_MINUTES, feature_names
from .rolling import rolling_counts
from .sessions import sessionize


def event_flags(events: DataFrame) -> DataFrame:
    """Add the two 0/1 flags."""
    return events.withColumns(
        {
            "login_failed": login_failed(F.col("event_code"), F.col("event_outcome")),
            "conn_suspicious": conn_suspicious(F.col("destination_port"), F.col("event_outcome")),
        }
    )


def feature_table(
    events: DataFrame,
    windows: list[int] | None = None,
    timeout_seconds: float = 120,
    reset_daily: bool = True,
    by_host: bool = False,
) -> DataFrame:
    """Ids and features of every event with a time. ``by_host`` adds the counts per host.

    The command line is reduced to its entropy before any shuffle, so only narrow rows move. The
    session and count lookups each read just their few columns of the events.
    """
    windows = WINDOW_MINUTES if windows is None else windows
    flagged = event_flags(events.filter(F.col("event_ts").isNotNull())).withColumn(
        ENTROPY, char_entropy(F.col("process_command_line"))
    )
    ids = [c for c in ID_COLUMNS if c != "session_id"]
    narrow = flagged.select(*dict.fromkeys(ids + FLOW_KEYS), *FLAGS, ENTROPY)
    sessions = sessionize(narrow, FLOW_KEYS, timeout_seconds, reset_daily)
    counted = rolling_counts(
        sessions, ["user_name"], FLAGS, windows, reset_daily=reset_daily, source=narrow
    )
    extra = []
    if by_host:
        counted = rolling_counts(
            counted, ["host_name"], FLAGS, windows, "_by_host", reset_daily, source=narrow
        )
        extra = [f"{f}_count_{w}m_by_host" for w in windows for f in FLAGS]
    return counted.select(*ID_COLUMNS, *feature_names(windows), *extra)
