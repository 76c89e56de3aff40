"""Text logs: syslog authentication lines and Windows servicing (CBS/CSI) lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.once import with_once
from ..functions.text import ACCEPTED_USER, CBS_LINE, FAILED_USER, SYSLOG_LINE, extract, first_ipv4
from ..functions.values import month_number, syslog_time, utc_time
from ..schema import conform
from ..session import stage
from .files import text_lines


CHUNK = 1 << 16  # lines whose years are worked out together
HALF = 6  # months: a jump by so many or more is a turn of the year


def with_years(lines: DataFrame, last_year: int) -> DataFrame:
    """Add ``line_year`` to ``value``, ``file_path``, ``file_at`` and ``row``: the year of each syslog line.

    A syslog line has no year, but its file is in order: where the month falls by half a year or more the year has
    turned, where it rises by as much (a line out of order) it has turned back. The last line of a file is of
    ``last_year``. Lines are ordered by file, place of their split in it (``file_at``) and number inside that
    (``row``). Turns are added up inside chunks of lines; one row per chunk carries them on along the file.
    """
    known = with_once(lines, _month=F.nullif(month_number(F.regexp_extract("value", SYSLOG_LINE, 1)), F.lit(0)))
    rows = stage(known.withColumn("_chunk", F.floor(F.col("row") / CHUNK)), "log-lines")
    chunk = ["file_path", "file_at", "_chunk"]

    def turned(now: Column, before: Column) -> Column:
        return F.coalesce(F.when(before - now >= HALF, 1).when(now - before >= HALF, -1), F.lit(0))

    dated = rows.filter(F.col("_month").isNotNull()).select(*chunk, "row", "_month")
    inside = Window.partitionBy(*chunk).orderBy("row")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    turns = dated.withColumn("_turn", turned(F.col("_month"), F.lag("_month").over(inside))).withColumn("_turns", F.sum("_turn").over(upto))
    ends = turns.groupBy(*chunk).agg(
        F.min_by("_month", "row").alias("first"), F.max_by("_month", "row").alias("last"), F.max_by("_turns", "row").alias("_inside")
    )
    along = Window.partitionBy("file_path").orderBy("file_at", "_chunk")
    border = ends.withColumn("_border", turned(F.col("first"), F.lag("last").over(along)))
    sums = border.withColumn("_upto", F.sum(F.col("_border") + F.col("_inside")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = sums.withColumn("_all", F.last("_upto").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    bases = stage(whole.select(*chunk, (F.col("_upto") - F.col("_inside") - F.col("_all")).alias("_base")), "log-years")
    years = turns.join(bases, chunk).select("file_path", "file_at", "row", (last_year + F.col("_base") + F.col("_turns")).cast("int").alias("line_year"))
    return rows.drop("_month", "_chunk").join(years, ["file_path", "file_at", "row"], "left")


def parse_log_lines(
    lines: DataFrame, default_year: int, tz: str = "UTC", host: str | None = None
) -> DataFrame:
    """Events from ``value`` (and ``file_path``): syslog layout first, else CBS, else dropped.

    ``default_year`` completes syslog times unless the lines have a ``line_year``, ``tz`` is their zone, ``host``
    names the machine of the CBS lines, which carry none.
    """
    line = F.col("value")

    def groups(pattern: str, n: int) -> Column:
        # a line holds no newline, so it can separate the groups of one replacement
        return F.split(F.regexp_replace(line, pattern, "\n".join(f"${i}" for i in range(1, n + 1))), "\n", n)

    path = F.col("file_path") if "file_path" in lines.columns else F.lit(None).cast("string")
    kind = F.when(line.rlike(SYSLOG_LINE), "syslog").when(line.rlike(CBS_LINE), "cbs")
    year = F.col("line_year") if "line_year" in lines.columns else F.lit(default_year)
    known = with_once(lines.select(line, path.alias("log_file_path"), year.alias("_year")), kind=kind).filter(F.col("kind").isNotNull())
    is_syslog = F.col("kind") == "syslog"
    split = with_once(known, part=F.when(is_syslog, groups(SYSLOG_LINE, 6)).otherwise(groups(CBS_LINE, 4)))
    part = F.col("part")
    text = with_once(
        split,
        message=F.when(is_syslog, part[5]).otherwise(part[3]),
        process_name=F.when(is_syslog, part[4]).otherwise(part[2]),
        event_ts=F.when(is_syslog, syslog_time(part[0], part[1], part[2], F.col("_year"), tz)).otherwise(
            utc_time(F.regexp_replace(part[0], r"(?U)\s+", " "))
        ),
        host_name=F.when(is_syslog, part[3]).otherwise(F.lit(host)),
        level=F.when(~is_syslog, part[1]),
    ).filter(F.col("event_ts").isNotNull())

    message, component = F.col("message"), F.col("process_name")
    failed = message.contains("Failed password") | message.contains("authentication failure")
    accepted = message.contains("Accepted ")
    servicing = component.contains("CBS") | component.contains("CSI")
    events = text.select(
        "event_ts", "host_name", "process_name", "message", "log_file_path",
        F.when(is_syslog, "syslog").otherwise("windows").alias("event_module"),
        F.when(is_syslog, "auth").otherwise("cbs").alias("event_dataset"),
        F.when(is_syslog, "user_login").when(servicing, "system_update").otherwise("log_event").alias("event_action"),
        F.when(is_syslog, F.when(failed, "Failure").when(accepted, "Success"))
        .when(message.contains("Failed") | message.contains("Error"), "Failure")
        .otherwise(F.col("level"))
        .alias("event_outcome"),
        F.when(is_syslog & failed, extract(message, FAILED_USER))
        .when(is_syslog & accepted, extract(message, ACCEPTED_USER))
        .alias("user_name"),
        first_ipv4(message).alias("source_ip"),
    )
    return conform(events)


def read_logs(
    spark: SparkSession, root: str, default_year: int, tz: str = "UTC", host: str | None = None, pattern: str = "*.log",
    over_new_year: bool = False,
) -> DataFrame:
    """All log files (``*.log``) below a folder as events.

    With ``over_new_year`` the year of syslog lines is counted back from ``default_year``, that of the last line
    of each file; otherwise all lines are of that year.
    """
    lines = text_lines(spark, root, pattern, recursive=True, places=over_new_year)
    return parse_log_lines(with_years(lines, default_year) if over_new_year else lines, default_year, tz, host)
