"""Queries over a store that grows: batches, streams of files, carried state, segments of context, skipped files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.alerts import select_alerts
from ..operators.carried import advance, labelled_rows
from ..operators.daily import days_between, overview_of_days, quantile_of_days, refresh_days
from ..operators.features import event_flags
from ..operators.segments import segment_context
from ..schema import FLAGS, STORE_SCHEMA
from ..session import new_folder
from ..sources.batches import append_batch, merge_batches, read_batches
from ..sources.jsonl import ZEEK_CONN
from ..sources.skipping import build_index, cluster_by_host, host_rows_indexed
from ..sources.logs import read_logs
from ..sources.store import union_sources, write_days
from ..streaming.files import available, json_reader, log_reader
from .features import _counts_sql
from .ingest import _zeek_lines
from .views import EVENTS_SQL, day_sql, events, report, ts_sql

_STORE_COLUMNS = ["source", "dt", "event_ts", "host_name", "user_name", "event_code", "event_outcome"]


def store_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping batches, each appended twice and one again under another name, then merged."""
    v0, root = events(spark, sf_dir), new_folder(spark, "batches")
    for upto in range(3):
        rows = v0.filter(F.col("event_uid") % 3 <= upto)
        for _ in range(2):
            append_batch(union_sources({"windows_evtx": rows}), root, f"upto-{upto}")
    append_batch(union_sources({"windows_evtx": v0.filter("event_uid % 2 = 0"), "sysmon": v0.filter("event_uid % 2 = 1")}), root, "again")
    merge_batches(spark, root, "merged")
    return report(read_batches(spark, root).select(*_STORE_COLUMNS))


STORE_BATCHES = f"""
WITH {EVENTS_SQL}
SELECT 'windows_evtx' AS source, {day_sql()} AS dt, {ts_sql('event_ts')} AS event_ts, host_name, user_name, event_code, event_outcome FROM v0
UNION ALL
SELECT 'sysmon', {day_sql()}, {ts_sql('event_ts')}, host_name, user_name, event_code, event_outcome FROM v0 WHERE event_uid % 2 = 1"""


def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines that arrive in three drops and logs that arrive in two, each drop read twice."""
    v0, root = events(spark, sf_dir), new_folder(spark, "stream")
    zeek = _zeek_lines(v0).select("event_uid", "value")
    stamp = F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss")
    cbs = v0.select("event_uid", F.concat(stamp, F.lit(", Info                  CBS    Session "), F.col("event_uid").cast("string")).alias("value"))
    sources = [
        ("zeek_conn", zeek, 3, json_reader(ZEEK_CONN), None), ("servicing", cbs, 2, log_reader(2024, host="node1"), "*.txt"),
    ]
    for name, lines, drops, reader, pattern in sources:
        for drop in range(drops):
            lines.filter(F.col("event_uid") % drops == drop).select("value").write.text(f"{root}/{name}/drop-{drop}")
            for _ in range(2):
                available(spark, name, f"{root}/{name}", reader, f"{root}/store", f"{root}/checkpoint", pattern)
    return report(read_batches(spark, f"{root}/store").select("source", "dt", "event_ts", "event_id", "source_ip", "event_outcome", "message"))


STREAM_FILES = f"""
WITH {EVENTS_SQL}
SELECT 'zeek_conn' AS source, {day_sql()} AS dt, {ts_sql('event_ts')} AS event_ts, 'C' || event_uid AS event_id, source_ip,
  event_outcome, NULL::VARCHAR AS message FROM v0
UNION ALL
SELECT 'servicing', {day_sql()}, {ts_sql("date_trunc('second', event_ts)")}, NULL, NULL, 'Info', 'Session ' || event_uid FROM v0"""

_CARRIED_WINDOWS = [15, 360, 1440]


def sessions_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and counts across days, worked out in three batches of which each sees only its own events."""
    v0 = event_flags(events(spark, sf_dir))
    rows = v0.select("event_uid", "event_ts", "user_name", "source_ip", "destination_ip", "network_transport", *FLAGS)
    first, last = rows.agg(F.min(F.to_date("event_ts")), F.max(F.to_date("event_ts"))).first()
    root, start = new_folder(spark, "carried"), first
    if first is None:
        return report(advance(rows, root, "none", dt.datetime(1970, 1, 1), timeout_seconds=7200, windows=_CARRIED_WINDOWS))
    for part in range(1, 4):
        end = first + dt.timedelta(days=((last - first).days + 1) * part // 3)
        own = rows.filter((F.to_date("event_ts") >= start) & (F.to_date("event_ts") < end))
        advance(own, root, f"part-{part}", dt.datetime(end.year, end.month, end.day), timeout_seconds=7200, windows=_CARRIED_WINDOWS)
        start = end
    names = [f"{f}_count_{w}m" for w in _CARRIED_WINDOWS for f in FLAGS]
    return report(labelled_rows(spark, root).select("event_uid", "session_ordinal", "session_id", *names))


_FLOW = "source_ip, destination_ip, network_transport"
SESSIONS_INCREMENTAL = f"""
WITH {EVENTS_SQL},
gaps AS (
  SELECT *, CASE WHEN epoch_us(event_ts) - lag(epoch_us(event_ts)) OVER (PARTITION BY {_FLOW} ORDER BY event_ts) <= 7200000000
    THEN 0 ELSE 1 END AS opens FROM v0),
sess AS (
  SELECT *, CAST(sum(opens) OVER (PARTITION BY {_FLOW} ORDER BY event_ts RANGE UNBOUNDED PRECEDING) AS BIGINT) AS session_ordinal FROM gaps)
SELECT event_uid, session_ordinal, concat_ws('|', {_FLOW}, session_ordinal) AS session_id,
  {_counts_sql(_CARRIED_WINDOWS, 'user_name', daily=False)} FROM sess"""


def alert_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event within 5 minutes of any row at or above the threshold, once, with its segment."""
    v0 = events(spark, sf_dir)
    found = segment_context(v0, select_alerts(v0, "score_proxy", None), 5, alert_id="event_uid", salt=4)
    return report(found.select("event_uid", "event_ts", F.timestamp_micros("segment").alias("segment"), "n_alerts"))


ALERT_SEGMENTS = f"""
WITH {EVENTS_SQL}, threshold AS (SELECT quantile_cont(score_proxy, 0.95) AS threshold FROM v0),
over AS (SELECT event_ts FROM v0, threshold WHERE score_proxy >= threshold),
ends AS (
  SELECT event_ts - INTERVAL 5 MINUTES AS segment FROM over
  UNION SELECT event_ts + INTERVAL 5 MINUTES + INTERVAL 1 MICROSECOND FROM over),
near AS (
  SELECT e.event_uid, e.event_ts, count(*) AS n_alerts FROM v0 e
  JOIN over a ON e.event_ts BETWEEN a.event_ts - INTERVAL 5 MINUTES AND a.event_ts + INTERVAL 5 MINUTES GROUP BY ALL)
SELECT event_uid, {ts_sql('event_ts')} AS event_ts, {ts_sql('segment')} AS segment, n_alerts
FROM near ASOF JOIN ends ON near.event_ts >= ends.segment"""


def host_rows_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of two hosts and of none, from the files of a store that an index names."""
    v0, root = events(spark, sf_dir), new_folder(spark, "indexed")
    rows = v0.withColumn("source", F.lit("events")).withColumn("host_name", F.when(F.col("k") != 50, F.col("host_name")))
    held = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in STORE_SCHEMA]
    cluster_by_host(rows.select(*held), f"{root}/store", files=24)
    build_index(spark, f"{root}/store", f"{root}/index")
    found = [host_rows_indexed(spark, f"{root}/store", f"{root}/index", host) for host in ("host3", None)]
    span = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9)
    found.append(host_rows_indexed(spark, f"{root}/store", f"{root}/index", "host7", *span))
    rows = found[0].unionByName(found[1]).unionByName(found[2])
    return report(rows.select(F.col("event_uid").cast("bigint").alias("event_uid"), "event_ts", "host_name", "user_name", "source_ip"))


HOST_ROWS_BY_INDEX = f"""
WITH {EVENTS_SQL}, h AS (SELECT * REPLACE (CASE WHEN k <> 50 THEN host_name END AS host_name) FROM v0)
SELECT event_uid, {ts_sql('event_ts')} AS event_ts, host_name, user_name, source_ip FROM h
WHERE host_name = 'host3' OR host_name IS NULL
  OR (host_name = 'host7' AND event_ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 00:00:00')"""

def _scored_days(spark: SparkSession, sf_dir: str) -> tuple[str, str, DataFrame]:
    """A score table by day and its summaries, of which one day was written later than the others."""
    root = new_folder(spark, "daily")
    rows = events(spark, sf_dir).select("event_uid", "event_ts", "dt", "host_name", F.col("score_proxy").alias("anom_score"))
    late = F.dayofmonth("dt") == 7
    for part in (rows.filter(~late), rows.filter(late)):
        write_days(part, f"{root}/scores", ["dt"], ["event_ts"])
        refresh_days(spark, f"{root}/scores", f"{root}/days")
    return f"{root}/scores", f"{root}/days", spark.read.parquet(f"{root}/scores")


SPANS = [(None, None), ("2024-01-05", "2024-01-14"), ("2030-01-01", None)]


def overview_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview of spans of days, from the summaries alone."""
    _, days, _ = _scored_days(spark, sf_dir)
    frames = [
        overview_of_days(days_between(spark, days, *span)).withColumn("span", F.lit(number)) for number, span in enumerate(SPANS)
    ]
    return report(frames[0].unionByName(frames[1]).unionByName(frames[2]))


def score_quantile_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact thresholds of spans of days, bracketed by their sketches."""
    _, days, scores = _scored_days(spark, sf_dir)
    rows = [(number, p, quantile_of_days(scores, days_between(spark, days, *span), p)) for number, span in enumerate(SPANS[:2]) for p in (0.5, 0.95, 1.0)]
    return report(spark.createDataFrame(rows, "span int, p double, threshold double"))


def _spans_sql() -> str:
    rows = ", ".join(f"({n}, DATE '{first or '0001-01-01'}', DATE '{last or '9999-12-31'}')" for n, (first, last) in enumerate(SPANS))
    return f"spans(span, first, last) AS (VALUES {rows})"


OVERVIEW_DAYS = f"""
WITH {EVENTS_SQL}, {_spans_sql()}
SELECT span, count(event_uid) AS n_rows, round(max(score_proxy), 6) AS max_score, {ts_sql('min(event_ts)')} AS first_ts,
  {ts_sql('max(event_ts)')} AS last_ts, count(DISTINCT host_name) AS n_hosts
FROM spans LEFT JOIN v0 ON dt BETWEEN first AND last GROUP BY span"""

SCORE_QUANTILE_DAYS = f"""
WITH {EVENTS_SQL}, {_spans_sql()}, ps(p) AS (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (1.0::DOUBLE))
SELECT span, p, round(CASE p WHEN 0.5 THEN quantile_cont(score_proxy, 0.5) WHEN 0.95 THEN quantile_cont(score_proxy, 0.95)
  ELSE max(score_proxy) END, 6) AS threshold
FROM spans JOIN v0 ON dt BETWEEN first AND last, ps WHERE span < 2 GROUP BY span, p"""


def syslog_new_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files of three machines that run from December to January, without a year in their lines."""
    v0, path = events(spark, sf_dir), new_folder(spark, "new-year")
    v0 = v0.withColumn("event_ts", F.col("event_ts") - F.expr("INTERVAL 15 DAYS"))
    stamp = F.concat(
        F.date_format("event_ts", "MMM"), F.lit(" "), F.lpad(F.date_format("event_ts", "d"), 2, " "), F.lit(" "), F.date_format("event_ts", "HH:mm:ss")
    )
    line = F.concat(stamp, F.lit(" "), "host_name", F.lit(" sshd[77]: session "), F.col("event_uid").cast("string"))
    noise = F.when(F.col("event_uid") % 10 == 0, F.array(line, F.lit("no time here"))).otherwise(F.array(line))
    for machine in range(3):
        own = v0.filter(F.col("event_uid") % 3 == machine).orderBy("event_ts", "event_uid").coalesce(1)
        own.select(F.explode(noise).alias("value")).write.text(f"{path}/machine{machine}.log")
    found = read_logs(spark, path, 2024, pattern="*.txt", over_new_year=True)
    return report(found.select("event_ts", "host_name", "message"))


SYSLOG_NEW_YEAR = f"""
WITH {EVENTS_SQL}
SELECT {ts_sql("date_trunc('second', event_ts - INTERVAL 15 DAYS)")} AS event_ts, host_name, 'session ' || event_uid AS message FROM v0"""

QUERIES = {
    "overview_days": (overview_days, OVERVIEW_DAYS),
    "score_quantile_days": (score_quantile_days, SCORE_QUANTILE_DAYS),
    "syslog_new_year": (syslog_new_year, SYSLOG_NEW_YEAR),
    "store_batches": (store_batches, STORE_BATCHES),
    "stream_files": (stream_files, STREAM_FILES),
    "sessions_incremental": (sessions_incremental, SESSIONS_INCREMENTAL),
    "alert_segments": (alert_segments, ALERT_SEGMENTS),
    "host_rows_indexed": (host_rows_by_index, HOST_ROWS_BY_INDEX),
}
