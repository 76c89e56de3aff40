"""Queries over thresholds, alerts, context, explanation, triage and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.alerts import (
    alert_context, alert_table, first_rows, host_list, last_rows, overview, rows_of_host, select_alerts, timeline,
)
from ..operators.evidence import (
    Run, bundle_documents, bundle_manifest, content_hashes, context_lines, custody_records, file_hashes,
)
from ..operators.explain import ACTIONS, explain_by_size, triage
from ..operators.features import feature_table
from ..operators.quantiles import score_threshold
from ..operators.sampling import capped
from ..schema import ECS_NAMES, ENTROPY
from ..session import prepare
from .features import FEATURES, FEATURES_SQL
from .views import EVENTS_SQL, day_sql, events, report, table, time_text, ts_sql

SCORE = "score_proxy"
_THRESHOLD_SQL = "threshold AS (SELECT quantile_cont(score_proxy, 0.95) AS threshold FROM v0)"
_OVER_SQL = f"{_THRESHOLD_SQL}, over AS (SELECT v0.*, threshold FROM v0, threshold WHERE score_proxy >= threshold)"
_TOP_SQL = f"{_OVER_SQL}, top AS (SELECT * FROM over ORDER BY score_proxy DESC, event_uid LIMIT 10)"


def _top(spark: SparkSession, sf_dir: str, top_n: int | None = 10) -> DataFrame:
    return select_alerts(events(spark, sf_dir), SCORE, top_n)


def score_threshold_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(score_threshold(events(spark, sf_dir), SCORE))


SCORE_THRESHOLD_QUANTILE = f"""
WITH {EVENTS_SQL}, {_THRESHOLD_SQL}
SELECT round(max(threshold), 6) AS threshold, count(*) FILTER (score_proxy >= threshold) AS n_over FROM v0, threshold"""


def score_threshold_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(score_threshold(events(spark, sf_dir), SCORE, method="mean_std"))


SCORE_THRESHOLD_MEAN_STD = f"""
WITH {EVENTS_SQL}, threshold AS (SELECT avg(score_proxy) + stddev_samp(score_proxy) AS threshold FROM v0)
SELECT round(max(threshold), 6) AS threshold, count(*) FILTER (score_proxy >= threshold) AS n_over FROM v0, threshold"""


def top_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_top(spark, sf_dir).select("event_uid", "event_ts", "event_code", SCORE, "threshold"))


TOP_ALERTS = f"""
WITH {EVENTS_SQL}, {_TOP_SQL}
SELECT event_uid, {ts_sql('event_ts')} AS event_ts, event_code, round(score_proxy, 6) AS score_proxy,
  round(threshold, 6) AS threshold FROM top"""


def alert_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows at or above the threshold as the report table."""
    return report(alert_table(_top(spark, sf_dir, None), SCORE))


ALERT_TABLE = f"""
WITH {EVENTS_SQL}, {_OVER_SQL}
SELECT event_uid, {ts_sql('event_ts')} AS event_ts, coalesce(host_name, 'unknown') AS host_name,
  coalesce(user_name, 'unknown') AS user_name, source_ip, destination_ip, round(score_proxy, 6) AS score_proxy
FROM over"""


def _context(spark: SparkSession, sf_dir: str, alerts: DataFrame, minutes: int, salt: int = 1) -> DataFrame:
    return alert_context(events(spark, sf_dir), alerts, minutes, alert_id="event_uid", salt=salt)


def alert_context_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = _context(spark, sf_dir, _top(spark, sf_dir), 5)
    return report(context.select("alert_id", "alert_ts", "event_uid", "event_ts", "host_name"))


def _context_sql(alerts: str, minutes: int) -> str:
    span = f"INTERVAL {minutes} MINUTES"
    return f"""context AS (
  SELECT a.event_uid AS alert_id, a.event_ts AS alert_ts, e.* FROM {alerts} a
  JOIN v0 e ON e.event_ts BETWEEN a.event_ts - {span} AND a.event_ts + {span})"""


_CONTEXT_COLUMNS = f"""alert_id, {ts_sql('alert_ts')} AS alert_ts, event_uid, {ts_sql('event_ts')} AS event_ts, host_name"""
ALERT_CONTEXT_5M = f"WITH {EVENTS_SQL}, {_TOP_SQL}, {_context_sql('top', 5)} SELECT {_CONTEXT_COLUMNS} FROM context"


def alert_context_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For all rows at or above the threshold, as a shuffled join with salted buckets.

    The pairs grow with the square of the events of a span of time, so times become text before they are paired.
    """
    rows = events(spark, sf_dir).withColumn("event_time", time_text("event_ts"))
    over = _top(spark, sf_dir, None).withColumn("alert_time", time_text("event_ts"))
    context = alert_context(rows, over, 5, alert_id="event_uid", salt=8, carry=["alert_time"])
    return report(
        context.select("alert_id", F.col("alert_time").alias("alert_ts"), "event_uid", F.col("event_time").alias("event_ts"), "host_name")
    )


ALERT_CONTEXT_BUCKETED = f"""
WITH {EVENTS_SQL}, {_OVER_SQL}, {_context_sql('over', 5)} SELECT {_CONTEXT_COLUMNS} FROM context"""


def alert_context_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 rows by time within 12 hours of each top alert."""
    preview = first_rows(_context(spark, sf_dir, _top(spark, sf_dir), 720), 200)
    return report(preview.select("alert_id", "position", "event_uid", "event_ts"))


ALERT_CONTEXT_PREVIEW = f"""
WITH {EVENTS_SQL}, {_TOP_SQL}, {_context_sql('top', 720)}
SELECT alert_id, row_number() OVER w AS position, event_uid, {ts_sql('event_ts')} AS event_ts FROM context
WINDOW w AS (PARTITION BY alert_id ORDER BY context.event_ts, event_uid) QUALIFY row_number() OVER w <= 200"""


def host_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = last_rows(events(spark, sf_dir), "host_name", 200)
    return report(rows.select("host_name", "position", "event_uid", "user_name", SCORE))


HOST_RECENT = f"""
WITH {EVENTS_SQL}
SELECT host_name, row_number() OVER w AS position, event_uid, user_name, round(score_proxy, 6) AS score_proxy FROM v0
WINDOW w AS (PARTITION BY host_name ORDER BY event_ts DESC, event_uid DESC) QUALIFY row_number() OVER w <= 200"""


def host_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(rows_of_host(events(spark, sf_dir), "host3").select("event_uid", "event_ts", "user_name", SCORE))


HOST_ROWS = f"""
WITH {EVENTS_SQL}
SELECT event_uid, {ts_sql('event_ts')} AS event_ts, coalesce(user_name, 'unknown') AS user_name,
  round(score_proxy, 6) AS score_proxy FROM v0 WHERE host_name = 'host3'"""


def overview_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(overview(events(spark, sf_dir), SCORE))


OVERVIEW_METRICS = f"""
WITH {EVENTS_SQL}
SELECT count(*) AS n_rows, round(max(score_proxy), 6) AS max_score, {ts_sql('min(event_ts)')} AS first_ts,
  {ts_sql('max(event_ts)')} AS last_ts FROM v0"""


def overview_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(timeline(events(spark, sf_dir), SCORE))


OVERVIEW_TIMELINE = f"""
WITH {EVENTS_SQL}
SELECT event_uid, {ts_sql('event_ts')} AS event_ts, round(score_proxy, 6) AS score_proxy FROM v0 ORDER BY 2, 1"""


def host_list_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(host_list(events(spark, sf_dir)))


HOST_LIST = f"WITH {EVENTS_SQL} SELECT DISTINCT coalesce(host_name, 'unknown') AS host_name FROM v0 ORDER BY 1"


def score_merge_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(capped(events(spark, sf_dir).select("event_uid", "dt", SCORE), 2_000))


SCORE_MERGE_CAP = f"""
WITH {EVENTS_SQL}
SELECT event_uid, {day_sql()} AS dt, round(score_proxy, 6) AS score_proxy FROM v0
ORDER BY md5(CAST(event_uid AS VARCHAR) || '42') LIMIT 2000"""


def abs_rank_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    explained = explain_by_size(feature_table(events(spark, sf_dir)), FEATURES)
    top = explained.select("event_uid", "note", F.posexplode("top_features").alias("rank", "top"))
    return report(
        top.select("event_uid", (F.col("rank") + 1).alias("rank"), F.col("top.feature").alias("feature"),
                   F.col("top.value").alias("value"), "note")
    )


_RANKED_SQL = f"""
ranked AS (
  SELECT event_uid, row_number() OVER (PARTITION BY event_uid ORDER BY abs(value) DESC, i) AS rank, feature, value
  FROM ({" UNION ALL ".join(
      f"SELECT event_uid, {i} AS i, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM features"
      for i, f in enumerate(FEATURES))}))"""

ABS_RANK_EXPLAIN = f"""
WITH {FEATURES_SQL}, {_RANKED_SQL}
SELECT event_uid, rank, feature, round(value, 6) AS value, 'fallback_no_shap' AS note FROM ranked WHERE rank <= 5"""


def _triaged(spark: SparkSession, sf_dir: str, top_n: int | None) -> DataFrame:
    """Alerts by ``value``, scaled to a score, with their features, explanation and triage."""
    scores = events(spark, sf_dir).select("event_uid", (F.col(SCORE) / 500).alias("anom_score"))
    alerts = select_alerts(scores, "anom_score", top_n)
    rows = feature_table(events(spark, sf_dir)).join(alerts, "event_uid").withColumns(
        {"threshold": F.round("threshold", 6), ENTROPY: F.round(ENTROPY, 6)}  # printed as text below
    )
    return triage(explain_by_size(rows, FEATURES), created_at="2025-01-01T00:00:00Z").withColumn(
        "alert_id", F.concat(F.lit("alert-"), F.col("event_uid").cast("string"))
    )


def alert_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _triaged(spark, sf_dir, None)
    iocs = F.transform("iocs", lambda x: F.concat_ws("=", x["type"], x["value"]))
    return report(
        rows.select(
            "event_uid", "anom_score", "risk_level", "reason", F.array_join(iocs, ";").alias("iocs"),
            F.array_join("actions", ";").alias("actions"), "markdown",
        )
    )


def _triage_sql(top_n: int | None) -> str:
    keep = f"ORDER BY score_proxy DESC, event_uid LIMIT {top_n}" if top_n else ""
    value = "printf('%+.3f', value)"
    return f"""
{FEATURES_SQL}, {_RANKED_SQL},
reasons AS (
  SELECT event_uid, string_agg(feature || '(' || {value} || ')', ', ' ORDER BY rank) AS reason
  FROM ranked WHERE rank <= 5 GROUP BY event_uid),
scored AS (SELECT event_uid, score_proxy, score_proxy / 500 AS anom_score FROM v0),
cut AS (SELECT quantile_cont(anom_score, 0.95) AS threshold FROM scored),
chosen AS (
  SELECT event_uid, anom_score, threshold FROM scored, cut WHERE anom_score >= threshold {keep}),
triaged AS (
  SELECT f.*, anom_score, threshold, reason,
    CASE WHEN anom_score >= 0.95 THEN 'HIGH' WHEN anom_score >= 0.85 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    strftime(event_ts, '%Y-%m-%d %H:%M:%S.%f+00:00') AS shown
  FROM chosen JOIN features f USING (event_uid) JOIN reasons USING (event_uid)),
written AS (
  SELECT *, '# AI Alert Analysis' || chr(10) || chr(10) || '- Time: ' || shown || chr(10) ||
    '- Score: ' || printf('%.4f', anom_score) || chr(10) || '- Risk: ' || risk_level || chr(10) ||
    '- Key contributors: ' || reason || chr(10) || chr(10) || '## Observations' || chr(10) ||
    '- Host: ' || coalesce(host_name, 'None') || ', User: ' || coalesce(user_name, 'None') || chr(10) ||
    '- SrcIP: ' || coalesce(source_ip, 'None') || ', DstIP: ' || coalesce(destination_ip, 'None') || chr(10) || chr(10) ||
    '## Recommended actions' || chr(10) || '- Triage related events ±5m.' || chr(10) ||
    '- Validate user/session and process lineage.' || chr(10) ||
    '- Contain host if malicious indicators confirmed.' || chr(10) AS markdown
  FROM triaged)"""


_ACTIONS_SQL = f"'{';'.join(ACTIONS)}'"

ALERT_TRIAGE = f"""
WITH {_triage_sql(None)}
SELECT event_uid, round(anom_score, 6) AS anom_score, risk_level, reason,
  concat_ws(';', 'source.ip=' || source_ip, 'destination.ip=' || destination_ip, 'host.name=' || host_name,
    'user.name=' || user_name) AS iocs,
  {_ACTIONS_SQL} AS actions, markdown
FROM written"""


def evidence_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(content_hashes(table(spark, sf_dir, "documents"), "text").select("doc_id", "sha256", "size"))


EVIDENCE_MANIFEST = "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size FROM documents"


def evidence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every given Parquet file with hash and size."""
    prepare(spark)
    return report(file_hashes(spark, sf_dir, "*.parquet"))


def custody_records_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def hashed(name: str, content: str, *keys: str) -> DataFrame:
        path = F.concat_ws("/", F.lit(name), *[F.col(k).cast("string") for k in keys])
        return content_hashes(table(spark, sf_dir, name), content).withColumn("path", path)

    run = Run("2025-01-01T00:00:00Z", "analyst", "node1")
    inputs = hashed("pages", "html", "page_id").unionByName(
        hashed("documents", "text", "doc_id"), allowMissingColumns=True
    )
    return report(custody_records(inputs, hashed("conversations", "text", "conv_id", "turn"), run))


CUSTODY_RECORDS = """
SELECT '2025-01-01T00:00:00Z' AS created_at, 'analyst' AS operator, 'node1' AS hostname, 'unknown' AS platform,
  'development' AS app_env, 'UTC' AS tz, role, path, sha256, size
FROM (
  SELECT 'input' AS role, 'pages/' || page_id AS path, sha256(html) AS sha256, strlen(html) AS size FROM pages
  UNION ALL SELECT 'input', 'documents/' || doc_id, sha256(text), strlen(text) FROM documents
  UNION ALL SELECT 'output', 'conversations/' || conv_id || '/' || turn, sha256(text), strlen(text) FROM conversations)"""

_LINE_COLUMNS = [
    "event_uid", "event_ts", "host_name", "user_name", "source_ip", "destination_ip", "destination_port",
    "event_outcome", "process_command_line",
]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = _context(spark, sf_dir, _top(spark, sf_dir), 5)
    return context_lines(context.select("alert_id", "alert_ts", *_LINE_COLUMNS))


def bundle_raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_lines(spark, sf_dir))


def _text_field(name: str, expression: str) -> str:
    return f"""'"{name}":"' || {expression} || '"'"""


_LINE_SQL = f"""'{{' || concat_ws(',', '"event_uid":' || event_uid,
    {_text_field('@timestamp', ts_sql('event_ts') + " || '+00:00'")},
    {_text_field('host.name', 'host_name')}, {_text_field('user.name', 'user_name')},
    {_text_field('source.ip', 'source_ip')}, {_text_field('destination.ip', 'destination_ip')},
    '"destination.port":' || destination_port, {_text_field('event.outcome', 'event_outcome')},
    {_text_field('process.command_line', "replace(process_command_line, '" + '"' + "', '" + chr(92) + '"' + "')")}) || '}}'"""

BUNDLE_RAW_LOGS = f"""
WITH {EVENTS_SQL}, {_TOP_SQL}, {_context_sql('top', 5)}
SELECT alert_id, event_uid, {_LINE_SQL} AS content FROM context"""


def _documents(spark: SparkSession, sf_dir: str, top_n: int | None) -> DataFrame:
    return bundle_documents(_triaged(spark, sf_dir, top_n), FEATURES, params="{}")


def bundle_documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single documents of every row at or above the threshold."""
    return report(_documents(spark, sf_dir, None))


def _documents_sql(top_n: int | None) -> str:
    """CTEs up to ``documents`` (alert_id, file_name, content)."""
    named = [("host.name", "host_name"), ("user.name", "user_name"), ("source.ip", "source_ip"),
             ("destination.ip", "destination_ip"), ("session.id", "session_id")]
    ids = ", ".join(_text_field(name, column) for name, column in named)
    numbers = ", ".join(f"""'"{ECS_NAMES.get(f, f)}":' || {f}""" for f in FEATURES)
    iocs = ", ".join(f"""'{{"type":"{n}","value":"' || {c} || '"}}'""" for n, c in [*named[2:4], *named[:2]])
    actions = ",".join(f'"{a}"' for a in ACTIONS)
    return f"""{_triage_sql(top_n)},
tops AS (
  SELECT event_uid, string_agg('{{"feature":"' || feature || '","value":' || value || '}}', ',' ORDER BY rank) AS top
  FROM ranked WHERE rank <= 5 GROUP BY event_uid),
documents_of AS (
  SELECT 'alert-' || event_uid AS alert_id,
    '{{' || concat_ws(',', '"@timestamp":"' || shown || '"', {ids}, {numbers}, '"anom.score":' || anom_score) || '}}' AS f,
    '{{"top_features":[' || top || '],"note":"fallback_no_shap"}}' AS e,
    '{{"algorithm":"IsolationForest","params":"{{}}","score_threshold":' || round(threshold, 6) || ',"alert_score":'
      || anom_score || '}}' AS m,
    '{{"created_at":"2025-01-01T00:00:00Z","risk_level":"' || risk_level || '","score":' || anom_score || ',"reason":"'
      || reason || '","iocs":[' || concat_ws(',', {iocs}) || '],"actions":[{actions}],"markdown":"'
      || replace(markdown, chr(10), chr(92) || 'n') || '"}}' AS a,
    markdown
  FROM written JOIN tops USING (event_uid)),
documents AS (
  SELECT alert_id, 'features.json' AS file_name, f AS content FROM documents_of
  UNION ALL SELECT alert_id, 'shap_explanation.json', e FROM documents_of
  UNION ALL SELECT alert_id, 'model_meta.json', m FROM documents_of
  UNION ALL SELECT alert_id, 'ai_analysis.json', a FROM documents_of
  UNION ALL SELECT alert_id, 'ai_analysis.md', markdown FROM documents_of)"""


BUNDLE_DOCUMENTS = f"WITH {_documents_sql(None)} SELECT alert_id, file_name, content FROM documents"


def bundle_manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and context lines of the top alerts."""
    lines = _lines(spark, sf_dir).select(
        F.concat(F.lit("alert-"), F.col("alert_id").cast("string")).alias("alert_id"),
        F.lit("raw_logs.jsonl").alias("file_name"), "content",
    )
    return report(bundle_manifest(_documents(spark, sf_dir, 10).unionByName(lines)))


BUNDLE_MANIFEST = f"""
WITH {_documents_sql(10)}, {_TOP_SQL}, {_context_sql('top', 5)},
files AS (
  SELECT * FROM documents
  UNION ALL SELECT 'alert-' || alert_id, 'raw_logs.jsonl', {_LINE_SQL} FROM context),
lines_of AS (SELECT *, sha256(content) AS line FROM files),
parts AS (
  SELECT alert_id, file_name, substr(line, 1, 3) AS part, count(*) AS n, sum(strlen(content) + 1) AS size,
    sha256(string_agg(line, '' ORDER BY line)) AS digest FROM lines_of GROUP BY ALL)
SELECT alert_id, file_name, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(size) AS BIGINT) AS size,
  sha256(string_agg(digest, '' ORDER BY part)) AS sha256
FROM parts GROUP BY alert_id, file_name"""


QUERIES = {
    "score_threshold_quantile": (score_threshold_quantile, SCORE_THRESHOLD_QUANTILE),
    "score_threshold_mean_std": (score_threshold_mean_std, SCORE_THRESHOLD_MEAN_STD),
    "top_alerts": (top_alerts, TOP_ALERTS),
    "alert_table": (alert_table_query, ALERT_TABLE),
    "alert_context_5m": (alert_context_5m, ALERT_CONTEXT_5M),
    "alert_context_bucketed": (alert_context_bucketed, ALERT_CONTEXT_BUCKETED),
    "alert_context_preview": (alert_context_preview, ALERT_CONTEXT_PREVIEW),
    "host_recent": (host_recent, HOST_RECENT),
    "host_rows": (host_rows, HOST_ROWS),
    "overview_metrics": (overview_metrics, OVERVIEW_METRICS),
    "overview_timeline": (overview_timeline, OVERVIEW_TIMELINE),
    "host_list": (host_list_query, HOST_LIST),
    "score_merge_cap": (score_merge_cap, SCORE_MERGE_CAP),
    "abs_rank_explain": (abs_rank_explain, ABS_RANK_EXPLAIN),
    "alert_triage": (alert_triage, ALERT_TRIAGE),
    "evidence_manifest": (evidence_manifest, EVIDENCE_MANIFEST),
    "evidence_files": (evidence_files, None),
    "custody_records": (custody_records_query, CUSTODY_RECORDS),
    "bundle_raw_logs": (bundle_raw_logs, BUNDLE_RAW_LOGS),
    "bundle_documents": (bundle_documents_query, BUNDLE_DOCUMENTS),
    "bundle_manifest": (bundle_manifest_query, BUNDLE_MANIFEST),
}
