"""Queries over the feature operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.entropy import char_entropy, mean_token_entropy
from ..functions.text import words
from ..model.forest import coerce_features, numeric_features
from ..operators.features import event_flags, feature_table
from ..operators.quantiles import RobustScaler, robust_parameters
from ..operators.rolling import rolling_counts, rolling_rates
from ..operators.sampling import sample_per_day
from ..operators.sessions import sessionize
from ..schema import ENTROPY, FLAGS, WINDOW_MINUTES, feature_names
from .views import EVENTS_SQL, day_sql, events, report, table, ts_sql

LONG_WINDOWS = [1, 5, 15, 60, 360, 1440]


def _count_sql(flag: str, w: int, partition: str) -> str:
    frame = f"RANGE BETWEEN to_microseconds({w * 60_000_000 - 1}) PRECEDING AND CURRENT ROW"
    return f"sum({flag}) OVER (PARTITION BY {partition} ORDER BY event_ts {frame})"


def _counts_sql(windows: list[int], key: str, suffix: str = "", daily: bool = True) -> str:
    partition = f"{key}, dt" if daily else key
    return ",\n  ".join(
        f"CAST(CASE WHEN {key} IS NULL THEN 0 ELSE {_count_sql(f, w, partition)} END AS DOUBLE) AS {f}_count_{w}m{suffix}"
        for w in windows
        for f in FLAGS
    )


def _session_sql(keys: str, timeout: int) -> str:
    """CTEs from ``v0`` to ``sess`` with the session ordinal per day and key."""
    order = f"PARTITION BY dt, {keys} ORDER BY event_ts"
    return f"""
gaps AS (
  SELECT *, CASE WHEN epoch_us(event_ts) - lag(epoch_us(event_ts)) OVER ({order}) <= {timeout * 1_000_000}
    THEN 0 ELSE 1 END AS opens FROM v0),
sess AS (
  SELECT *, CAST(sum(opens) OVER ({order} RANGE UNBOUNDED PRECEDING) AS BIGINT) AS session_ordinal FROM gaps)"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_flags(events(spark, sf_dir))


def event_flags_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_flags(spark, sf_dir).select("event_uid", *FLAGS))


EVENT_FLAGS = f"""
WITH {EVENTS_SQL}
SELECT event_uid, CAST(login_failed AS BIGINT) AS login_failed, CAST(conn_suspicious AS BIGINT) AS conn_suspicious
FROM v0"""


def rolling_counts_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flags(spark, sf_dir).select("event_uid", "event_ts", "dt", "user_name", *FLAGS)
    return report(rolling_counts(rows, ["user_name"], FLAGS, LONG_WINDOWS).drop(*FLAGS))


ROLLING_COUNTS_USER = f"""
WITH {EVENTS_SQL}
SELECT event_uid, {ts_sql('event_ts')} AS event_ts, {day_sql()} AS dt, user_name,
  {_counts_sql(LONG_WINDOWS, 'user_name')} FROM v0"""


def rolling_counts_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flags(spark, sf_dir).select("event_uid", "event_ts", "dt", "host_name", *FLAGS)
    return report(
        rolling_counts(rows, ["host_name"], FLAGS, WINDOW_MINUTES, "_by_host").drop("event_ts", "dt", *FLAGS)
    )


ROLLING_COUNTS_HOST = f"""
WITH {EVENTS_SQL}
SELECT event_uid, host_name, {_counts_sql(WINDOW_MINUTES, 'host_name', '_by_host')} FROM v0"""


def rolling_counts_across_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flags(spark, sf_dir).select("event_uid", "event_ts", "user_name", *FLAGS)
    counted = rolling_counts(rows, ["user_name"], FLAGS, [360, 1440], reset_daily=False)
    return report(counted.drop("event_ts", "user_name", *FLAGS))


ROLLING_COUNTS_ACROSS_DAYS = f"""
WITH {EVENTS_SQL}
SELECT event_uid, {_counts_sql([360, 1440], 'user_name', daily=False)} FROM v0"""


def rolling_rates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flags(spark, sf_dir).select("event_uid", "event_ts", "dt", "event_type", *FLAGS)
    counted = rolling_counts(rows, ["event_type"], FLAGS, WINDOW_MINUTES)
    rates = rolling_rates(counted, FLAGS, WINDOW_MINUTES)
    return report(rates.select("event_uid", *[f"{f}_rate_{w}m" for w in WINDOW_MINUTES for f in FLAGS]))


ROLLING_RATES = f"""
WITH {EVENTS_SQL}
SELECT event_uid, {", ".join(
    f"round({_count_sql(f, w, 'event_type, dt')} / {w}.0, 6)::DOUBLE AS {f}_rate_{w}m"
    for w in WINDOW_MINUTES for f in FLAGS)} FROM v0"""


def sessionize_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(
        sessionize(events(spark, sf_dir), timeout_seconds=7200).select("event_uid", "session_ordinal", "session_id")
    )


SESSIONIZE_FLOWS = f"""
WITH {EVENTS_SQL}, {_session_sql('source_ip, destination_ip, network_transport', 7200)}
SELECT event_uid, session_ordinal,
  concat_ws('|', dt, source_ip, destination_ip, network_transport, session_ordinal) AS session_id
FROM sess"""


def sessionize_few_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few keys with many rows each."""
    rows = events(spark, sf_dir)
    return report(sessionize(rows, ["event_type"], 1800).select("event_uid", "event_type", "session_ordinal"))


SESSIONIZE_FEW_KEYS = f"""
WITH {EVENTS_SQL}, {_session_sql('event_type', 1800)}
SELECT event_uid, event_type, session_ordinal FROM sess"""


def session_dense_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessionize(events(spark, sf_dir), timeout_seconds=7200, dense=True)
    return report(rows.select("event_uid", "dt", "session_number"))


SESSION_DENSE_ID = f"""
WITH {EVENTS_SQL}, {_session_sql('source_ip, destination_ip, network_transport', 7200)}
SELECT event_uid, {day_sql()} AS dt, CAST(sum(opens) OVER (
  PARTITION BY dt ORDER BY source_ip, destination_ip, network_transport, event_ts, opens DESC
  RANGE UNBOUNDED PRECEDING) AS BIGINT) AS session_number
FROM sess"""


def text_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents").select("doc_id", char_entropy(F.col("text")).alias("entropy")))


TEXT_ENTROPY = """
WITH chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents),
counts AS (SELECT doc_id, c, count(*) AS n FROM chars GROUP BY doc_id, c),
totals AS (SELECT doc_id, sum(n) AS total FROM counts GROUP BY doc_id)
SELECT doc_id, round(-sum(n / total * log2(n / total)), 6) + 0.0 AS entropy
FROM counts JOIN totals USING (doc_id) GROUP BY doc_id"""


def token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return report(documents.select("doc_id", mean_token_entropy(words(F.col("text"))).alias("entropy")))


TOKEN_ENTROPY = r"""
WITH tokens AS (
  SELECT doc_id, unnest(regexp_split_to_array(trim(text), '\s+')) AS token FROM documents),
kinds AS (
  SELECT token, row_number() OVER () AS id, count(*) AS uses FROM tokens WHERE token <> '' GROUP BY token),
counts AS (
  SELECT id, token, c, count(*) AS n
  FROM (SELECT id, token, unnest(string_split(token, '')) AS c FROM kinds) GROUP BY id, token, c),
totals AS (SELECT id, sum(n) AS total FROM counts GROUP BY id),
entropies AS (
  SELECT token, -sum(n / total * log2(n / total)) AS entropy FROM counts JOIN totals USING (id) GROUP BY token)
SELECT doc_id, round(avg(entropy), 6) + 0.0 AS entropy FROM tokens JOIN entropies USING (token) GROUP BY doc_id"""


def feature_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(feature_table(events(spark, sf_dir), by_host=True))


FEATURES_SQL = f"""
{EVENTS_SQL}, {_session_sql('source_ip, destination_ip, network_transport', 120)},
texts AS (SELECT DISTINCT process_command_line AS t FROM v0),
chars AS (SELECT t, unnest(string_split(t, '')) AS c FROM texts),
counts AS (SELECT t, c, count(*) AS n FROM chars GROUP BY t, c),
entropies AS (
  SELECT t, round(-sum(n / length(t) * log2(n / length(t))), 6) AS {ENTROPY} FROM counts GROUP BY t),
features AS (
  SELECT event_uid, event_ts, dt, host_name, user_name, source_ip, destination_ip,
    concat_ws('|', dt, source_ip, destination_ip, network_transport, session_ordinal) AS session_id,
    CAST(login_failed AS BIGINT) AS login_failed, CAST(conn_suspicious AS BIGINT) AS conn_suspicious, {ENTROPY},
    {_counts_sql(WINDOW_MINUTES, 'user_name')},
    {_counts_sql(WINDOW_MINUTES, 'host_name', '_by_host')}
  FROM sess JOIN entropies ON t = process_command_line)"""

FEATURE_TABLE = f"""
WITH {FEATURES_SQL}
SELECT * REPLACE ({ts_sql('event_ts')} AS event_ts, {day_sql()} AS dt) FROM features"""


def feature_sample_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_uid", "dt", "user_name", "score_proxy")
    return report(sample_per_day(rows, 100))


FEATURE_SAMPLE_PER_DAY = f"""
WITH {EVENTS_SQL}
SELECT event_uid, {day_sql()} AS dt, user_name, round(score_proxy, 6) AS score_proxy FROM v0
QUALIFY row_number() OVER (PARTITION BY dt ORDER BY md5(CAST(event_uid AS VARCHAR) || '42')) <= 100"""


def feature_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, null, half-numeric and absent features; the numeric columns are found by type."""
    v0 = events(spark, sf_dir).select(
        "event_uid", "score_proxy", F.nullif("k", F.lit(7)).alias("k"),
        F.when(F.col("k") % 3 == 0, "x").otherwise(F.concat(F.col("destination_port").cast("string"), F.lit(".5")))
        .alias("port_text"),
    )
    names = ["score_proxy", "k", "port_text", "absent"]
    found = F.lit(",".join(sorted(numeric_features(v0)))).alias("numeric")
    return report(coerce_features(v0, names).select("event_uid", *names, found))


FEATURE_COERCE = f"""
WITH {EVENTS_SQL}
SELECT event_uid, round(score_proxy, 6) AS score_proxy, CASE WHEN k = 7 THEN 0 ELSE k END::DOUBLE AS k,
  CASE WHEN k % 3 = 0 THEN 0 ELSE destination_port + 0.5 END::DOUBLE AS port_text, 0::DOUBLE AS absent,
  'k,score_proxy' AS numeric
FROM v0"""

_ITEM_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def robust_parameters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(3.0))
    return report(robust_parameters(item, [*_ITEM_COLUMNS, "constant"]))


def _quartiles_sql(columns: list[str], source: str) -> str:
    return "\n  UNION ALL\n  ".join(
        f"SELECT '{c}' AS feature, quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS median, "
        f"quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source}"
        for c in columns
    )


ROBUST_PARAMETERS = f"""
WITH item AS (SELECT *, 3.0::DOUBLE AS constant FROM lineitem),
quartiles AS (
  {_quartiles_sql([*_ITEM_COLUMNS, 'constant'], 'item')})
SELECT feature, round(median, 6) AS median, round(q3 - q1, 6) AS iqr,
  round(CASE WHEN q3 = q1 THEN 1.0 ELSE q3 - q1 END, 6) AS scale
FROM quartiles"""


def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    v0 = _flags(spark, sf_dir).select("event_uid", "score_proxy", "k", "conn_suspicious")
    return report(RobustScaler.fit(v0, ["score_proxy", "k", "conn_suspicious"]).transform(v0))


ROBUST_SCALE = f"""
WITH {EVENTS_SQL},
q AS (SELECT {", ".join(
    f"quantile_cont({c}::DOUBLE, 0.5) AS m_{c}, quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25) AS i_{c}"
    for c in ("score_proxy", "k", "conn_suspicious"))} FROM v0)
SELECT event_uid, {", ".join(
    f"round(({c} - m_{c}) / CASE WHEN i_{c} = 0 THEN 1 ELSE i_{c} END, 6) + 0.0 AS {c}"
    for c in ("score_proxy", "k", "conn_suspicious"))}
FROM v0, q"""

QUERIES = {
    "event_flags": (event_flags_query, EVENT_FLAGS),
    "rolling_counts_user": (rolling_counts_user, ROLLING_COUNTS_USER),
    "rolling_counts_host": (rolling_counts_host, ROLLING_COUNTS_HOST),
    "rolling_counts_across_days": (rolling_counts_across_days, ROLLING_COUNTS_ACROSS_DAYS),
    "rolling_rates": (rolling_rates_query, ROLLING_RATES),
    "sessionize_flows": (sessionize_flows, SESSIONIZE_FLOWS),
    "sessionize_few_keys": (sessionize_few_keys, SESSIONIZE_FEW_KEYS),
    "session_dense_id": (session_dense_id, SESSION_DENSE_ID),
    "text_entropy": (text_entropy, TEXT_ENTROPY),
    "token_entropy": (token_entropy, TOKEN_ENTROPY),
    "feature_table": (feature_table_query, FEATURE_TABLE),
    "feature_sample_per_day": (feature_sample_per_day, FEATURE_SAMPLE_PER_DAY),
    "feature_coerce": (feature_coerce, FEATURE_COERCE),
    "robust_parameters": (robust_parameters_query, ROBUST_PARAMETERS),
    "robust_scale": (robust_scale, ROBUST_SCALE),
}
# feature names in the fixed order, for the queries that use the feature table
FEATURES = feature_names()
