"""The given tables seen as security events, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as ECS events."""
    raw = table(spark, sf_dir, "events")
    return raw.selectExpr("*", "try_cast(get_json_object(props, '$.k') AS int) AS k").selectExpr(
        "event_id AS event_uid",
        "CAST(ts AS timestamp) AS event_ts",
        "CAST(ts AS date) AS dt",
        "CASE WHEN event_id % 50 <> 0 THEN 'user' || user_id END AS user_name",
        "'host' || (user_id % 10) AS host_name",
        "'10.0.0.' || (user_id % 50) AS source_ip",
        "'198.51.100.' || (k % 5) AS destination_ip",
        "CASE WHEN k < 5 THEN 4444 ELSE 1000 + k END AS destination_port",
        "CASE WHEN k % 2 = 1 THEN 'udp' ELSE 'tcp' END AS network_transport",
        "CASE WHEN event_type = 'error' THEN '4625' ELSE '4624' END AS event_code",
        "CASE WHEN event_type = 'error' THEN 'Failure' WHEN k = 99 THEN 'S0' ELSE 'Success' END AS event_outcome",
        "event_type || ' ' || props AS process_command_line",
        "event_type",
        "value AS score_proxy",
        "k",
    )


EVENTS_SQL = """
v0 AS (
  SELECT event_id AS event_uid, ts AS event_ts, CAST(ts AS DATE) AS dt,
    CASE WHEN event_id % 50 <> 0 THEN 'user' || user_id END AS user_name,
    'host' || (user_id % 10) AS host_name,
    '10.0.0.' || (user_id % 50) AS source_ip,
    '198.51.100.' || (k % 5) AS destination_ip,
    CASE WHEN k < 5 THEN 4444 ELSE 1000 + k END AS destination_port,
    CASE WHEN k % 2 = 1 THEN 'udp' ELSE 'tcp' END AS network_transport,
    CASE WHEN event_type = 'error' THEN '4625' ELSE '4624' END AS event_code,
    CASE WHEN event_type = 'error' THEN 'Failure' WHEN k = 99 THEN 'S0' ELSE 'Success' END AS event_outcome,
    event_type || ' ' || props AS process_command_line,
    event_type, value AS score_proxy, k,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS login_failed,
    CASE WHEN k < 5 OR (k = 99 AND event_type <> 'error') THEN 1 ELSE 0 END AS conn_suspicious
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)
)"""


def ts_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def day_sql(column: str = "dt") -> str:
    return f"CAST({column} AS VARCHAR)"


def time_text(time: Column | str) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def report(df: DataFrame) -> DataFrame:
    """Plain output types: times and days as text, whole numbers as bigint, doubles to 6 places."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = time_text(column)
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6) + F.lit(0.0)
        elif isinstance(field.dataType, T.IntegralType):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)
