"""Queries over the sources. Raw lines are derived from the given tables and parsed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import first_ipv4
from ..session import new_folder
from ..sources.files import text_lines
from ..sources.flows import normalize_flows, read_flows
from ..sources.jsonl import SYSMON, WINDOWS_EVTX, ZEEK_CONN, JsonSource, map_records, parse_json_lines, read_json_source
from ..sources.lines import lines_in_range, lines_of_date, lines_with_keyword, write_lines
from ..sources.logs import parse_log_lines, read_logs
from ..sources.store import available_days, read_store, union_sources, with_event_uid, write_store
from .views import EVENTS_SQL, day_sql, events, report, table, ts_sql

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _iso(column: str = "event_ts") -> Column:
    return F.date_format(column, ISO)


def _windows_lines(v0: DataFrame) -> DataFrame:
    system = F.struct(F.col("host_name").alias("Computer"), F.col("event_code").cast("int").alias("EventID"))
    data = F.struct(
        F.col("user_name").alias("TargetUserName"), F.col("source_ip").alias("IpAddress"),
        F.col("event_outcome").alias("Status"), F.col("process_command_line").alias("CommandLine"),
    )
    event = F.struct(system.alias("System"), data.alias("EventData"))
    return v0.select("*", F.to_json(F.struct(event.alias("Event"), _iso().alias("@timestamp"))).alias("value"))


def _sysmon_lines(v0: DataFrame) -> DataFrame:
    record = F.struct(
        _iso().alias("UtcTime"), F.col("host_name").alias("Computer"), F.lit(3).alias("EventID"),
        F.col("process_command_line").alias("CommandLine"), F.col("user_name").alias("User"),
        F.col("source_ip").alias("SourceIp"), F.col("destination_ip").alias("DestinationIp"),
        F.col("destination_port").alias("DestinationPort"), F.col("network_transport").alias("Protocol"),
    )
    return v0.select("*", F.to_json(record).alias("value"))


def _zeek_lines(v0: DataFrame) -> DataFrame:
    """Every other record has literal dotted keys, the rest a nested object."""
    same = [
        _iso().alias("ts"), F.col("network_transport").alias("proto"), F.lit("-").alias("service"),
        F.col("event_outcome").alias("conn_state"),
        F.concat(F.lit("C"), F.col("event_uid").cast("string")).alias("uid"),
        (F.col("k") % 2 == 0).alias("local_orig"),
    ]
    ends = {"orig_h": "source_ip", "resp_h": "destination_ip", "resp_p": "destination_port"}
    literal = F.struct(*same, *[F.col(c).alias(f"id.{key}") for key, c in ends.items()])
    nested = F.struct(*same, F.struct(*[F.col(c).alias(key) for key, c in ends.items()]).alias("id"))
    line = F.when(F.col("event_uid") % 2 == 0, F.to_json(literal)).otherwise(F.to_json(nested))
    # a quarter of the records each: ISO, seconds since 1970 as a number, slashes, and no marks at all
    quarter, micros = F.floor(F.col("event_uid") / 2) % 4, F.unix_micros("event_ts")
    seconds = F.concat_ws(".", F.floor(micros / 1_000_000).cast("string"), F.lpad((micros % 1_000_000).cast("string"), 6, "0"))
    time = (
        F.when(quarter == 1, seconds).when(quarter == 2, F.date_format("event_ts", "'\"'yyyy/MM/dd HH:mm:ss.SSSSSS'\"'"))
        .when(quarter == 3, F.date_format("event_ts", "'\"'yyyyMMdd'T'HHmmss.SSSSSS'Z\"'"))
        .otherwise(F.concat(F.lit('"'), _iso(), F.lit('"')))
    )
    return v0.select("*", F.regexp_replace(line, F.lit('"ts":"[^"]*"'), F.concat(F.lit('"ts":'), time)).alias("value"))


def _nullable(df: DataFrame) -> DataFrame:
    """Whole numbers that may be null as doubles, so that both engines print them alike."""
    ports = [c for c in ("source_port", "destination_port") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("double") for c in ports})


def _mapped(lines: DataFrame, source: JsonSource) -> DataFrame:
    return map_records(parse_json_lines(lines, source), source)


def jsonl_ecs_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    v0 = events(spark, sf_dir)
    frames = [_mapped(_windows_lines(v0), WINDOWS_EVTX), _mapped(_sysmon_lines(v0), SYSMON)]
    return report(
        _nullable(frames[0].unionByName(frames[1])).select(
            "event_ts", "event_module", "event_dataset", "event_code", "event_outcome", "host_name", "user_name",
            "source_ip", "destination_ip", "destination_port", "network_transport", "process_command_line",
        )
    )


JSONL_ECS_MAP = f"""
WITH {EVENTS_SQL}
SELECT {ts_sql('event_ts')} AS event_ts, 'windows' AS event_module, 'security' AS event_dataset, event_code,
  event_outcome, host_name, user_name, source_ip, NULL::VARCHAR AS destination_ip, NULL::DOUBLE AS destination_port,
  NULL::VARCHAR AS network_transport, process_command_line
FROM v0
UNION ALL
SELECT {ts_sql('event_ts')}, 'sysmon', 'sysmon', '3', NULL, host_name, user_name, source_ip, destination_ip,
  CAST(destination_port AS DOUBLE), network_transport, process_command_line
FROM v0"""


def zeek_literal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(
        _mapped(_zeek_lines(events(spark, sf_dir)), ZEEK_CONN).select(
            "event_id", "event_ts", "event_module", "event_dataset", "source_ip", "destination_ip",
            "destination_port", "network_transport", "network_protocol", "event_outcome", "network_direction",
        )
    )


ZEEK_LITERAL_KEYS = f"""
WITH {EVENTS_SQL}
SELECT 'C' || event_uid AS event_id, {ts_sql('event_ts')} AS event_ts, 'zeek' AS event_module,
  'zeek.conn' AS event_dataset, source_ip, destination_ip, CAST(destination_port AS BIGINT) AS destination_port,
  network_transport, '-' AS network_protocol, event_outcome,
  CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS network_direction
FROM v0"""


def jsonl_malformed_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every ten lines one is cut off, one blank, one has text or members after it, one a bad time, one is a scalar."""
    digit = F.col("event_uid") % 10
    value = F.col("value")
    after = (
        F.when(F.col("event_uid") % 4 == 0, F.lit(" trailing"))
        .when(F.col("event_uid") % 3 == 0, F.lit(',"x":5'))
        .otherwise(F.concat(F.lit(',"record":'), value))
    )
    broken = (
        F.when(digit == 0, F.expr("left(value, length(value) div 2)"))
        .when(digit == 1, F.lit("   "))
        .when(digit == 2, F.concat(value, after))
        .when(digit == 3, F.regexp_replace(value, '"@timestamp":"[^"]*"', '"@timestamp":"yesterday"'))
        .when(digit == 4, F.lit("5"))
        .otherwise(F.concat(F.lit("  "), value, F.lit(" ")))
    )
    lines = _windows_lines(events(spark, sf_dir)).withColumn("value", broken)
    return report(
        _mapped(lines, WINDOWS_EVTX).select("event_ts", "host_name", "user_name", "event_code", "process_command_line")
    )


JSONL_MALFORMED_SKIP = f"""
WITH {EVENTS_SQL}
SELECT {ts_sql('event_ts')} AS event_ts, host_name, user_name, event_code, process_command_line
FROM v0 WHERE event_uid % 10 > 4"""


def syslog_auth_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.concat(F.lit("u"), F.col("event_uid").cast("string"))
    message = (
        F.when(F.col("event_outcome") == "Failure",
               F.concat(F.lit("Failed password for invalid user "), user, F.lit(" from "), "source_ip", F.lit(" port 22")))
        .when(F.col("event_outcome") == "Success",
              F.concat(F.lit("Accepted publickey for "), user, F.lit(" from "), "source_ip"))
        .otherwise(F.lit("session opened"))
    )
    stamp = F.concat(
        F.date_format("event_ts", "MMM"), F.lit(" "), F.lpad(F.date_format("event_ts", "d"), 2, " "), F.lit(" "),
        F.date_format("event_ts", "HH:mm:ss"),
    )
    v0 = events(spark, sf_dir)
    lines = v0.select(F.concat(stamp, F.lit(" "), "host_name", F.lit(" sshd[77]: "), message).alias("value"))
    noise = v0.select(F.col("process_command_line").alias("value"))  # matches no layout
    return report(
        parse_log_lines(lines.unionByName(noise), default_year=2024).select(
            "event_ts", "host_name", "process_name", "event_module", "event_dataset", "event_action",
            "event_outcome", "user_name", "source_ip",
        )
    )


SYSLOG_AUTH_PARSE = f"""
WITH {EVENTS_SQL}
SELECT {ts_sql("date_trunc('second', event_ts)")} AS event_ts, host_name, 'sshd[77]' AS process_name,
  'syslog' AS event_module, 'auth' AS event_dataset, 'user_login' AS event_action,
  CASE WHEN event_outcome <> 'S0' THEN event_outcome END AS event_outcome,
  CASE WHEN event_outcome <> 'S0' THEN 'u' || event_uid END AS user_name,
  CASE WHEN event_outcome <> 'S0' THEN source_ip END AS source_ip
FROM v0"""


def _cbs_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("k") < 50, "Info").otherwise("Warning")
    component = F.when(F.col("k") % 3 == 0, "CBS").when(F.col("k") % 3 == 1, "CSI").otherwise("DISM")
    message = F.when(F.col("event_outcome") == "Failure", F.concat(F.lit("Failed to reach "), "source_ip")).when(
        F.col("event_outcome") == "S0", F.lit("Error 0x1")
    ).otherwise(F.concat(F.lit("failed lower case, session "), F.col("event_uid").cast("string")))
    stamp = F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss")
    return events(spark, sf_dir).select(
        F.concat(stamp, F.lit(", "), F.rpad(level, 22, " "), component, F.lit("    "), message).alias("value")
    )


_CBS_COLUMNS = [
    "event_ts", "host_name", "process_name", "event_module", "event_dataset", "event_action", "event_outcome", "message", "source_ip",
]


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Servicing lines written as ``.log`` folders of text files and read back by the log reader."""
    path = new_folder(spark, "logs")
    _cbs_lines(spark, sf_dir).write.text(f"{path}/node1.log")
    return report(read_logs(spark, f"{path}/node1.log", 2024, host="node1", pattern="*.txt").select(*_CBS_COLUMNS))


def cbs_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _cbs_lines(spark, sf_dir)
    return report(parse_log_lines(lines, default_year=2024, host="node1").select(*_CBS_COLUMNS))


CBS_PARSE = f"""
WITH {EVENTS_SQL}
SELECT {ts_sql("date_trunc('second', event_ts)")} AS event_ts, 'node1' AS host_name,
  CASE k % 3 WHEN 0 THEN 'CBS' WHEN 1 THEN 'CSI' ELSE 'DISM' END AS process_name,
  'windows' AS event_module, 'cbs' AS event_dataset,
  CASE WHEN k % 3 < 2 THEN 'system_update' ELSE 'log_event' END AS event_action,
  CASE WHEN event_outcome IN ('Failure', 'S0') THEN 'Failure' WHEN k < 50 THEN 'Info' ELSE 'Warning' END AS event_outcome,
  CASE event_outcome WHEN 'Failure' THEN 'Failed to reach ' || source_ip WHEN 'S0' THEN 'Error 0x1'
    ELSE 'failed lower case, session ' || event_uid END AS message,
  CASE WHEN event_outcome = 'Failure' THEN source_ip END AS source_ip
FROM v0"""


def extract_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", first_ipv4(F.col("text")).alias("ip"))
    return report(found.filter(F.col("ip").isNotNull()))


EXTRACT_IPV4 = r"""
SELECT doc_id, ip FROM (
  SELECT doc_id, regexp_extract(text, '\b((?:\d{1,3}\.){3}\d{1,3})\b', 1) AS ip FROM documents)
WHERE ip <> ''"""


def _flow_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as CSV flow records: free column names, all text, six time layouts."""
    item = table(spark, sf_dir, "lineitem")
    even, kind = F.col("l_orderkey") % 2 == 0, F.col("l_orderkey") % 6
    time = F.when(F.col("l_linenumber") == 6, "n/a")
    for number, layout in enumerate(FLOW_TIMES):
        text = F.upper(F.date_format("l_shipdate", layout)) if layout else F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("string")
        time = time.when(kind == number, text)
    return item.select(
        time.alias(" Timestamp"),
        F.concat(F.lit("10.1.0."), (F.col("l_suppkey") % 250).cast("string")).alias("Src IP"),
        F.concat(F.lit("10.2.0."), (F.col("l_partkey") % 250).cast("string")).alias("Dst IP"),
        F.concat((F.col("l_partkey") % 60000).cast("string"), F.lit(".0")).alias("Src Port"),
        F.when(F.col("l_linenumber") == 7, "x").otherwise(F.lit("4444")).alias("Dst Port"),
        F.when(even, "TCP").otherwise("Udp").alias("Protocol"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("Label"),
        F.col("l_quantity").cast("string").alias("Tot Fwd Bytes"),
        F.when(even, F.col("l_linenumber").cast("string")).otherwise("?").alias("Tot Bwd Bytes"),
    )


FLOW_TIMES = ["dd/MM/yyyy H:mm", "yyyy-MM-dd HH:mm:ss", "d-MMM-yyyy HH:mm", "yyyy/MM/dd HH:mm:ss", "d/M/yy H:mm", None]
FLOW_COLUMNS = [
    "event_ts", "event_dataset", "event_action", "host_name", "source_ip", "destination_ip", "source_port",
    "destination_port", "network_transport", "network_bytes",
]


def csv_flow_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = normalize_flows(_flow_cells(spark, sf_dir), time_unit="s")
    return report(_nullable(flows).select(*FLOW_COLUMNS))


def csv_flow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records written as CSV files of two headers, with one that has no time, and read back."""
    cells, path = _flow_cells(spark, sf_dir), new_folder(spark, "csv")
    even = F.col("Protocol") == "TCP"
    cells.filter(even).write.option("header", True).csv(f"{path}/a")
    turned = cells.filter(~even).select(*reversed(cells.columns)).withColumnsRenamed({"Src IP": "srcip", " Timestamp": "start time"})
    turned.write.option("header", True).csv(f"{path}/b/c")
    cells.select("Label", "Protocol").write.option("header", True).csv(f"{path}/no-time")
    return report(_nullable(read_flows(spark, path, time_unit="s")).select(*FLOW_COLUMNS))


CSV_FLOW_NORMALIZE = f"""
SELECT {ts_sql("CASE WHEN l_orderkey % 2 = 0 THEN date_trunc('minute', l_shipdate) ELSE date_trunc('second', l_shipdate) END")} AS event_ts,
  'custom_csv' AS event_dataset, CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE 'flow' END AS event_action,
  NULL::VARCHAR AS host_name,
  '10.1.0.' || (l_suppkey % 250) AS source_ip, '10.2.0.' || (l_partkey % 250) AS destination_ip,
  CAST(l_partkey % 60000 AS DOUBLE) AS source_port,
  CASE WHEN l_linenumber <> 7 THEN 4444::DOUBLE END AS destination_port,
  CASE WHEN l_orderkey % 2 = 0 THEN 'tcp' ELSE 'udp' END AS network_transport,
  round(l_quantity + CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber ELSE 0 END, 6) AS network_bytes
FROM lineitem WHERE l_linenumber <> 6"""


def json_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the three JSON sources written as files and read back."""
    v0, path = events(spark, sf_dir), new_folder(spark, "json")
    frames = {}
    for source, lines in ((WINDOWS_EVTX, _windows_lines), (SYSMON, _sysmon_lines), (ZEEK_CONN, _zeek_lines)):
        lines(v0).select("value").write.text(f"{path}/{source.file_name}")
        frames[source.name] = read_json_source(spark, f"{path}/{source.file_name}", source)
    return report(
        _nullable(union_sources(frames)).select("source", "dt", "event_ts", "event_module", "source_ip", "destination_ip", "destination_port")
    )


JSON_SOURCE_FILES = f"""
WITH {EVENTS_SQL}
SELECT source, {day_sql()} AS dt, {ts_sql('event_ts')} AS event_ts, split_part(source, '_', 1) AS event_module, source_ip,
  CASE WHEN source <> 'windows_evtx' THEN destination_ip END AS destination_ip,
  CASE WHEN source <> 'windows_evtx' THEN CAST(destination_port AS DOUBLE) END AS destination_port
FROM v0, (VALUES ('windows_evtx'), ('sysmon'), ('zeek_conn')) AS s(source)"""


def _three_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, item = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return union_sources(
        {
            "events": events(spark, sf_dir),
            "orders": orders.select(
                F.col("o_orderdate").cast("timestamp").alias("event_ts"),
                F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("user_name"),
                F.col("o_orderstatus").alias("event_outcome"), F.col("o_totalprice").alias("network_bytes"),
            ),
            "lineitem": item.select(
                F.col("l_shipdate").cast("timestamp").alias("event_ts"), F.col("l_returnflag").alias("event_action"),
                F.col("l_linenumber").alias("source_port"),
            ),
        }
    )


_THREE_SOURCES_SQL = f"""
{EVENTS_SQL}, three AS (
  SELECT 'events' AS source, event_ts, user_name, event_outcome, destination_port FROM v0
  UNION ALL BY NAME
  SELECT 'orders' AS source, o_orderdate AS event_ts, 'C' || o_custkey AS user_name, o_orderstatus AS event_outcome,
    o_totalprice AS network_bytes FROM orders
  UNION ALL BY NAME
  SELECT 'lineitem' AS source, l_shipdate AS event_ts, l_returnflag AS event_action, l_linenumber AS source_port
  FROM lineitem
)"""


def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(
        _nullable(_three_sources(spark, sf_dir)).select(
            "source", "dt", "event_ts", "user_name", "event_action", "event_outcome", "source_port",
            "destination_port", "network_bytes",
        )
    )


SOURCE_UNION = f"""
WITH {_THREE_SOURCES_SQL}
SELECT source, {day_sql('CAST(event_ts AS DATE)')} AS dt, {ts_sql('event_ts')} AS event_ts, user_name, event_action,
  event_outcome, CAST(source_port AS DOUBLE) AS source_port, CAST(destination_port AS DOUBLE) AS destination_port,
  round(network_bytes, 6) AS network_bytes
FROM three"""


def daily_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two sources, written as the day-partitioned store, read back, counted."""
    v0 = events(spark, sf_dir)
    failed = F.col("event_code") == "4625"
    both = union_sources({"windows_evtx": v0.filter(failed), "zeek_conn": v0.filter(~failed)})
    path = new_folder(spark, "store")
    write_store(both, path)
    return report(available_days(read_store(spark, path)))


DAILY_PARTITION_COUNTS = f"""
WITH {EVENTS_SQL}
SELECT CASE WHEN event_code = '4625' THEN 'windows_evtx' ELSE 'zeek_conn' END AS source, {day_sql()} AS dt,
  count(*) AS n_rows FROM v0 GROUP BY ALL"""


def store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed logons written to the store, then all events appended; counted by source and day."""
    v0, path = events(spark, sf_dir), new_folder(spark, "store")
    write_store(union_sources({"windows_evtx": v0.filter(F.col("event_code") == "4625")}), path)
    write_store(union_sources({"windows_evtx": v0, "zeek_conn": v0}), path, mode="append")
    return report(available_days(read_store(spark, path)))


STORE_APPEND = f"""
WITH {EVENTS_SQL}
SELECT source, {day_sql()} AS dt,
  count(*) + CASE WHEN source = 'windows_evtx' THEN count(*) FILTER (event_code = '4625') ELSE 0 END AS n_rows
FROM v0, (VALUES ('windows_evtx'), ('zeek_conn')) AS s(source) GROUP BY source, dt"""


def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of events of which many are exact copies: how many ids, rows and copy numbers there are per host."""
    v0 = events(spark, sf_dir).select(F.date_trunc("hour", "event_ts").alias("event_ts"), "host_name")
    made = with_event_uid(union_sources({"events": v0}))
    number = F.split_part("event_uid", F.lit("-"), F.lit(2)).cast("bigint")
    return report(
        made.groupBy("host_name").agg(
            F.count("*").alias("n_rows"), F.count_distinct("event_uid").alias("n_ids"), F.sum(number).cast("bigint").alias("numbers")
        )
    )


EVENT_IDS = f"""
WITH {EVENTS_SQL}, c AS (SELECT host_name, date_trunc('hour', event_ts) AS h, count(*) AS n FROM v0 GROUP BY ALL)
SELECT host_name, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) AS BIGINT) AS n_ids, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS numbers
FROM c GROUP BY host_name"""


def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a keyword written below a folder and read back."""
    found = lines_with_keyword(_log_lines(spark, sf_dir), "ERROR")
    path = write_lines(found, new_folder(spark, "lines"), "error lines.log")
    return report(text_lines(spark, path).select("value"))


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return raw.select("event_id", F.concat_ws(" ", stamp, "event_type", "props").alias("value"))


_LOG_LINES_SQL = """
lines AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ' ' || props AS value FROM events)"""


def line_filter_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(lines_of_date(_log_lines(spark, sf_dir), "2024-01-05"))


LINE_FILES = f"WITH {_LOG_LINES_SQL} SELECT value FROM lines WHERE contains(lower(value), 'error')"
LINE_FILTER_DATE = f"WITH {_LOG_LINES_SQL} SELECT event_id, value FROM lines WHERE starts_with(value, '2024-01-05')"


def line_filter_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(lines_with_keyword(table(spark, sf_dir, "conversations"), "Que", "text").select("conv_id", "turn", "text"))


LINE_FILTER_KEYWORD = "SELECT conv_id, turn, text FROM conversations WHERE contains(lower(text), 'que')"


def line_filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _log_lines(spark, sf_dir)
    noise = lines.withColumn("value", F.concat(F.lit("no date "), "value"))
    return report(lines_in_range(lines.unionByName(noise), "2024-01-05", "2024-01-09"))


LINE_FILTER_RANGE = f"""
WITH {_LOG_LINES_SQL}
SELECT event_id, value FROM lines WHERE value >= '2024-01-05' AND value < '2024-01-10'"""


QUERIES = {
    "jsonl_ecs_map": (jsonl_ecs_map, JSONL_ECS_MAP),
    "zeek_literal_keys": (zeek_literal_keys, ZEEK_LITERAL_KEYS),
    "jsonl_malformed_skip": (jsonl_malformed_skip, JSONL_MALFORMED_SKIP),
    "syslog_auth_parse": (syslog_auth_parse, SYSLOG_AUTH_PARSE),
    "cbs_parse": (cbs_parse, CBS_PARSE),
    "extract_ipv4": (extract_ipv4, EXTRACT_IPV4),
    "csv_flow_normalize": (csv_flow_normalize, CSV_FLOW_NORMALIZE),
    "csv_flow_files": (csv_flow_files, CSV_FLOW_NORMALIZE),
    "json_source_files": (json_source_files, JSON_SOURCE_FILES),
    "log_files": (log_files, CBS_PARSE),
    "store_append": (store_append, STORE_APPEND),
    "event_ids": (event_ids, EVENT_IDS),
    "line_files": (line_files, LINE_FILES),
    "source_union": (source_union, SOURCE_UNION),
    "daily_partition_counts": (daily_partition_counts, DAILY_PARTITION_COUNTS),
    "line_filter_date": (line_filter_date, LINE_FILTER_DATE),
    "line_filter_keyword": (line_filter_keyword, LINE_FILTER_KEYWORD),
    "line_filter_range": (line_filter_range, LINE_FILTER_RANGE),
}
