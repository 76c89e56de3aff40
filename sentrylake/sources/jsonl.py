"""JSON-lines sources mapped to the event schema by configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.once import with_once
from ..functions.values import integer, number, utc_time
from ..schema import FROM_ECS, TYPES, conform
from .files import text_lines

_END = "~end-of-record~"


@dataclass(frozen=True)
class JsonSource:
    """Raw path -> ECS name, and constants, of one JSON-lines source."""

    name: str
    mapping: dict[str, str]
    constants: dict[str, str]
    timestamp: str = "@timestamp"
    file_name: str = field(default="")
    unit: str | None = None  # of times that are bare numbers


# The field maps of the three sources.
WINDOWS_EVTX = JsonSource(
    name="windows_evtx",
    file_name="windows_evtx.jsonl",
    mapping={
        "Event.System.Computer": "host.name",
        "Event.System.EventID": "event.code",
        "Event.EventData.TargetUserName": "user.name",
        "Event.EventData.IpAddress": "source.ip",
        "Event.EventData.SubjectUserName": "user.target.name",
        "Event.EventData.LogonType": "event.action",
        "Event.EventData.Status": "event.outcome",
        "Event.EventData.ProcessName": "process.name",
        "Event.EventData.CommandLine": "process.command_line",
    },
    constants={"event_module": "windows", "event_dataset": "security"},
)
SYSMON = JsonSource(
    name="sysmon",
    file_name="sysmon.jsonl",
    mapping={
        "UtcTime": "@timestamp",
        "Computer": "host.name",
        "EventID": "event.code",
        "Image": "process.name",
        "CommandLine": "process.command_line",
        "User": "user.name",
        "SourceIp": "source.ip",
        "DestinationIp": "destination.ip",
        "SourcePort": "source.port",
        "DestinationPort": "destination.port",
        "Protocol": "network.transport",
    },
    constants={"event_module": "sysmon", "event_dataset": "sysmon"},
)
ZEEK_CONN = JsonSource(
    name="zeek_conn",
    file_name="zeek_conn.jsonl",
    unit="s",
    mapping={
        "ts": "@timestamp",
        "id.orig_h": "source.ip",
        "id.orig_p": "source.port",
        "id.resp_h": "destination.ip",
        "id.resp_p": "destination.port",
        "proto": "network.transport",
        "service": "network.protocol",
        "conn_state": "event.outcome",
        "uid": "event.id",
        "local_orig": "network.direction",
    },
    constants={"event_module": "zeek", "event_dataset": "zeek.conn"},
)


def record_schema(source: JsonSource) -> T.StructType:
    """Every mapped path as a literal key and as a nested path; all values are read as text."""
    tree: dict = {}
    paths = [*source.mapping, source.timestamp, "@timestamp"]
    for path in paths:
        at = tree
        *parents, leaf = path.split(".")
        for key in parents:
            if not isinstance(at.get(key), dict):
                at[key] = {}
            at = at[key]
        at.setdefault(leaf, None)

    def struct(node: dict, literal: list[str]) -> T.StructType:
        fields = [T.StructField(k, struct(v, []) if isinstance(v, dict) else T.StringType()) for k, v in node.items()]
        return T.StructType(fields + [T.StructField(path, T.StringType()) for path in literal])

    return struct(tree, list(dict.fromkeys(path for path in paths if "." in path)))


def parse_json_lines(lines: DataFrame, source: JsonSource, column: str = "value") -> DataFrame:
    """Add struct ``record`` with the mapped fields; blank and malformed lines are dropped.

    Only the mapped fields are read, in one parse. The line is parsed as the first element of an array whose second and
    last one holds a hash of the line: whatever stands after the record breaks the array, adds an element or ends
    it before the hash, so such a line is malformed too. A field of unexpected shape is null and does not
    spoil the rest.
    """
    fields = record_schema(source)
    text = F.trim(F.col(column))
    mark = F.xxhash64(text).cast("string")
    wrapped = F.concat(F.lit("["), text, F.lit(f',{{"{_END}":"'), mark, F.lit('"}]'))
    schema = T.ArrayType(T.StructType([*fields, T.StructField(_END, T.StringType())]))
    parsed = with_once(lines.filter(text != ""), _parts=F.from_json(wrapped, schema, {"allowSingleQuotes": "false"}), _mark=mark)
    parts = F.col("_parts")
    whole = parsed.filter((F.size(parts) == 2) & (parts[1].getField(_END) == F.col("_mark")) & parts[0].isNotNull())
    return whole.withColumn("record", parts[0]).drop("_parts", "_mark")


def json_path(record: Column, path: str) -> Column:
    """A field by dotted path: a literal key of that name first, then the nested path."""
    literal = record.getField(path)
    if "." not in path:
        return literal
    nested = record
    for key in path.split("."):
        nested = nested.getField(key)
    return F.coalesce(literal, nested)


def _typed(text: Column, name: str) -> Column:
    kind = TYPES[name].typeName()
    if kind == "integer":
        return integer(text)
    if kind == "double":
        return number(text)
    return text


def map_records(records: DataFrame, source: JsonSource) -> DataFrame:
    """Project struct ``record`` to the event schema and drop rows without a usable time.

    Time: the configured raw path, else the mapped ``@timestamp`` unless empty, else the raw one.
    """
    record = F.col("record")
    columns, mapped_time = [], F.lit(None).cast("string")
    for path, ecs in source.mapping.items():
        if ecs == "@timestamp":
            mapped_time = F.nullif(json_path(record, path), F.lit(""))
        else:
            columns.append(_typed(json_path(record, path), FROM_ECS[ecs]).alias(FROM_ECS[ecs]))
    time = F.coalesce(json_path(record, source.timestamp), mapped_time, json_path(record, "@timestamp"))
    columns += [F.lit(value).alias(name) for name, value in source.constants.items()]
    mapped = records.select(time.alias("_time"), *columns)
    timed = with_once(mapped, event_ts=utc_time(F.col("_time"), source.unit))
    return conform(timed.filter(F.col("event_ts").isNotNull()))


def read_json_source(spark: SparkSession, path: str, source: JsonSource) -> DataFrame:
    """One JSON-lines source as events; a missing path gives an empty frame."""
    return map_records(parse_json_lines(text_lines(spark, path), source), source)
