"""The fixed event schema, its ECS names, and the feature columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# Our column, the ECS name it is printed under, its type.
ECS_COLUMNS = [
    ("event_ts", "@timestamp", T.TimestampType()),
    ("event_module", "event.module", T.StringType()),
    ("event_dataset", "event.dataset", T.StringType()),
    ("event_action", "event.action", T.StringType()),
    ("event_outcome", "event.outcome", T.StringType()),
    ("event_code", "event.code", T.StringType()),
    ("event_id", "event.id", T.StringType()),
    ("host_name", "host.name", T.StringType()),
    ("user_name", "user.name", T.StringType()),
    ("user_target_name", "user.target.name", T.StringType()),
    ("source_ip", "source.ip", T.StringType()),
    ("source_port", "source.port", T.IntegerType()),
    ("destination_ip", "destination.ip", T.StringType()),
    ("destination_port", "destination.port", T.IntegerType()),
    ("network_transport", "network.transport", T.StringType()),
    ("network_protocol", "network.protocol", T.StringType()),
    ("network_direction", "network.direction", T.StringType()),
    ("network_bytes", "network.bytes", T.DoubleType()),
    ("process_name", "process.name", T.StringType()),
    ("process_command_line", "process.command_line", T.StringType()),
    ("message", "message", T.StringType()),
    ("log_file_path", "log.file.path", T.StringType()),
]

TYPES = {name: dtype for name, _, dtype in ECS_COLUMNS}
ECS_NAMES = {name: ecs for name, ecs, _ in ECS_COLUMNS} | {
    "session_id": "session.id",
    "process_command_line_entropy": "process.command_line_entropy",
    "anom_score": "anom.score",
}
FROM_ECS = {ecs: name for name, ecs, _ in ECS_COLUMNS}

EVENT_SCHEMA = T.StructType([T.StructField(name, dtype) for name, _, dtype in ECS_COLUMNS])
STORE_SCHEMA = T.StructType(
    [T.StructField("event_uid", T.StringType())]
    + list(EVENT_SCHEMA)
    + [T.StructField("source", T.StringType()), T.StructField("dt", T.DateType())]
)

FLAGS = ["login_failed", "conn_suspicious"]
WINDOW_MINUTES = [1, 5, 15]
ENTROPY = "process_command_line_entropy"
ID_COLUMNS = [
    "event_uid", "event_ts", "dt", "host_name", "user_name", "source_ip", "destination_ip", "session_id",
]
FLOW_KEYS = ["source_ip", "destination_ip", "network_transport"]


def feature_names(windows: list[int] | None = None) -> list[str]:
    """The feature columns in their fixed order: base features, then counts by window."""
    windows = WINDOW_MINUTES if windows is None else windows
    return FLAGS + [ENTROPY] + [f"{flag}_count_{w}m" for w in windows for flag in FLAGS]


def conform(df: DataFrame) -> DataFrame:
    """Project to the event schema; columns the source does not have become null."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in present else F.lit(None)).cast(dtype).alias(name)
            for name, _, dtype in ECS_COLUMNS
        ]
    )


def ecs_names(df: DataFrame) -> DataFrame:
    """Rename our columns to the dotted ECS names (for sinks only)."""
    return df.withColumnsRenamed({name: ECS_NAMES[name] for name in df.columns if name in ECS_NAMES})
