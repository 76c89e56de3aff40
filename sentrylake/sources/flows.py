"""CSV flow records with free column names."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.once import with_once
from ..functions.values import day_first_time, integer, number
from ..schema import EVENT_SCHEMA, conform
from ..session import stage
from .files import first_line, list_files

# Accepted column names per meaning; the first one present is used.
CANDIDATES = {
    "time": ["timestamp", "datetime", "date_time", "time", "ts", "flow_start", "starttime", "start_time"],
    "source_ip": ["src_ip", "source_ip", "ip_src", "srcip", "sourceaddress"],
    "destination_ip": ["dst_ip", "destination_ip", "ip_dst", "dstip", "destinationaddress"],
    "source_port": ["src_port", "sport", "source_port"],
    "destination_port": ["dst_port", "dport", "destination_port"],
    "protocol": ["protocol", "proto"],
    "label": ["label", "attack_cat", "attack_category"],
    "host": ["host", "hostname"],
    "user": ["user", "username", "account"],
    "forward_bytes": ["tot_fwd_bytes", "total_fwd_bytes"],
    "backward_bytes": ["tot_bwd_bytes", "total_bwd_bytes"],
}


def normal_name(name: str) -> str:
    """Trimmed, lower case, whitespace to ``_``, nothing but ``0-9a-z_``."""
    return re.sub(r"[^0-9a-z_]", "", re.sub(r"\s+", "_", name.strip().lower()))


def normal_columns(df: DataFrame) -> DataFrame:
    """Normalise all column names; of equal names the first column keeps the name."""
    names: list[str] = []
    for name in map(normal_name, df.columns):
        names.append(name if name and name not in names else f"{name}__{len(names)}")
    return df.toDF(*names)


def places(names: list[str], time_col: str | None = None) -> dict[str, int]:
    """Column number per meaning: of the first accepted name that there is; ``time_col`` is tried before the usual ones."""
    found = {}
    for meaning, accepted in CANDIDATES.items():
        wanted = ([normal_name(time_col)] if time_col and meaning == "time" else []) + accepted
        for name in wanted:
            if name in names:
                found[meaning] = names.index(name)
                break
    return found


def _events(df: DataFrame, pick: Callable[[str], Column | None], time_unit: str | None) -> DataFrame:
    def text(meaning: str) -> Column:
        column = pick(meaning)
        return F.lit(None).cast("string") if column is None else column.cast("string")

    forward, backward = pick("forward_bytes"), pick("backward_bytes")
    total = F.lit(None).cast("double")
    if forward is not None and backward is not None:
        total = F.coalesce(number(forward), F.lit(0.0)) + F.coalesce(number(backward), F.lit(0.0))
        both = pick("both_bytes")  # says per row whether its file has both
        total = total if both is None else F.when(both, total)
    events = with_once(df, event_ts=day_first_time(text("time"), time_unit)).filter(F.col("event_ts").isNotNull()).select(
        "event_ts",
        F.lit("custom_csv").alias("event_dataset"),
        F.coalesce(text("label"), F.lit("flow")).alias("event_action"),
        text("host").alias("host_name"),
        text("user").alias("user_name"),
        text("source_ip").alias("source_ip"),
        integer(text("source_port")).alias("source_port"),
        text("destination_ip").alias("destination_ip"),
        integer(text("destination_port")).alias("destination_port"),
        F.lower(text("protocol")).alias("network_transport"),
        total.alias("network_bytes"),
    )
    return conform(events)


def normalize_flows(df: DataFrame, time_col: str | None = None, time_unit: str | None = None) -> DataFrame | None:
    """One CSV layout (all columns text) as events; None if it has no time column.

    ``time_unit`` says in what bare numbers in the time column count (s, ms, us, ns).
    """
    df = normal_columns(df)
    place = places(df.columns, time_col)
    if "time" not in place:
        return None
    return _events(df, lambda meaning: F.col(df.columns[place[meaning]]) if meaning in place else None, time_unit)


_HEADS = pa.schema([
    ("file_path", pa.string()), ("n_columns", pa.int32()), ("status", pa.string()),
    *[(f"at_{meaning}", pa.int32()) for meaning in CANDIDATES],
])


def flow_files(spark: SparkSession, root: str, time_col: str | None = None, recursive: bool = True) -> DataFrame:
    """Every ``*.csv`` file below a folder with ``status`` (``ok``, or why it gives no events) and the place of each column.

    Only the heads of the files are read, in tasks. Empty files are not listed by Spark and hold nothing.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, file_path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                line, error = first_line(path)
                cells = next(csv.reader([line]), []) if line is not None else []
                names: list[str] = []
                for name in map(normal_name, cells):
                    names.append(name if name and name not in names else f"{name}__{len(names)}")
                place = places(names, time_col)
                status = f"unreadable: {error}" if line is None else "ok" if "time" in place else "no time column"
                rows.append([file_path, len(cells), status, *[place.get(meaning) for meaning in CANDIDATES]])
            columns = zip(*rows) if rows else [[] for _ in _HEADS]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HEADS)], schema=_HEADS)

    files = list_files(spark, root, "*.csv", recursive).select("path", "file_path")
    ddl = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'string'}" for f in _HEADS)
    return files.mapInArrow(heads, ddl)


def skipped_files(files: DataFrame) -> DataFrame:
    """The files that give no events, and why."""
    return files.filter(F.col("status") != "ok").select("file_path", "status")


def read_flows(
    spark: SparkSession, root: str, time_col: str | None = None, recursive: bool = True, time_unit: str | None = None,
    quoted_newlines: bool = False, files: DataFrame | None = None,
) -> DataFrame:
    """All ``*.csv`` files below a folder as events, whatever their headers.

    One scan reads all files as numbered columns; each row finds its columns by a join with its file's head
    (``files`` of ``flow_files``). A header line has no time and so is no event. With ``quoted_newlines`` cells
    may hold line breaks; a file is then not split.
    """
    heads = stage(flow_files(spark, root, time_col, recursive) if files is None else files, "flow-files")
    width = heads.filter(F.col("status") == "ok").agg(F.max("n_columns")).first()[0]
    if not width:
        return spark.createDataFrame([], EVENT_SCHEMA)
    cells = [f"c{i}" for i in range(width)]
    raw = (
        spark.read.schema(", ".join(f"{c} string" for c in cells))
        .option("header", False).option("multiLine", quoted_newlines).option("ignoreCorruptFiles", True)
        .option("pathGlobFilter", "*.csv").option("recursiveFileLookup", recursive)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(root)
        .select(F.array(*cells).alias("cells"), F.col("_metadata.file_path").alias("file_path"))
    )
    joined = raw.join(heads.filter(F.col("status") == "ok").drop("status", "n_columns"), "file_path")

    def pick(meaning: str) -> Column | None:
        if meaning == "both_bytes":
            return F.col("at_forward_bytes").isNotNull() & F.col("at_backward_bytes").isNotNull()
        return F.when(F.col(f"at_{meaning}").isNotNull(), F.get("cells", F.col(f"at_{meaning}")))

    return _events(joined, pick, time_unit)
