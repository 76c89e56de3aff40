"""Session settings and the shared folder for stage tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .sources.files import system_and_path

# Time zone, skew handling and batch size. All are runtime settings, so they also apply to a session made elsewhere.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows may hold whole texts: a batch of them lies in the JVM and in Python at once
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    # a table of few bytes in its compressed files can be gigabytes as rows: what grows with the input is broadcast by
    # its measured size only, not by that of its files
    "spark.sql.sources.fileCompressionFactor": "100",
}


def build_session(app_name: str = "sentrylake", **conf: str) -> SparkSession:
    """Create (or reuse) a session with the engine's settings."""
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor sees, taken from ``spark.checkpoint.dir``.

    A cluster must name it. With a local master, where all tasks share one disk, a temporary folder is
    set where there is none, and removed when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="sentrylake-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/sentrylake/{app}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and continue from there.

    Cuts the lineage: a lost executor re-reads files instead of replaying the plan,
    and values that are not repeatable (partition ids) are frozen.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Remove the stage tables of this application."""
    from pyarrow import fs

    system, path = system_and_path(f"{shared_folder(spark)}/sentrylake/{spark.sparkContext.applicationId}")
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_dir(path)
