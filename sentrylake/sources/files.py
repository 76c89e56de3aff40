"""File access shared by the readers."""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def text_lines(
    spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False, places: bool = False
) -> DataFrame:
    """Lines with ``value`` and ``file_path``; a missing path gives an empty frame.

    With ``places`` also where they stand: ``file_at``, the start of their split in the file, and ``row``, which grows
    along the split. The rows must be written before they are moved, since ``row`` is that of the scan.
    """
    more = [F.col("_metadata.file_block_start").alias("file_at"), F.monotonically_increasing_id().alias("row")] if places else []
    reader = spark.read.option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    try:
        return reader.text(path).select("value", F.col("_metadata.file_path").alias("file_path"), *more)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string, file_path string" + ", file_at bigint, row bigint" * places)


def list_files(spark: SparkSession, path: str, pattern: str, recursive: bool = True) -> DataFrame:
    """``path``, ``file_path`` (as the readers' metadata have it) and ``size`` of the files below a folder, unread."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    try:
        files = reader.option("recursiveFileLookup", recursive).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, file_path string, size bigint")
    return files.select("path", F.col("_metadata.file_path").alias("file_path"), F.col("length").alias("size"))


def system_and_path(uri: str):
    """File system and path of an address: local disk, HDFS or an object store."""
    from pyarrow import fs

    for alias in ("s3a://", "s3n://"):
        if uri.startswith(alias):
            uri = "s3://" + uri[len(alias):]
    if uri.startswith("file:/") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")


def empty_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path`` and ``size`` of the files of zero bytes below a folder, listed in a task; hidden ones are left out."""
    uri = path if "://" in path or path.startswith("file:/") else f"file://{path}"

    def listed(batches: Iterator) -> Iterator:
        import pandas as pd  # not for every task that imports this module
        from pyarrow import fs

        for batch in batches:
            found = []
            for root in batch["path"]:
                system, base = system_and_path(root)
                scheme = root.split(":", 1)[0] + (":" if root.startswith("file:") else "://")
                for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)):
                    hidden = any(part[:1] in "._" and "=" not in part for part in info.path[len(base):].split("/") if part)
                    if info.is_file and not info.size and not hidden and fnmatch.fnmatch(info.base_name, pattern):
                        found.append((f"{scheme}{info.path}", 0))
            yield pd.DataFrame(found, columns=["path", "size"])

    return spark.createDataFrame([(uri,)], "path string").mapInPandas(listed, "path string, size bigint")


def open_file(uri: str) -> io.BufferedIOBase:
    """Open a file on local disk, HDFS or an object store inside a task."""
    system, path = system_and_path(uri)
    return io.BufferedReader(system.open_input_stream(path))


def first_line(uri: str) -> tuple[str | None, str]:
    """First line of a file, and why it could not be read (else empty)."""
    try:
        with open_file(uri) as stream:
            return stream.readline().decode("utf-8-sig", errors="replace").rstrip("\r\n"), ""
    except OSError as error:
        return None, str(error)[:200]
