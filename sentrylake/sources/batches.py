"""A store that grows by batches. Each batch counts wholly or not at all, and only once.

``<root>/data/batch=<name>/source=…/dt=…`` holds the rows of a batch, ``<root>/ledger`` one row per batch that is
complete. Readers read the folders that the ledger names: what a killed write leaves behind is never seen, and
the next attempt at the same batch overwrites it. A batch that the ledger has is not written again, and rows whose
``event_uid`` the store has on the same source and day are left out, so a file that is read again under
another batch name adds nothing either. One writer at a time.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import STORE_SCHEMA
from ..session import stage
from .files import system_and_path
from .store import with_event_uid

LEDGER_SCHEMA = "batch string, n_rows bigint, n_known bigint, replaces array<string>"
BATCH_SCHEMA = T.StructType([*STORE_SCHEMA, T.StructField("batch", T.StringType())])
DAY = ["source", "dt"]


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """One row per complete batch: its name, rows written, rows left out as known, batches that it replaces."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(f"{root}/ledger")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def _folder(root: str, batch: str) -> str:
    return f"{root}/data/batch={batch}"


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    """All rows of complete batches, with ``batch``; filters on ``source`` and ``dt`` prune folders."""
    rows = ledger(spark, root).collect()  # one per batch
    replaced = {name for row in rows for name in row["replaces"] or ()}
    paths = [_folder(root, row["batch"]) for row in rows if row["n_rows"] and row["batch"] not in replaced]
    if not paths:
        return spark.createDataFrame([], BATCH_SCHEMA)
    return spark.read.schema(BATCH_SCHEMA).option("basePath", f"{root}/data").parquet(*paths)


def _write(rows: DataFrame, root: str, batch: str, compression: str) -> int:
    """Write the rows of one batch, whatever an earlier attempt has left there; their number."""
    few_files = rows.hint("rebalance", *DAY).sortWithinPartitions(*DAY, "event_ts")
    few_files.select(*STORE_SCHEMA.names).write.mode("overwrite").option("partitionOverwriteMode", "static").option(
        "compression", compression
    ).partitionBy(*DAY).parquet(_folder(root, batch))
    spark = rows.sparkSession
    return spark.read.schema(STORE_SCHEMA).parquet(_folder(root, batch)).count()


def _commit(spark: SparkSession, root: str, record: tuple) -> None:
    """The batch counts from here on: one file that appears as a whole."""
    spark.createDataFrame([record], LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/ledger")


def append_batch(events: DataFrame, root: str, batch: str, compression: str = "zstd") -> DataFrame:
    """Add the events (with ``source`` and ``dt``) that the store does not have; the batch's row of the ledger.

    Only the days that occur in the batch are read. Rows without a day are left out, as in the store of whole
    days. Events without ``event_uid`` get the content hash and their number among exact copies in the batch.
    """
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"a batch name has letters, digits, _, . and - only: {batch!r}")
    spark = events.sparkSession
    record = ledger(spark, root).filter(F.col("batch") == batch)
    if not record.isEmpty():
        return record
    if "event_uid" not in events.columns:
        events = with_event_uid(events)
    rows = stage(events.filter(F.col("dt").isNotNull()).select(*STORE_SCHEMA.names), "batch")
    days = rows.select(*DAY).distinct()
    store = read_batches(spark, root)
    known = store.join(days, DAY, "left_semi").select(*DAY, "event_uid")
    new = rows.dropDuplicates([*DAY, "event_uid"]).join(known, [*DAY, "event_uid"], "left_anti")
    n_rows = _write(new, root, batch, compression)
    _commit(spark, root, (batch, n_rows, rows.count() - n_rows, []))
    return ledger(spark, root).filter(F.col("batch") == batch)


def merge_batches(spark: SparkSession, root: str, batch: str, compression: str = "zstd") -> DataFrame:
    """Rewrite the store as one batch of fewer files, which takes the place of all others once it is complete."""
    record = ledger(spark, root).filter(F.col("batch") == batch)
    if record.isEmpty():
        store = read_batches(spark, root)
        old = [row["batch"] for row in ledger(spark, root).select("batch").collect()]
        _commit(spark, root, (batch, _write(store, root, batch, compression), 0, old))
    return ledger(spark, root).filter(F.col("batch") == batch)


def drop_replaced(spark: SparkSession, root: str) -> list[str]:
    """Remove the folders of batches that a complete one replaces; their names."""
    from pyarrow import fs

    names = sorted({name for row in ledger(spark, root).collect() for name in row["replaces"] or ()})
    gone = []
    for name in names:
        system, path = system_and_path(_folder(root, name))
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_dir(path)
            gone.append(name)
    return gone
