"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line with ASCII spaces stripped at both ends and A-Z lower-cased; lines with a key
shorter than ``min_chars`` are never touched. A run holds, sorted by 128-bit key hash, in how many
documents of its batch a key was found and the largest doc_id that holds it. Each batch is merged with
the runs on the hash: keys that no run has (the anti join) become a run of the lowest level, what it adds to
known keys is kept as hits; ``fanout`` runs of a level are compacted into one of the next. Keys found in
``min_docs`` documents or more lose their lines, except in the largest doc_id. What is computed in the end is
the lines that go, which are far fewer than those that stay.

``dedup`` cuts the documents into batches by hash and adds one after the other; a line goes by its count over all of
them, so the result does not depend on the batches. ``LineRuns`` serves batches that arrive over time as well.

Defined cases: null and empty text is one empty line; a null doc_id counts as the smallest; each row is a
document of its own, so of rows that share the largest doc_id all keep their lines; texts that lose all
lines become empty; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import new_folder, stage
from .common import SPACES

KEYS = "h bigint, g bigint, doc_id bigint, text_hash bigint, at array<int>"
RUN = "h bigint, g bigint, n bigint, last bigint"
_KEY_TYPES = pa.schema([
    ("h", pa.int64()), ("g", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.list_(pa.int32())),
])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def keys_of(text: str, min_chars: int) -> dict[tuple[int, int], list[int]]:
    """Line numbers by key hash, for keys of ``min_chars`` code points or more."""
    found: dict[tuple[int, int], list[int]] = {}
    for at, line in enumerate(text.split("\n")):
        line = line.strip(SPACES)
        if len(line) >= min_chars:
            digest = xxhash.xxh3_128_intdigest(line.encode("utf-8").lower())
            found.setdefault((_signed(digest >> 64), _signed(digest & (1 << 64) - 1)), []).append(at)
    return found


def line_keys(documents: DataFrame, min_chars: int) -> DataFrame:
    """One row per document and different key, with the key's line numbers."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                text_hash = _signed(xxhash.xxh64_intdigest(text, 42))
                for (h, g), at in keys_of(text, min_chars).items():
                    for column, value in zip(columns, (h, g, doc_id, text_hash, at)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _KEY_TYPES)], schema=_KEY_TYPES)

    texts = documents.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(extract, KEYS)


class LineRuns:
    """Runs by level. A run is a Parquet folder, partitioned by ranges of the hash and sorted by it.

    A key is in one run only, that of the batch in which it came first, with its count there; what later batches
    add to it is kept apart as hits.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4) -> None:
        self.spark, self.fanout, self.levels, self.hits = spark, fanout, [], []

    def _write(self, rows: DataFrame) -> str:
        path = new_folder(self.spark, "line-run")
        rows.repartitionByRange("h", "g").sortWithinPartitions("h", "g").write.parquet(path)
        return path

    def _read(self, paths: Sequence[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).parquet(*paths)

    def _runs(self) -> DataFrame:
        return self._read([path for level in self.levels for path in level])

    def add(self, keys: DataFrame) -> None:
        """Merge a batch (rows of ``line_keys``) with the runs: keys that none has become a run, the others hits.

        Full levels are compacted.
        """
        batch = stage(keys.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")), "line-batch")
        if any(self.levels):
            known = self._runs().select("h", "g")
            self.hits.append(stage(batch.join(known, ["h", "g"], "left_semi"), "line-hits"))
            batch = batch.join(known, ["h", "g"], "left_anti")
        run, level = self._write(batch), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run, old = self._write(self._read(self.levels[level])), self.levels[level]
            self.levels[level] = []
            for path in old:  # emptied, so that a compacted run holds no disk
                self.spark.createDataFrame([], RUN).coalesce(1).write.mode("overwrite").parquet(path)
            level += 1

    def repeated(self, min_docs: int) -> DataFrame:
        """Keys found in ``min_docs`` documents or more, with the largest doc_id."""
        if not self.hits:
            return self._runs().where(F.col("n") >= min_docs)
        hits = reduce(DataFrame.unionByName, self.hits).groupBy("h", "g").agg(F.sum("n").alias("_n"), F.max("last").alias("_last"))
        counted = self._runs().join(hits, ["h", "g"], "left").select(
            "h", "g", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.greatest("last", "_last").alias("last")
        )
        return counted.where(F.col("n") >= min_docs)

    def going(self, keys: DataFrame, min_docs: int) -> DataFrame:
        """Line numbers that go, per document: (doc_id, text_hash, gone)."""
        earlier = (F.col("doc_id") < F.col("last")) | (F.col("doc_id").isNull() & F.col("last").isNotNull())
        repeated = stage(self.repeated(min_docs), "lines-repeated")  # few; keys held by very many documents can be split
        merged = keys.join(repeated, ["h", "g"]).where(earlier)
        return merged.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("at")).alias("gone"))


def dedup(
    documents: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 4
) -> DataFrame:
    """``documents`` with repeated lines taken out of ``text``, plus ``_lines`` and ``_dropped`` (their numbers)."""
    spark = documents.sparkSession
    path = new_folder(spark, "line-keys")
    keys = line_keys(documents, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)))
    keys.write.partitionBy("batch").parquet(path)
    keys = spark.read.schema(KEYS + ", batch bigint").parquet(path)
    runs = LineRuns(spark, fanout)
    for number in range(batches):
        runs.add(keys.where(F.col("batch") == number))
    going = runs.going(keys, min_docs).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    rows = documents.select(F.struct(*documents.columns).alias("_row"))
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    same = F.col("_row.doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash"))
    lines, gone = F.split(text, "\n"), F.array_distinct("gone")
    left = F.when(F.col("gone").isNull(), F.col("_row.text")).otherwise(_without(lines, gone))
    # line numbers are hashed, texts stream by: a merge join would sort whole texts
    return rows.join(going.hint("shuffle_hash"), same, "left").select(
        *[left.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in documents.columns],
        F.size(lines).cast("long").alias("_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias("_dropped"),
    )


def _without(lines: Column, gone: Column) -> Column:
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.transform(F.array(lines), lambda all_: F.array_join(F.transform(left, lambda i: F.get(all_, i)), "\n"))[0]


def without_repeated_lines(documents: DataFrame, **settings) -> DataFrame:
    """``documents`` with the text that is left; the columns are as they were."""
    return dedup(documents, **settings).drop("_lines", "_dropped")
