"""Importance resampling towards a target text: documents drawn by weight, without replacement.

Words and runs of words are hashed into buckets. A bucket's gain is the log ratio of its share in the
target to its share in the documents, both smoothed by one; a document's weight is the mean gain of its
features, looked up in one array. With Gumbel noise from a hash of the id, the highest scores are a
weighted draw. The cut is found by weighted median-of-medians: every partition tells the median of the
keys that remain in it; the median of these medians, weighted by how many keys remain, has at least a
quarter of all keys on either side, so that each round discards a guaranteed share. Only the winners are
sorted. What reaches the driver is one row per bucket, and one row per partition in each round.

Defined cases: null and empty texts have no features and weight 0; a null id is hashed as the empty text
and sorts last; repeated rows are scored each, and which of several equal ones is drawn first is fixed by
their place in the written table; an empty target gives gains by the documents alone; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .common import position_in_group

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
DIRECT = 4_096  # keys that are sorted at once
ORDER = ["_low", "_unnamed", "_id", "_row"]
# A-Z become lower-case; what is no ASCII letter, no digit and within ASCII parts words
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def features(text: bytes, longest: int) -> list[bytes]:
    """The words, then all runs of 2 to ``longest`` consecutive words, joined by one space."""
    single = words(text)
    runs = [[b" ".join(single[i : i + n]) for i in range(len(single) - n + 1)] for n in range(2, longest + 1)]
    return single + [run for of_length in runs for run in of_length]


def buckets_of(found: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % buckets


def _texts(column: pa.Array) -> list[bytes]:
    return [text or b"" for text in column.cast(pa.large_binary()).to_pylist()]


def bucket_counts(rows: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts fall into each bucket: one array per task, added up by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch.column(0)):
                total += np.bincount(buckets_of(features(text, longest), buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counted = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():  # at most one row per bucket
        total[bucket] = n
    return total


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, per bucket."""
    width = len(documents)
    of_all, of_target = float(documents.sum() + width), float(target.sum() + width)
    return np.array(
        [math.floor(1000 * math.log(((t + 1) * of_all) / ((s + 1) * of_target))) for s, t in zip(documents.tolist(), target.tolist())],
        np.int64,
    )


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 x Gumbel noise) from the first 32 bits of a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(2.0**32))))


def scored(documents: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(gain)  # ``buckets`` numbers

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weigh(texts: pa.Array) -> pa.Array:
        table, out = shared.value, np.zeros((3, len(texts)), np.int64)
        for at, text in enumerate(_texts(texts)):
            found = features(text, longest)
            if found:
                n_words = len(found) if longest == 1 else len(words(text))
                out[:, at] = n_words, len(found), int(table[buckets_of(found, len(table))].sum()) // len(found)
        return pa.StructArray.from_arrays([pa.array(row) for row in out], ["n_words", "n_features", "weight"])

    weighed = documents.select("doc_id", weigh("text").alias("_w")).select("doc_id", "_w.*")
    return weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def _before(limit: tuple) -> Column:
    """Whether a row's key sorts before ``limit``."""
    return F.struct(*ORDER) < F.struct(*[F.lit(v).alias(name) for name, v in zip(ORDER, limit)])


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per side of the pivot, how many keys of this partition lie there, and their median."""
    held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if held:
        table = pa.concat_tables(held)
        for side in (True, False):
            own = table.filter(pa.compute.equal(table["_first"], side))
            if own.num_rows:
                order = own.sort_by([(name, "ascending") for name in ORDER])
                row = order.slice((own.num_rows - 1) // 2, 1).append_column("_n", pa.array([own.num_rows], pa.int64()))
                yield row.combine_chunks().to_batches()[0]


def cutoff(keys: DataFrame, wanted: int, total: int) -> tuple:
    """The key of the row at place ``wanted`` (from 1) of ``total`` rows in the order of ORDER; keys differ."""
    schema = f"{keys.select(*ORDER).schema.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, _first boolean, _n long"
    written, pivot = total, None
    while total > DIRECT:
        side = F.lit(True) if pivot is None else _before(pivot)
        found = keys.select(*ORDER, side.alias("_first"))
        if pivot is not None:  # the pivot itself is counted on neither side
            found = found.where(F.struct(*ORDER) != F.struct(*[F.lit(v).alias(n) for n, v in zip(ORDER, pivot)]))
        medians = found.mapInArrow(_sides, schema).collect()  # at most two rows per partition
        first = sum(row["_n"] for row in medians if row["_first"])
        if pivot is not None and wanted == first + 1:
            return pivot
        keep = pivot is None or wanted <= first
        if pivot is not None:
            after = F.struct(*[F.lit(v).alias(n) for n, v in zip(ORDER, pivot)]) < F.struct(*ORDER)
            keys, total = (keys.where(_before(pivot)), first) if keep else (keys.where(after), total - first - 1)
            wanted -= 0 if keep else first + 1
        if total * 8 <= written and total > DIRECT:  # what is discarded is not read again
            keys, written = stage(keys, "remaining-keys"), total
        ordered = sorted((row for row in medians if row["_first"] == keep), key=lambda row: tuple(row[n] for n in ORDER))
        half, seen = total / 2, 0
        for row in ordered:
            seen += row["_n"]
            pivot = tuple(row[n] for n in ORDER)
            if seen >= half:
                break
    return tuple(keys.select(*ORDER).orderBy(*ORDER).limit(wanted).collect()[-1])


def draw(rows: DataFrame, percent: int, eligible: Column) -> DataFrame:
    """Add ``rank``: the place from 1 among the drawn, by score and then doc_id; null for the rest.

    ``floor(percent * N / 100)`` rows are drawn from the N eligible ones.
    """
    kept = rows.columns
    row = F.monotonically_increasing_id()
    rows = stage(rows.withColumn("_may", F.coalesce(eligible, F.lit(False))).withColumn("_row", row), "importance-scores")
    rows = rows.withColumns({
        "_low": -F.col("score"), "_unnamed": F.col("doc_id").isNull(),
        "_id": F.coalesce("doc_id", F.lit(0).cast(rows.schema["doc_id"].dataType)),
    })
    keys = rows.where("_may").select(*ORDER)
    total = keys.count()
    wanted = percent * total // 100
    if wanted == 0:
        return rows.select(*kept, F.lit(None).cast("long").alias("rank"))
    last = cutoff(keys, wanted, total)
    limit = F.struct(*[F.lit(v).alias(name) for name, v in zip(ORDER, last)])
    drawn = F.col("_may") & (F.struct(*ORDER) <= limit)
    ranked = position_in_group(rows.where(drawn), [], [F.col(name) for name in ORDER], "importance-winners")
    return ranked.select(*kept, F.col("place").alias("rank")).unionByName(
        rows.where(~drawn).select(*kept, F.lit(None).cast("long").alias("rank"))
    )


def resample(
    documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 1, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and rank in the draw (null if not drawn).

    ``target`` has a column ``text``. Features are runs of 1 to ``longest`` words.
    """
    gain = gains(bucket_counts(documents, buckets, longest), bucket_counts(target, buckets, longest))
    return draw(scored(documents, gain, longest, seed), percent, F.col("n_words") >= least_words)
