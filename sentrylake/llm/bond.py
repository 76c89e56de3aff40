"""Hard negatives of anchors by a vertical scan (BOND) over blocks of vectors.

The vectors are dealt into blocks of rows, the anchors into blocks of anchors, and every pair of blocks meets
in one task, where the vectors lie as columns. An anchor reads the columns in descending order of its own
components. What the columns not yet read can still add is bounded by their least and greatest
values in the block; candidates whose bounds rule them out leave the bitmap, until the scores of those that
remain are complete. The first scan finds each anchor's nearest rows of its label; the second finds, for
each of these, the best rows of other labels whose score lies in a window below the positive's score.

Scores are inner products of integers, exact as long as they fit 64 bits (Python integers where a sum could pass 2^53). Blocks bound
memory only; every anchor meets every row, so the work grows with anchors times rows.

Defined cases: rows with a null label, a null vector or a null component take no part; vectors of different
lengths are compared over the shorter; a null id sorts last; repeated rows are rows of their own (a
copy of an anchor is another row); anchors without another row of their label, and positives without a
row in the window, give no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

ROWS, ANCHORS = 2_048, 1_024  # of a block
LEAST_BLOCKS = 32
STEP = 16  # columns read between two looks at the bounds
EXACT = 2**53


@dataclass
class Block:
    """Rows of one block, sorted by label, their vectors as columns."""

    row: np.ndarray
    ids: np.ndarray
    unnamed: np.ndarray
    label: np.ndarray
    columns: np.ndarray  # (dimensions, rows)
    low: np.ndarray
    high: np.ndarray

    def first(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places in ``at`` of the k best: score descending, then id, nulls last."""
        return np.lexsort((self.row[at], self.ids[at], self.unnamed[at], -scores))[:k]


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors as rows, shorter ones filled with 0."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat, width = vectors.flatten().to_numpy(zero_copy_only=False), int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _block(table: pa.Table) -> Block:
    table = table.combine_chunks().sort_by("label")
    ids = table["vec_id"].combine_chunks()
    columns = np.ascontiguousarray(_matrix(table["vector"].combine_chunks()).T)
    low, high = (columns.min(axis=1), columns.max(axis=1)) if columns.size else (np.zeros(0), np.zeros(0))
    return Block(
        table["_row"].to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
        table["label"].to_numpy(), columns, low, high,
    )


def vertical_scan(
    block: Block, anchor: np.ndarray, start: np.ndarray, needed: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``start`` that ``needed`` (by least and greatest score) keeps to the end, and their scores."""
    width = min(len(anchor), len(block.columns))
    order = np.argsort(-np.abs(anchor[:width]), kind="stable")
    weights, columns = anchor[order], block.columns
    ends = weights * block.low[order], weights * block.high[order]
    less, more = (np.append(f(*ends)[::-1].cumsum()[::-1], 0) for f in (np.minimum, np.maximum))
    alive, total = start, np.zeros(len(start), columns.dtype)
    for at in range(0, width, STEP):
        read = order[at : at + STEP]
        part = columns[read] if len(alive) == columns.shape[1] else columns[np.ix_(read, alive)]
        total = total + weights[at : at + STEP] @ part
        done = min(at + STEP, width)
        keep = needed(total + less[done], total + more[done])
        if not keep.all():
            alive, total = alive[keep], total[keep]
        if not len(alive):
            break
    return alive, total


def _best(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Keeps what may be among the k highest."""

    def needed(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return most >= np.partition(least, len(least) - k)[len(least) - k] if len(least) > k else np.ones(len(least), bool)

    return needed


def _windows(floors: np.ndarray, tops: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Keeps what may lie in one of the windows."""

    def needed(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        keep = (most >= floors.min()) & (least <= tops.max())
        at = np.flatnonzero(keep)
        inside = (most[at, None] >= floors) & (least[at, None] <= tops)
        keep[at] = inside.any(axis=1)
        return keep

    return needed


def _comparable(block: Block, anchors: np.ndarray) -> np.ndarray:
    """The anchors in a type in which all sums are exact; the block's columns are brought to it too."""
    size = int(np.abs(block.columns).max(initial=0)) * int(np.abs(anchors).max(initial=0)) * max(1, anchors.shape[1])
    kind = np.float64 if size < EXACT else object
    block.columns, block.low, block.high = (x.astype(kind) for x in (block.columns, block.low, block.high))
    return anchors.astype(kind)


def _table(parts: list[tuple], schema: pa.Schema) -> pa.Table:
    """One table of the columns that the parts hold piece by piece."""
    columns = zip(*parts) if parts else [[] for _ in schema]
    arrays = [np.concatenate([np.asarray(c, np.int64) for c in column]) if parts else np.zeros(0, np.int64) for column in columns]
    return pa.Table.from_arrays([pa.array(a, pa.int64()) for a in arrays], schema=schema)


_LONG = lambda *names: pa.schema([(name, pa.int64()) for name in names])
_POSITIVE = _LONG("anchor_row", "row", "score")
_NEGATIVE = _LONG("anchor_row", "positive_row", "row", "score")


def _positives(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    """The k best rows of the block with the label of each anchor."""
    if not rows.num_rows or not anchors.num_rows:
        return _table([], _POSITIVE)
    block, out = _block(rows), []
    vectors = _comparable(block, _matrix(anchors["vector"].combine_chunks()))
    for row, label, vector in zip(anchors["_row"].to_numpy(), anchors["label"].to_numpy(), vectors):
        start = np.arange(*np.searchsorted(block.label, [label, label + 1]))
        start = start[block.row[start] != row]
        if len(start):
            at, scores = vertical_scan(block, vector, start, _best(k))
            best = block.first(at, scores, k)
            out.append((np.full(len(best), row), block.row[at[best]], scores[best]))
    return _table(out, _POSITIVE)


def _negatives(rows: pa.Table, anchors: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """For each positive of each anchor, the k best rows of the block with another label and a score in the window."""
    if not rows.num_rows or not anchors.num_rows:
        return _table([], _NEGATIVE)
    block, out = _block(rows), []
    vectors = _comparable(block, _matrix(anchors["vector"].combine_chunks()))
    everything = np.arange(len(block.row))
    found = anchors["positives"].to_pylist()
    for row, label, vector, positives in zip(anchors["_row"].to_numpy(), anchors["label"].to_numpy(), vectors, found):
        scores_of = np.array([p["score"] for p in positives], block.columns.dtype)
        needed, other = _windows(low * scores_of, high * scores_of), block.label != label
        first = np.flatnonzero(other)
        at, scores = vertical_scan(
            block, vector, everything if len(first) * 2 > len(everything) else first,
            lambda least, most: needed(100 * least, 100 * most),
        )
        at, scores = at[other[at]], scores[other[at]]
        for positive, score in zip(positives, scores_of):
            inside = np.flatnonzero((100 * scores >= low * score) & (100 * scores <= high * score))
            best = inside[block.first(at[inside], scores[inside], k)]
            out.append((np.full(len(best), row), np.full(len(best), positive["row"]), block.row[at[best]], scores[best]))
    return _table(out, _NEGATIVE)


def _first(df: DataFrame, names: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each key, with their id, and their rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    named = df.join(names.select(F.col("_row").alias("row"), "vec_id"), "row")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and ``vector``, an array of integers. Rows for which ``anchor`` holds are the
    queries. A positive is one of the first rows of the anchor's label; its negatives are the first
    rows of other labels with ``low`` % to ``high`` % of its score.
    """
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    kept = rows.select("vec_id", F.col("label").cast("long"), F.col("vector").cast("array<bigint>"), F.coalesce(anchor, F.lit(False)).alias("_anchor"))
    kept = stage(kept.where(usable).withColumn("_row", F.monotonically_increasing_id()), "vectors")
    sizes = kept.agg(F.count(F.lit(1)), F.count_if("_anchor")).first()
    n_rows, n_anchors = max(LEAST_BLOCKS, -(-sizes[0] // ROWS)), max(1, -(-sizes[1] // ANCHORS))
    in_block = lambda name, n: F.pmod(F.xxhash64("_row"), F.lit(n)).alias(name)
    every = lambda name, n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    dealt = kept.select("_row", "vec_id", "label", "vector", in_block("_b", n_rows), every("_a", n_anchors)).groupBy("_b", "_a")

    def against(queries: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: pa.Schema) -> DataFrame:
        asked = queries.select("*", in_block("_a", n_anchors), every("_b", n_rows)).groupBy("_b", "_a")
        return dealt.cogroup(asked).applyInArrow(work, ", ".join(f"{name} long" for name in schema.names))

    queries = kept.where("_anchor").select("_row", F.col("vec_id").alias("anchor_id"), "label", "vector")
    near = against(queries.drop("anchor_id"), lambda r, a: _positives(r, a, positives), _POSITIVE)
    near = stage(_first(near, kept, ["anchor_row"], positives), "positives")
    windows = near.groupBy("anchor_row").agg(F.collect_list(F.struct("row", "score")).alias("positives"))  # at most ``positives``
    asked = stage(queries.drop("anchor_id").join(windows, F.col("_row") == F.col("anchor_row")).drop("anchor_row"), "anchors")
    hard = against(asked, lambda r, a: _negatives(r, a, negatives, low, high), _NEGATIVE)
    hard = _first(hard, kept, ["anchor_row", "positive_row"], negatives)
    pairs = near.select(
        "anchor_row", F.col("row").alias("positive_row"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    ).join(queries.select(F.col("_row").alias("anchor_row"), "anchor_id"), "anchor_row")
    return hard.join(pairs, ["anchor_row", "positive_row"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
