"""Work on each row together with the rows before and after it in a global order.

The table is dealt by ranges of the order and sorted inside its partitions. A task streams over its
partition and holds one batch and two rows. The first and last row of a partition lack a neighbour: they
are written with what is known and paired afterwards, two rows per partition. What is brought together to find
out who follows whom are their numbers; the rows themselves come by an equi-join on these. The streamed
results are written, which also fixes the partition numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..session import stage

#: (rows, start, stop) -> results of rows[start:stop]; the rows around them are there if they exist.
Work = Callable[[pa.RecordBatch, int, int], pa.RecordBatch]
CHUNK_BYTES = 4 << 20


def _joined(batches: Sequence[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about CHUNK_BYTES."""
    for batch in batches:
        step = max(1, int(batch.num_rows * CHUNK_BYTES / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def with_neighbours(
    rows: DataFrame, order: Sequence[Column], work: Work, schema: str, wrap: bool = False, name: str = "neighbours"
) -> DataFrame:
    """``work`` on every row, in the order given; ``schema`` is that of its results.

    With ``wrap`` the first row follows the last; otherwise they lack a neighbour, as does a single row.
    """
    own = rows.schema.simpleString()
    fields = StructType.fromDDL(schema).fieldNames()

    def results(done: pa.RecordBatch) -> pa.RecordBatch:
        n, row = done.num_rows, kinds[0]
        return pa.RecordBatch.from_arrays(
            [*done.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, row), pa.nulls(n, row)],
            [*done.schema.names, "_part", "_place", "_own", "_inner"],
        )

    def pending(batch: pa.RecordBatch, place: int, inner: pa.RecordBatch | None, empty: pa.RecordBatch) -> pa.RecordBatch:
        part, row = TaskContext.get().partitionId(), kinds[0]
        known = inner.to_struct_array() if inner is not None else pa.nulls(1, row)
        return pa.RecordBatch.from_arrays(
            [*[pa.nulls(1, t) for t in empty.schema.types], pa.array([part], pa.int32()), pa.array([place], pa.int32()),
             batch.to_struct_array(), known],
            [*empty.schema.names, "_part", "_place", "_own", "_inner"],
        )

    kinds: list[pa.DataType] = []

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last two rows
        for batch in _pieces(batches):
            kinds[:] = [pa.struct(list(batch.schema))]
            started = held is None or held.num_rows < 2
            seen = _joined([held, batch]) if held is not None else batch
            if started and seen.num_rows >= 2:
                yield pending(seen.slice(0, 1), 0, seen.slice(1, 1), work(seen, 0, 0))
            if seen.num_rows > 2:
                yield results(work(seen, 1, seen.num_rows - 1))
            held = seen.slice(max(0, seen.num_rows - 2))
        if held is not None:
            last = held.num_rows - 1
            yield pending(held.slice(last), 1, held.slice(0, 1) if last else None, work(held, 0, 0))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                around = [batch.column(c).slice(at, 1) for c in ("_before", "_own", "_after")]
                known = [pa.RecordBatch.from_struct_array(c) if c[0].is_valid else None for c in around]
                start = 0 if known[0] is None else 1
                yield work(_joined([k for k in known if k is not None]), start, start + 1)

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = StructType.fromDDL(f"{schema}, _part int, _place int, _own {own}, _inner {own}")
    staged = stage(ranged.mapInArrow(stream, held), name)
    # two rows per partition; a partition of one row has only its last, whose inner neighbour is missing
    open_rows = staged.where("_part IS NOT NULL").select("_part", "_place", "_own", "_inner")
    ends = Window.orderBy("_part", "_place")
    every = ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.struct("_part", "_place")
    before, after = F.lag(at).over(ends), F.lead(at).over(ends)
    if wrap:
        before, after = F.coalesce(before, F.last(at).over(every)), F.coalesce(after, F.first(at).over(every))
    numbers = open_rows.select("_part", "_place", F.col("_inner").isNull().alias("_alone")).withColumns({"_b": before, "_a": after})
    first = F.col("_place") == 0
    links = numbers.select(
        "_part", "_place", F.when(first | F.col("_alone"), F.col("_b")).alias("_b"), F.when(~first, F.col("_a")).alias("_a")
    )
    beside = [open_rows.select(F.struct("_part", "_place").alias(key), F.col("_own").alias(name)) for key, name in (("_b", "_before"), ("_a", "_after"))]
    found = links.join(beside[0], "_b", "left").join(beside[1], "_a", "left").select("_part", "_place", "_before", "_after")
    paired = open_rows.join(found, ["_part", "_place"]).select(
        F.when(first, F.col("_before")).otherwise(F.coalesce("_inner", "_before")).alias("_before"), "_own",
        F.when(first, F.col("_inner")).otherwise(F.col("_after")).alias("_after"),
    )
    return staged.where("_part IS NULL").select(*fields).unionByName(paired.mapInArrow(resolve, schema))
