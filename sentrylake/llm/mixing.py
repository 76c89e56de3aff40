"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Sizes are words. The targets of the sources share all words by weight; a target stops at ``cap``
times its source's size and the excess is shared again. Within a source every document has the same
expected number of copies (target / size of the source); their prefix sums, plus one offset of the
source, cross whole numbers, and each crossing emits the document once. Documents are taken in order
of size, so the words taken miss the target by at most the source's largest document.

Defined cases: null or empty text has size 0; null sources are one source, sorted last; a source
without words has target 0 and none of its documents is taken; repeated rows are documents of their
own; an empty table gives an empty mix; other columns are carried along and never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .common import WORD, position_in_group

OFFSET_STEPS = 1024  # an offset is k / 1024: exact in a double up to 2**43 copies


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size) -> the same with ``weight`` and ``target``.

    Weights repeat along the sources in code point order. Each round of resharing is one aggregate
    of the source table; only its two sums reach the driver.
    """
    ordered = position_in_group(sizes, [], [F.col("source").asc_nulls_last()], "mix-sources")
    which = F.pmod(F.col("place") - 1, F.lit(len(weights)))
    weighted = ordered.withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (which + 1).cast("int"))
    )
    limit = F.col("source_size") * cap
    level, total = 0.0, None
    while True:
        free = limit.cast("double") > F.col("weight") * F.lit(level)
        words, spare, share = weighted.agg(
            F.sum("source_size"), F.sum(F.when(~free, limit).otherwise(0)), F.sum(F.when(free, F.col("weight")))
        ).first()
        total = words or 0
        raised = (total - (spare or 0)) / share if share else level
        if raised <= level:
            break
        level = raised
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(level))
    return weighted.select("source", "source_size", "weight", target.alias("target"))


def offset(source: Column, seed: str) -> Column:
    """The random offset of a source, in [0, 1): the same in every run with this seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\n"))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(OFFSET_STEPS)) / F.lit(OFFSET_STEPS)


def mix(
    documents: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix",
    carry: Sequence[Column] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, and the columns of ``carry``."""
    sized = documents.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie"), *carry
    )
    if not carry:
        sized = stage(sized, "mix-sizes")  # ranges are sampled first: texts are counted once for both
    placed = position_in_group(
        sized, ["source"], [F.col("size").desc(), F.col("doc_id").asc_nulls_last(), F.col("_tie")], "mix"
    )
    targets = stage(
        source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix-targets"
    ).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rate, start = F.least(rate, F.lit(float(cap))), offset(F.col("source"), seed)
    copies = F.floor(F.col("place") * rate + start) - F.floor((F.col("place") - 1) * rate + start)
    return (
        placed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("copies", copies.cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_tie", "_source", "place", "weight")
    )


def mixed_rows(documents: DataFrame, **settings) -> DataFrame:
    """The mix itself: the rows of ``documents``, each as many times as it has copies."""
    chosen = mix(documents, carry=[F.struct(*documents.columns).alias("_row")], **settings)
    repeated = chosen.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("_row.*")
