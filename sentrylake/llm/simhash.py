"""SimHash near-duplicates: fingerprints, links by pigeonhole blocks, connected components.

A fingerprint has a bit set where over half of the document's shingle hashes have it. Two fingerprints
that differ in at most ``max_bits`` bits agree on at least ``blocks - max_bits`` of ``blocks`` blocks, so
every such pair meets under the key of some combination of that many blocks; pairs that meet are
verified by their Hamming distance, and a pair is kept only at the first combination on which it agrees.

Equal fingerprints are one node. Keys held by more than ``crowd`` nodes are not paired, which would grow
with the square of the crowd. Their members emit all points within half the distance (Spark generates
them), and those that share a point link to the smallest of its members: two nodes at distance
2r or less share a point within r of both. A point has no more members than there are points around it,
so this stays in proportion to the nodes. Pairs that share only small keys are joined, pairs that share
a crowded key are both in the crowd, so no link is lost.

Defined cases: null or empty text, or text without words, has fingerprint zero and links like any other;
repeated rows and equal texts fall into one component; a null doc_id is never a component's id unless the
component has no other; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .components import components

SEED = 42
CHUNK = 1 << 15  # hashes whose bits are counted at a time


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint as an unsigned number."""
    words = (text or "").encode("utf-8").lower().split()  # ASCII spaces and ASCII case only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, n = (ends - lengths).tolist(), len(words) - shingle + 1
    spans = zip(starts, ends[shingle - 1 :].tolist())
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, shingle: int = 4) -> Column:
    """Fingerprints as bigint (the same 64 bits)."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(blocks: int) -> list[int]:
    """Masks of ``blocks`` neighbouring runs of bits, as even as can be."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(edges, edges[1:])]


def blocks_for(n: int, max_bits: int) -> int:
    """Blocks for ``n`` fingerprints: more of them make longer keys, which few share by chance, but more keys each."""
    for blocks in range(max_bits + 3, 16):
        bits = 64 * (blocks - max_bits) // blocks
        if n <= 1 << max(bits - 2, 0):
            return blocks
    return 16


def links(nodes: DataFrame, max_bits: int = 4, blocks: int = 7, crowd: int = 256) -> DataFrame:
    """(fp) distinct -> (a, b) pairs that differ in ``max_bits`` bits or fewer and connect all such pairs."""
    masks, agree = block_masks(blocks), blocks - max_bits
    if agree < 1:
        raise ValueError("blocks must exceed max_bits")
    sets = list(combinations(range(blocks), agree))
    keyed = nodes.select(
        "fp",
        F.inline(F.array(*[
            F.struct(
                F.lit(sum(1 << i for i in chosen)).alias("set"),
                F.col("fp").bitwiseAND(F.lit(_signed(sum(masks[i] for i in chosen)))).alias("key"),
            )
            for chosen in sets
        ])),
    )
    shared = stage(
        keyed.groupBy("set", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-keys"
    )
    rows = stage(keyed.join(shared, ["set", "key"]), "simhash-rows")
    small = rows.where(F.col("n") <= crowd)
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # the blocks on which both agree, up to the last of this combination, must be the combination itself
    same = sum(
        (F.when(differ.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(masks)),
        F.lit(0),
    )
    below = F.expr(f"(shiftleft(1, length(bin(set))) - 1)")
    left, right = small.select("set", "key", F.col("fp").alias("a")), small.select("set", "key", F.col("fp").alias("b"))
    paired = (
        left.join(right, ["set", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= max_bits) & (same.bitwiseAND(below) == F.col("set")))
        .select("a", "b")
    )
    return paired.union(_crowd_links(rows.where(F.col("n") > crowd).select("fp").distinct(), max_bits))


def _crowd_links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Links to the smallest node around each point.

    A pair within ``max_bits`` has a point within the half (rounded down) of one and the half (rounded
    up) of the other. All members of a point link to its smallest member of the inner ring.
    """
    inner, outer = max_bits // 2, max_bits - max_bits // 2
    flips = [sum(1 << i for i in chosen) for bits in range(outer + 1) for chosen in combinations(range(64), bits)]
    around = nodes.select("fp", F.explode(F.lit(np.array([_signed(x) for x in flips], np.int64))).alias("_flip"))
    around = around.select(
        "fp", F.col("fp").bitwiseXOR(F.col("_flip")).alias("point"), (F.bit_count("_flip") <= inner).alias("_inner")
    )
    smallest = around.where("_inner").groupBy("point").agg(F.min("fp").alias("a"))
    linked = around.join(smallest, "point").where(F.col("a") != F.col("fp"))
    return linked.select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(
    documents: DataFrame, shingle: int = 4, max_bits: int = 4, blocks: int | None = None, crowd: int = 256,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, fp (bigint), component_id, and the columns of ``carry``."""
    prints = documents.select("doc_id", fingerprint_column(F.col("text"), shingle).alias("fp"), *carry)
    return _grouped(stage(prints, "simhash"), max_bits, blocks, crowd)


def _grouped(prints: DataFrame, max_bits: int, blocks: int | None, crowd: int) -> DataFrame:
    """Add component_id to documents with fingerprints. The links are the same for any number of blocks."""
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    blocks = blocks or blocks_for(nodes.count(), max_bits)
    rooted = components(links(nodes.select("fp"), max_bits, blocks, crowd))
    labelled = nodes.join(rooted, F.col("fp") == F.col("node"), "left")
    labelled = stage(labelled.select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    ids = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(labelled.join(ids, "root").select("fp", "component_id"), "fp")


def hex_print(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(
    documents: DataFrame, shingle: int = 4, max_bits: int = 4, blocks: int | None = None, crowd: int = 256
) -> DataFrame:
    """The rows of ``documents``, one of each component: the one with the smallest doc_id.

    Of several rows with that doc_id one stays. All columns are as they were.
    """
    rows = stage(
        documents.select(
            F.struct(*documents.columns).alias("_row"), "doc_id",
            fingerprint_column(F.col("text"), shingle).alias("fp"), F.monotonically_increasing_id().alias("_n"),
        ),
        "simhash-documents",
    )
    grouped = _grouped(rows.select("doc_id", "fp", "_n"), max_bits, blocks, crowd)
    first = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id")
    return rows.join(first.agg(F.min("_n").alias("_n")).select("_n"), "_n").select("_row.*")
