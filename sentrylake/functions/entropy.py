"""Shannon entropy of characters, as Arrow batch functions.

Measured against sorted runs in built-in functions (one task each): about five times faster on long
texts and twice on command lines, because it counts the code points of a whole batch in one pass.
It needs no shuffle, unlike explode and group, and sees whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

CELLS = 1_000_000
TOGETHER = 4_000_000  # code points that are counted in one go, four bytes each


def _entropies(texts: pa.Array) -> np.ndarray:
    """Entropy in bits of each text; empty gives 0. Long texts are taken a few at a time."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, parts, start = np.cumsum(lengths), [], 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + TOGETHER, side="right")))
        parts.append(_counted(texts.slice(start, stop - start), lengths[start:stop]))
        start = stop
    return np.concatenate(parts) if parts else np.zeros(0)


def _counted(texts: pa.Array, lengths: np.ndarray) -> np.ndarray:
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    result = np.zeros(len(lengths))
    if not len(codes):
        return result
    present = np.zeros(int(codes.max()) + 1, dtype=bool)
    present[codes] = True
    kinds = int(present.sum())
    kind = (np.cumsum(present) - 1)[codes]
    ends = np.cumsum(lengths)
    step = max(1, CELLS // kinds)
    for low in range(0, len(lengths), step):
        n = lengths[low : low + step]
        chars = kind[ends[low] - n[0] : ends[low + len(n) - 1]]
        cells = np.repeat(np.arange(len(n)) * kinds, n) + chars
        counts = np.bincount(cells, minlength=len(n) * kinds).reshape(len(n), kinds)
        weighted = (counts * np.log2(np.maximum(counts, 1))).sum(axis=1)
        safe = np.maximum(n, 1)
        result[low : low + step] = np.where(n > 0, np.log2(safe) - weighted / safe, 0.0)
    return result


def _by_distinct(texts: pa.Array) -> np.ndarray:
    """Entropy of each text, computed once per distinct text of the batch; null counts as empty."""
    encoded = pc.dictionary_encode(pc.fill_null(texts, ""))
    return _entropies(encoded.dictionary)[encoded.indices.to_numpy(zero_copy_only=False)]


def char_entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; null and empty text give 0."""

    @F.arrow_udf("double")
    def evaluate(texts: pa.Array) -> pa.Array:
        return pa.array(_by_distinct(texts), pa.float64())

    return evaluate(text)


def mean_token_entropy(tokens: Column) -> Column:
    """Mean character entropy over the non-empty tokens of an array; 0 if there is none."""

    @F.arrow_udf("double")
    def evaluate(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        values = _by_distinct(flat)
        kept = pc.fill_null(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False) > 0
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists)), sizes)
        total = np.bincount(row, weights=values * kept, minlength=len(lists))
        number = np.bincount(row, weights=kept, minlength=len(lists))
        return pa.array(np.where(number > 0, total / np.maximum(number, 1), 0.0), pa.float64())

    return evaluate(tokens)
