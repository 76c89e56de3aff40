"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: lines, their sentences, and those of LONG code points or more at words
that the words themselves decide, so that a change of one place leaves the others alone. Each
paragraph, with its number among equal ones, is a 64-bit digest. A sketch has three rows of ``width``
cells; a digest adds itself, 1 and a checksum to one cell of each row. Two sketches subtract cell by cell, what both texts hold cancels, and peeling cells that hold
a single digest recovers the digests on either side. If cells are left, both sketches are built again
at twice the width until the peeling succeeds.

All texts of a batch are sketched and peeled together with numpy.

Defined cases: null text is empty; a text without paragraphs has an empty sketch, and two such are alike
to degree 1; equal texts have equal sketches; repeated rows are fingerprinted each; other columns are
never read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .neighbours import with_neighbours

ROWS, WIDTH = 3, 8
LONG = 48  # code points of a paragraph from which it is cut further
_PARAGRAPH = re.compile(r"[^\n.!?]+[.!?]*")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def paragraphs(text: str) -> list[str]:
    pieces = []
    for piece in _PARAGRAPH.findall(text):
        piece = piece.strip()
        if len(piece) < LONG:
            if piece:
                pieces.append(piece)
            continue
        run: list[str] = []
        for word in piece.split():
            run.append(word)
            if zlib.crc32(word.encode("utf-8")) & 3 == 0:
                pieces.append(" ".join(run))
                run = []
        if run:
            pieces.append(" ".join(run))
    return pieces


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """A well mixed function of 64-bit numbers."""
    x = values + np.uint64(int(_ODD) * (salt + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


@dataclass
class Sets:
    """Digests of several texts, one after the other."""

    digests: np.ndarray
    sizes: np.ndarray

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def take(self, chosen: np.ndarray) -> "Sets":
        starts, sizes = (np.cumsum(self.sizes) - self.sizes)[chosen], self.sizes[chosen]
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return Sets(self.digests[np.repeat(starts, sizes) + inside], sizes)


def digests(texts: Sequence[str]) -> Sets:
    """Paragraph digests of each text; the k-th of equal paragraphs has a digest of its own."""
    found = [[xxhash.xxh64_intdigest(p) for p in paragraphs(t)] for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    values = np.fromiter((d for own in found for d in own), np.uint64, int(sizes.sum()))
    if len(values):
        owners = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((values, owners))
        v, o, at = values[order], owners[order], np.arange(len(values))
        begins = np.r_[True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])]
        again = at - np.maximum.accumulate(np.where(begins, at, 0))
        repeated = again > 0
        v[repeated] = _mixed(v[repeated] + again[repeated].astype(np.uint64) * _ODD, 7)
        values[order] = v
    return Sets(values, sizes)


@dataclass
class Sketches:
    """Cells of several texts: shape (texts, ROWS * width)."""

    count: np.ndarray
    key: np.ndarray
    check: np.ndarray
    width: int

    def __sub__(self, other: "Sketches") -> "Sketches":
        return Sketches(self.count - other.count, self.key - other.key, self.check - other.check, self.width)

    def add(self, owners: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        count, key, check = self.count.reshape(-1), self.key.reshape(-1), self.check.reshape(-1)
        signed, checks = sign.astype(np.uint64), _mixed(keys, ROWS)
        for row in range(ROWS):
            cell = owners * (ROWS * self.width) + row * self.width + (
                _mixed(keys, row) % np.uint64(self.width)
            ).astype(np.int64)
            np.add.at(count, cell, sign)
            np.add.at(key, cell, keys * signed)
            np.add.at(check, cell, checks * signed)


def sketch(sets: Sets, width: int) -> Sketches:
    shape = (len(sets.sizes), ROWS * width)
    cells = Sketches(np.zeros(shape, np.int64), np.zeros(shape, np.uint64), np.zeros(shape, np.uint64), width)
    cells.add(sets.owners(), sets.digests, np.ones(len(sets.digests), np.int64))
    return cells


def peel(cells: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Recovered (owner, digest, side) and, per text, whether everything was recovered. Empties ``cells``."""
    per_text = cells.count.shape[1]
    count, key, check = cells.count.reshape(-1), cells.key.reshape(-1), cells.check.reshape(-1)
    looked = np.flatnonzero(np.abs(count) == 1)
    owners, keys, sides = [], [], []
    while len(looked):
        side = count[looked]
        value = key[looked] * side.astype(np.uint64)
        single = (np.abs(side) == 1) & (check[looked] == _mixed(value, ROWS) * side.astype(np.uint64))
        owner, value, side = looked[single] // per_text, value[single], side[single]
        if not len(value):
            break
        order = np.lexsort((value, owner))
        owner, value, side = owner[order], value[order], side[order]
        new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
        owner, value, side = owner[new], value[new], side[new]
        cells.add(owner, value, -side)
        owners.append(owner), keys.append(value), sides.append(side)
        looked = np.flatnonzero(np.abs(count) == 1)
    empty = ~(cells.count.any(axis=1) | cells.key.any(axis=1) | cells.check.any(axis=1))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), empty
    return np.concatenate(owners), np.concatenate(keys), np.concatenate(sides), empty


def differences(
    left: Sets, right: Sets, width: int = WIDTH, built: tuple[Sketches, Sketches] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, digest, 1 if only on the left or -1) for all paragraphs that differ.

    ``built`` are the sketches of that width, where there are some already.
    """
    todo, out = np.arange(len(left.sizes)), []
    first = built or (sketch(left, width), sketch(right, width))
    while len(todo):
        if built is None and out:
            first = sketch(left.take(todo), width), sketch(right.take(todo), width)
        owner, key, side, done = peel(first[0] - first[1])
        whole = done[owner]
        out.append((todo[owner[whole]], key[whole], side[whole]))
        todo, width, built = todo[~done], width * 2, None
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))


def likeness(left: Sets, right: Sets, built: tuple[Sketches, Sketches] | None = None) -> np.ndarray:
    """Shared paragraphs as a share of all, from the paragraphs that differ."""
    owner, _, _ = differences(left, right, built[0].width if built else WIDTH, built)
    apart = np.bincount(owner, minlength=len(left.sizes))
    shared = (left.sizes + right.sizes - apart) / 2
    everything = shared + apart
    return np.where(everything > 0, shared / np.maximum(everything, 1), 1.0)


def written(cells: Sketches) -> list[bytes]:
    """Each text's sketch as counts (32 bits), digest sums (64) and checksums (32), low bits first."""
    parts = (cells.count.astype("<i4"), cells.key.astype("<u8"), cells.check.astype("<u4"))
    return [b"".join(p[i].tobytes() for p in parts) for i in range(len(cells.count))]


RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the beginning of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compare(rows: pa.RecordBatch, start: int, stop: int) -> pa.RecordBatch:
    count = stop - start
    texts = [t or "" for t in rows.column(1).slice(start, count + 1).to_pylist()]
    if count and len(texts) == count:
        texts.append(texts[-1])  # a single document follows itself
    changed = [edited(a, b) for a, b in zip(texts[:count], texts[1:])]
    every, after = digests(texts), digests(changed)
    own = every.take(np.arange(count))
    cells, changed_cells = sketch(every, WIDTH), sketch(after, WIDTH)
    own_cells, next_cells = (Sketches(cells.count[s], cells.key[s], cells.check[s], WIDTH)
                             for s in (slice(0, count), slice(1, count + 1)))
    following = every.take(np.arange(1, count + 1)) if count else own
    return pa.RecordBatch.from_arrays(
        [
            rows.column(0).slice(start, count),
            pa.array([len(t) for t in texts[:count]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8")).digest() for t in changed], pa.binary()),
            pa.array(written(own_cells), pa.binary()), pa.array(written(changed_cells), pa.binary()),
            pa.array(likeness(own, after, (own_cells, changed_cells)), pa.float64()),
            pa.array(likeness(own, following, (own_cells, next_cells)), pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def fingerprints(documents: DataFrame) -> DataFrame:
    """Every document against its edited text and the next one in descending doc_id (nulls last, equal ones by text hash)."""
    rows = documents.select(F.col("doc_id").cast("bigint"), "text")
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]  # keys are sampled: no text among them
    found = with_neighbours(rows, order, _compare, RESULT, wrap=True, name="fingerprints")
    return found.withColumns({
        "edited_sha256": F.lower(F.hex("edited_sha256")), "fingerprint": F.base64("fingerprint"),
        "edited_fingerprint": F.base64("edited_fingerprint"),
    })
