"""Gap-weighted subsequence kernel of order three over short strings, and Nyström maps of it.

The kernel counts the triples of characters that two strings share in order, each weighted by DECAY to the
power of the length it spans in either string, so that gaps and inserted characters weaken a match but do
not end it. It is normalised by the strings' kernels with themselves and raised to POWER, which is
again a kernel. Words begin with START, so that how a word begins counts; they are cut into windows of
WIDTH characters, half overlapping.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from itertools import combinations

import numpy as np

WIDTH, DECAY, POWER = 16, 0.75, 3
CLASSES = 64  # of characters: a-z, 0-9, the start of a word, and 27 that all others share by code point
START = "\N{START OF TEXT}"
_GAP = np.tril(DECAY ** (np.arange(WIDTH)[:, None] - np.arange(WIDTH)[None, :] - 1.0), -1)  # between two places


def encode(text: str) -> np.ndarray:
    """The class of each character."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    out = 36 + code % 27
    out[code == ord(START)] = CLASSES - 1
    for first, last, base in (("a", "z", 0), ("0", "9", 26)):
        own = (code >= ord(first)) & (code <= ord(last))
        out[own] = code[own] - ord(first) + base
    return out


def windows(word: str) -> list[str]:
    """START and the word, in pieces of at most WIDTH characters, every WIDTH / 2 characters a new one."""
    text = START + word
    if len(text) <= WIDTH:
        return [text]
    starts = range(0, len(text) - WIDTH, WIDTH // 2)
    return [text[at : at + WIDTH] for at in starts] + [text[-WIDTH:]]


@cache
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """All i < j < k below ``length``, and DECAY ** (k - i + 1)."""
    at = np.array(list(combinations(range(length), 3)), np.int32).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def triples(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For strings of one length as rows: the number of each triple of characters, and the weights."""
    at, weight = _triples(codes.shape[1])
    return (codes[:, at[:, 0]] * CLASSES + codes[:, at[:, 1]]) * CLASSES + codes[:, at[:, 2]], weight


def with_itself(codes: np.ndarray) -> np.ndarray:
    """Kernel of each string with itself, for strings of one length as rows."""
    length = codes.shape[1]
    gap = _GAP[:length, :length]
    same = (codes[:, :, None] == codes[:, None, :]) * DECAY**2
    sums = same
    for _ in range(2):
        sums = same * (gap @ sums @ gap.T)
    return sums.sum(axis=(1, 2))


def of_length(texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The places of the strings of each length from 3 on, and their codes as rows."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    out = []
    for length in np.unique(lengths[lengths >= 3]):
        at = np.flatnonzero(lengths == length)
        out.append((at, encode("".join([texts[i] for i in at])).reshape(len(at), length)))
    return out


class Landmarks:
    """Normalised triples of a few strings, as a table that is indexed by triple."""

    def __init__(self, texts: Sequence[str]):
        self.texts = list(texts)
        found = {}
        for at, codes in of_length(self.texts):
            numbers, weight = triples(codes)
            norm = np.sqrt(with_itself(codes))
            for row, place in enumerate(at):
                for number, w in zip(numbers[row].tolist(), weight):
                    found[number, int(place)] = found.get((number, int(place)), 0.0) + w / norm[row]
        known = sorted({number for number, _ in found})
        self.row = np.zeros(CLASSES**3, np.int32)  # 0: a triple of no landmark
        self.row[known] = np.arange(1, len(known) + 1)
        self.table = np.zeros((len(known) + 1, len(self.texts)), np.float32)
        for (number, place), w in found.items():
            self.table[self.row[number], place] = w

    def _shared(self, texts: Sequence[str], exact: bool, cells: int = 1 << 20) -> Iterator[tuple]:
        """Strings that share triples with a landmark: their places, and per triple shared the string (as a
        place among these), the row of the table and the weight divided by the string's norm.

        If not ``exact``, by a norm as if no triple occurred twice, which is not greater.
        """
        for at, codes in of_length(texts):
            step = max(1, cells // len(_triples(codes.shape[1])[1]))
            for start in range(0, len(at), step):
                part = codes[start : start + step]
                numbers, weight = triples(part)
                rows = self.row[numbers]
                string, triple = np.nonzero(rows)  # most triples are no landmark's
                if len(string):
                    first = np.flatnonzero(np.diff(string, prepend=-1))
                    own = np.repeat(np.arange(len(first)), np.diff(first, append=len(string)))
                    known = string[first]
                    share = weight[triple] / np.sqrt(with_itself(part[known]))[own] if exact else (weight / np.sqrt((weight**2).sum()))[triple]
                    yield at[start + known], own, rows[string, triple], share.astype(np.float32)

    def kernel(self, texts: Sequence[str]) -> np.ndarray:
        """The kernel of each string (at most WIDTH characters) with each landmark."""
        out = np.zeros((len(texts), len(self.texts)), np.float32)
        for at, own, row, weight in self._shared(texts, exact=True):
            count = np.bincount(own)
            place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            order = np.argsort(place, kind="stable")
            shared = np.zeros((len(at), len(self.texts)), np.float32)
            for now in np.split(order, np.cumsum(np.bincount(place))[:-1]):  # the first triple of each string, the second, ...
                shared[own[now]] += self.table[row[now]] * weight[now, None]
            out[at] = shared**POWER
        return out

    def at_most(self, texts: Sequence[str], weight: np.ndarray) -> np.ndarray:
        """Not less than the weighted sum of each string's kernels, without working these out.

        The sum of w k^POWER over the landmarks of positive weight is at most the greatest k to the power
        POWER - 1 times the sum of w k; both follow from one number per triple.
        """
        gain = np.maximum(weight, 0)
        peak = self.table[:, gain > 0].max(axis=1, initial=0)
        total = self.table @ gain
        out = np.zeros(len(texts))
        for at, own, row, w in self._shared(texts, exact=False):
            most, summed = (np.bincount(own, x[row] * w) for x in (peak, total))
            out[at] = most ** (POWER - 1) * summed * 1.001  # more than rounding takes away
        return out


def apart(texts: Sequence[str], most: int, nearest: float = 0.5) -> list[str]:
    """Up to ``most`` of the strings, in their order, none of them nearer than ``nearest`` to an earlier one."""
    texts = list(texts)
    kernel = Landmarks(texts).kernel(texts) if texts else np.zeros((0, 0))
    chosen: list[int] = []
    for at in range(len(texts)):
        if len(chosen) < most and (not chosen or kernel[at, chosen].max() < nearest):
            chosen.append(at)
    return [texts[at] for at in chosen]
