"""A word list as a minimal acyclic automaton in flat arrays, each word leading to its list of ids.

Words that end alike share the states of their endings. A word's number is its rank in the sorted list:
every arc carries how many words are accepted before it, and the sums along a path give the rank
(Lucchesi and Kowaltowski 1993); the rank leads to the word's ids. All arrays lie in one block of
int32, so that a process can map the block from a file and look up a whole batch of words with numpy, one
step per byte.
"""

from __future__ import annotations

import hashlib
import mmap
import tempfile
from array import array
from collections.abc import Iterable, Sequence

import numpy as np

_open: dict[str, "Lexicon"] = {}


def compile_lexicon(words: Iterable[bytes], ids: Iterable[Sequence[int]]) -> bytes:
    """The block for different, sorted, non-empty words and their ids.

    Both are read once, in step, and may be generators; a state is kept as flat numbers only.
    """
    register: dict[bytes, int] = {}
    final, accepted = array("i"), array("i")  # accepted: words from each state on
    keys, targets, skips = array("i"), array("i"), array("i")
    offsets, listed = array("i", [0]), array("i")

    def frozen(ends: bool, arcs: list[int]) -> int:
        """The number of the state with these arcs (byte, target, byte, target, ...), the same for equal states."""
        state = array("i", [ends, *arcs]).tobytes()
        number = register.setdefault(state, len(final))
        if number == len(final):
            total = int(ends)
            for byte, target in zip(arcs[::2], arcs[1::2]):
                keys.append(number << 8 | byte)
                targets.append(target)
                skips.append(total)
                total += accepted[target]  # targets have smaller numbers
            final.append(ends)
            accepted.append(total)
        return number

    # the path of the last word, as states still open: [final, arcs, byte that leads to the next]
    path: list[list] = [[False, [], 0]]
    before = b""

    def close(depth: int) -> None:
        while len(path) > depth:
            ends, arcs, _ = path.pop()
            path[-1][1] += path[-1][2], frozen(ends, arcs)

    for word, own in zip(words, ids, strict=True):
        common = 0
        while common < min(len(word), len(before)) and word[common] == before[common]:
            common += 1
        close(common + 1)
        for byte in word[common:]:
            path[-1][2] = byte
            path.append([False, [], 0])
        path[-1][0] = True
        before = word
        listed.extend(own)
        offsets.append(len(listed))
    close(1)
    root = frozen(False, path[0][1])
    parts = [keys, targets, skips, final, offsets, listed]
    return b"".join([array("i", [root, *map(len, parts)]).tobytes(), *(part.tobytes() for part in parts)])


class Lexicon:
    """A compiled block, mapped into memory."""

    def __init__(self, block) -> None:
        data = np.frombuffer(block, np.int32)
        self.root, edges = int(data[0]), np.cumsum([7, *data[1:7].tolist()])
        self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = (
            data[a:b] for a, b in zip(edges, edges[1:])
        )

    @staticmethod
    def mapped(block: bytes) -> "Lexicon":
        """The block through an unnamed file of this process, mapped once however often it is asked for."""
        name = hashlib.sha256(block).hexdigest()
        if name not in _open:
            with tempfile.TemporaryFile() as file:
                file.write(block)
                file.flush()
                _open.clear()
                _open[name] = Lexicon(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
        return _open[name]

    def ranks(self, words: Sequence[bytes]) -> np.ndarray:
        """Rank of each word, -1 for words that are not listed."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state, rank = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        alive = np.flatnonzero(lengths > 0) if len(self.keys) else np.zeros(0, np.int64)
        rank[lengths == 0] = -1
        if not len(self.keys):
            rank[:] = -1
        step = 0
        while len(alive):
            wanted = state[alive] << 8 | text[starts[alive] + step]
            arc = np.searchsorted(self.keys, wanted)
            arc[arc == len(self.keys)] = 0
            found = self.keys[arc] == wanted
            rank[alive[~found]] = -1
            alive, arc = alive[found], arc[found]
            state[alive] = self.targets[arc]
            rank[alive] += self.skips[arc]
            step += 1
            done = lengths[alive] == step
            ended = alive[done]
            rank[ended[self.final[state[ended]] == 0]] = -1
            alive = alive[~done]
        return rank

    def ids_of(self, rank: int) -> list[int]:
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].tolist()
