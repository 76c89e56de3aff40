"""BPE encoding and decoding with a lexicon of frequent words and exact merges for the others.

The vocabulary file is one of the public ``tokenizer.json`` kind with NFC and lower case, white space
dropped, byte-level characters and an end-of-word suffix. Spark counts the corpus's words; the most
frequent ones, with their ids, are compiled into a minimal acyclic automaton (``lexicon``) which every
task maps into memory. Words that it does not list are merged by rank. Both ways give the same ids, so
the lexicon is a matter of speed alone.

What reaches the driver is ``size`` words; what is broadcast is the vocabulary file's content and their
automaton, both of a size that does not depend on the corpus.

Defined cases: null and empty text gives no ids, and no ids decode to an empty text; the strings of
special tokens are their ids; repeated rows are encoded each; an empty table gives an empty result; other
columns stay (a column named as the result is replaced).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .lexicon import Lexicon, compile_lexicon
from .quality_rules import bucket

NEVER = 1 << 60  # the rank of a pair that is never joined
TOGETHER = 16 << 20  # code points of texts that are encoded together
DECODED = 512  # lists of ids that are spelled out at a time
MARKS = frozenset(".,;:!?")

# Unicode white space; Python's own notion of it has the separators 0x1C to 0x1F besides.
_SPACE = regex.compile(r"\p{White_Space}+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else the next free from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """What a tokenizer file says, as plain dictionaries."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    pattern: str
    suffix: str
    special: dict[str, int]
    tokens: list[str] = field(default_factory=list)
    name: str = ""  # digest of the file

    @staticmethod
    def load(path: str) -> "Vocabulary":
        with open(path, "rb") as file:
            data = file.read()
        content = json.loads(data)
        model = content["model"]
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        pattern = content["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        own = Vocabulary(model["vocab"], {p: r for r, p in enumerate(pairs)}, pattern.replace(r"\s", r"\p{White_Space}"),
                         model["end_of_word_suffix"] or "", special, name=hashlib.sha256(data).hexdigest())
        own.tokens = [""] * (max([*own.ids.values(), *special.values()]) + 1)
        for token, number in [*own.ids.items(), *special.items()]:
            own.tokens[number] = token
        return own


class Encoder:
    """Words to ids, by the lexicon first."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.pieces = regex.compile(vocabulary.pattern)
        self.characters = byte_characters()
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None

    def merge(self, piece: str) -> list[int]:
        """Join the neighbours of lowest rank, leftmost first, until none can be joined."""
        parts = [self.characters[b] for b in piece.encode("utf-8")]
        parts[-1] += self.vocabulary.suffix
        parts = self._merge_short(parts) if len(parts) <= 64 else self._merge_long(parts)
        return [self.vocabulary.ids[p] for p in parts]

    def _merge_short(self, parts: list[str]) -> list[str]:
        rank = self.vocabulary.ranks.get
        ranks = [rank(pair, NEVER) for pair in zip(parts, parts[1:])]
        while ranks and (lowest := min(ranks)) != NEVER:
            at = ranks.index(lowest)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), NEVER)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), NEVER)
        return parts

    def _merge_long(self, parts: list[str | None]) -> list[str]:
        """The same with a heap, for pieces that are long."""
        ranks = self.vocabulary.ranks
        after, earlier = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(ranks[pair], at) for at, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            following = after[at]
            if parts[at] is None or following >= len(parts) or ranks.get((parts[at], parts[following])) != rank:
                continue
            parts[at] += parts[following]
            parts[following] = None
            after[at] = after[following]
            if after[at] < len(parts):
                earlier[after[at]] = at
            for left, right in ((earlier[at], at), (at, after[at])):
                if left >= 0 and right < len(parts) and (joined := ranks.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (joined, left))
        return [p for p in parts if p is not None]

    def words(self, text: str) -> list[str | int]:
        """Normalized words between white space; special tokens as their ids."""
        if not self.special:
            return self._plain_words(text)
        out, at = [], 0
        for found in self.special.finditer(text):
            out += self._plain_words(text[at : found.start()])
            out.append(self.vocabulary.special[found.group()])
            at = found.end()
        return out + self._plain_words(text[at:] if at else text)

    def _plain_words(self, text: str) -> list[str]:
        if not text:
            return []
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # no final form of sigma
        if _SEPARATORS.search(text):
            return [word for word in _SPACE.split(text) if word]
        return text.split()

    def pieces_of(self, word: str | int) -> list[str | int]:
        """What the word is cut into: itself, or letters and one mark, or what the pattern says."""
        if isinstance(word, int) or word.isalpha():
            return [word]
        if word[-1] in MARKS and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.pieces.findall(word)

    def ids_of_pieces(self, pieces: Sequence[str | int]) -> "Ragged":
        """Ids of the (different) pieces: a place in the lexicon, or merged and put behind it."""
        listed = np.zeros(0, np.int32), np.zeros(1, np.int32)
        ranks = np.full(len(pieces), -1)
        if self.lexicon:
            listed = self.lexicon.ids, self.lexicon.offsets
            ranks = self.lexicon.ranks([b"" if isinstance(p, int) else p.encode("utf-8") for p in pieces])
        known = ranks >= 0
        starts, sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        starts[known] = listed[1][ranks[known]]
        sizes[known] = listed[1][ranks[known] + 1] - starts[known]
        merged = [[p] if isinstance(p, int) else self.merge(p) for p in map(pieces.__getitem__, np.flatnonzero(~known).tolist())]
        lengths = np.fromiter(map(len, merged), np.int64, len(merged))
        starts[~known], sizes[~known] = len(listed[0]) + np.cumsum(lengths) - lengths, lengths
        more = np.fromiter(chain.from_iterable(merged), np.int32, int(lengths.sum()))
        return Ragged(np.concatenate([listed[0], more]), starts, sizes)

    def encode(self, texts: Sequence[str]) -> pa.ListArray:
        """Ids of every text. Each different word and piece of the texts is worked out once."""
        numbers: dict[str | int, int] = {}
        coded = []
        for text in texts:
            words = self.words(text)
            for word in set(words).difference(numbers):
                numbers[word] = len(numbers)
            coded.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        places: dict[str | int, int] = {}
        cut: list[int] = []
        sizes = np.zeros(len(numbers), np.int64)
        for at, word in enumerate(numbers):
            own = self.pieces_of(word)
            sizes[at] = len(own)
            cut += [places.setdefault(piece, len(places)) for piece in own]
        del numbers
        words = Ragged(np.array(cut, np.int64), np.cumsum(sizes) - sizes, sizes)
        pieces = self.ids_of_pieces(list(places))
        lists, ends = [np.zeros(0, np.int32)], [0]
        for codes in coded:
            lists.append(pieces.joined(words.joined(codes)))
            ends.append(ends[-1] + len(lists[-1]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists), pa.int32()))


@dataclass
class Ragged:
    """Runs of values in one array."""

    values: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def joined(self, chosen: np.ndarray) -> np.ndarray:
        """The runs chosen, one after the other."""
        sizes = self.sizes[chosen]
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.values[np.repeat(self.starts[chosen], sizes) + inside]


def frequent_words(documents: DataFrame, size: int) -> pa.Array:
    """The most frequent runs of letters of the whole corpus, in lower case, as sorted UTF-8: ``size`` or fewer.

    The least count is chosen from a histogram of the counts (to 7 bits), so that no more than ``size`` words
    reach the driver, whatever the number of partitions. They come as Arrow batches: rows would take many times
    their size, in the JVM and in Python.
    """
    words = documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = stage(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "word-counts")
    histogram = counts.groupBy(bucket(F.col("n")).alias("n")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, total = None, 0
    for row in sorted(histogram, key=lambda r: -r["n"]):
        total += row["words"]
        if total > size:
            break
        least = row["n"]
    if not least:
        return pa.array([], pa.binary())
    listed = counts.where(F.col("n") >= least).select(F.col("word").cast("binary")).toArrow()["word"].combine_chunks()
    return listed.take(pc.array_sort_indices(listed))


def build_lexicon(documents: DataFrame, vocabulary: Vocabulary, size: int = 1 << 18) -> bytes:
    """The compiled lexicon of the corpus's frequent words, which are spelled out and merged one at a time."""
    exact = Encoder(vocabulary)
    listed = frequent_words(documents, size)
    return compile_lexicon((word.as_py() for word in listed), (exact.merge(word.as_py().decode()) for word in listed))


_encoders: dict[tuple[str, str], Encoder] = {}  # of this process; the last one used


def _encoder(name: tuple[str, str], shared: Broadcast) -> Encoder:
    """The encoder of this process, made once. (A function of the module: what a task brings along is its own.)"""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(shared.value[0], Lexicon.mapped(shared.value[1]))
    return _encoders[name]


def _encoded(texts: pa.Array, encoder: Encoder) -> pa.ListArray:
    lengths = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    parts, start = [], 0
    while start < len(texts):
        done = lengths[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(lengths, done + TOGETHER, side="right")))
        parts.append(encoder.encode([t or "" for t in texts.slice(start, stop - start).to_pylist()]))
        start = stop
    return pa.concat_arrays([*parts, pa.array([], pa.list_(pa.int32()))])


def _decoded(lists: pa.ListArray, tokens: list[str]) -> pa.Array:
    spellings, parts = pa.array(tokens, pa.string()), [pa.array([], pa.string())]
    lists = pc.fill_null(lists, pa.scalar([], lists.type))
    for start in range(0, len(lists), DECODED):
        own = lists.slice(start, DECODED)
        spelled = pa.ListArray.from_arrays(pc.subtract(own.offsets, own.offsets[0]), spellings.take(own.flatten()))
        parts.append(pc.binary_join(spelled, " "))
    return pa.concat_arrays(parts)


def _shared(documents: DataFrame, vocabulary: Vocabulary, lexicon: bytes) -> tuple[Broadcast, tuple[str, str]]:
    shared = documents.sparkSession.sparkContext.broadcast((vocabulary, lexicon))
    return shared, (vocabulary.name, hashlib.sha256(lexicon).hexdigest())


def encode(documents: DataFrame, vocabulary: Vocabulary, lexicon: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of ``text``."""
    shared, name = _shared(documents, vocabulary, lexicon)

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        return _encoded(texts, _encoder(name, shared))

    return documents.withColumn(ids, encoded(F.col(text)))


def decode(documents: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of the ids: the tokens, with their end-of-word marks, joined by spaces."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary.tokens)

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        return _decoded(lists, shared.value)

    return documents.withColumn(text, decoded(F.col(ids)))


def round_trip(
    documents: DataFrame, vocabulary: Vocabulary, lexicon: bytes, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``encode`` and ``decode`` one after the other in the same task, so that the ids go to Python once."""
    shared, name = _shared(documents, vocabulary, lexicon)

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(texts: pa.Array) -> pa.Array:
        encoder = _encoder(name, shared)
        lists = _encoded(texts, encoder)
        return pa.StructArray.from_arrays([lists, _decoded(lists, encoder.vocabulary.tokens)], ["ids", "decoded"])

    rows = documents.withColumn("_both", both(F.col(text)))
    return rows.withColumns({ids: F.col("_both.ids"), decoded: F.col("_both.decoded")}).drop("_both")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
