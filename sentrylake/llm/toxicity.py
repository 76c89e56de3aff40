"""Toxicity of texts by a subsequence-kernel support vector machine over Nyström landmarks.

A text is a set of sentences, a sentence a set of words, and a run of letters set apart is one more word. A
word's features are its kernel with each landmark (``subsequences``), mapped so that their inner products
approximate the kernel. The machine is trained on labelled sentences: a sentence has its document's label,
and of the sentences of a toxic document only those stay positive that hold words about as bad as its worst;
the machine then judges the words anew, a few times. A sentence scores as its worst word, a document as its worst sentence.
Decision values below half that of an empty text are not told apart, so that most words need only a bound.

Fitting uses at most ``sample`` labelled documents (those with the smallest hash of their id), none of them held
out. Spark counts their words; what reaches the driver is bounded by CANDIDATES, CLOSE, USUAL, SENTENCES and ``sample``.
Every document is scored over its whole text.

Defined cases: null and empty texts, and words without a landmark's triples, score as the
floor; a null doc_id counts as the empty text, is not held out and has no label; documents with contradicting labels
are toxic if at least half of them say so; null labels are ignored; without labels of both classes the
score is a constant; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from ..session import stage
from .subsequences import Landmarks, apart, windows

SAMPLE = 20_000
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
CANDIDATES, CLOSE, USUAL = 1_000, 4_000, 8_000  # words of toxic, of clean sentences near them, and others
SENTENCES = 60_000  # of toxic documents
TOXIC_MARKS, CLEAN_MARKS = 48, 48  # landmarks
ROUNDS = 4
REMEMBERED = 500_000  # words that a Python worker knows, some 100 bytes each
GROUP = 20_000  # new words that are worked out together
_OTHER = re.compile(r"[\W_]+")
_END = re.compile(r"[.!?\n]+(?=\s|$)")


def bare(token: str) -> str:
    """The token's letters and digits."""
    return token if token.isalnum() else _OTHER.sub("", token)


def spelled(tokens: Sequence[str]) -> list[str]:
    """Runs of at least three tokens of one letter, each as one word."""
    out, run, last = [], [], -1
    for at in (i for i, t in enumerate(tokens) if len(t) <= 2):
        letter = bare(tokens[at])
        if len(letter) != 1:
            continue
        if at != last + 1:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
        run.append(letter)
        last = at
    return out + ["".join(run)] if len(run) >= 3 else out


def words(text: str) -> set[str]:
    tokens = text.lower().split()
    own = set(tokens)
    if any(len(bare(token)) == 1 for token in own if len(token) <= 2):
        own.update(spelled(tokens))
    return own


def pieces(word: str) -> list[str]:
    return windows(bare(word))


@dataclass
class Machine:
    """Landmarks, a weight for each, a constant, and the slope and offset that make scores chances."""

    marks: Landmarks
    weight: np.ndarray
    constant: float
    slope: float = 1.0
    offset: float = 0.0
    known: dict[str, float] = field(default_factory=dict)  # decision values of words seen lately

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    @property
    def floor(self) -> float:
        """Half the constant: all that is cleaner has this decision value."""
        return max(self.constant, self.constant / 2)

    def margins(self, texts: Sequence[str]) -> np.ndarray:
        """Decision value of each piece of at most WIDTH characters; where a bound is not above the floor, the floor."""
        out = np.full(len(texts), self.floor)
        doubtful = np.flatnonzero(self.marks.at_most(texts, self.weight) + self.constant > self.floor)
        exact = self.marks.kernel([texts[at] for at in doubtful]) @ self.weight + self.constant
        out[doubtful] = np.maximum(exact, self.floor)
        return out

    def learn(self, new: Sequence[str]) -> None:
        """Work out the worst piece of each new word."""
        cut = [pieces(word) for word in new]
        found = self.margins([p for group in cut for p in group])
        ends = np.cumsum([0, *map(len, cut)])[:-1]
        self.known.update(zip(new, np.maximum.reduceat(found, ends).tolist() if len(new) else []))

    def worst(self, texts: Sequence[str | None]) -> np.ndarray:
        """Decision value of each text: that of its worst word, or the floor."""
        out = np.full(len(texts), self.floor)
        held: list[tuple[int, set[str]]] = []
        new: set[str] = set()

        def settle() -> None:
            self.learn(sorted(new))
            for at, own in held:
                out[at] = max(map(self.known.__getitem__, own))
            held.clear()
            new.clear()
            if len(self.known) > REMEMBERED:
                self.known.clear()

        for at, text in enumerate(texts):
            if own := words(text or ""):
                held.append((at, own))
                new.update(own.difference(self.known))
                if len(new) > GROUP:
                    settle()
        settle()
        return out

    def chances(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -500, 500)))


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def sentences(text: str) -> list[str]:
    return [s for s in _END.split(text) if s and not s.isspace()]


def _sentence_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, toxic, sentence, piece) of every labelled sentence, each piece once in it."""
    schema = pa.schema([("doc", pa.int64()), ("toxic", pa.bool_()), ("sentence", pa.int32()), ("piece", pa.string())])
    columns: list[list] = [[], [], [], []]
    for batch in batches:
        for doc, toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
            for at, sentence in enumerate(sentences(text or "")):
                found = sorted({p for word in words(sentence) for p in pieces(word) if len(p) > 3})
                for column, values in zip(columns, ([doc] * len(found), [toxic] * len(found), [at] * len(found), found)):
                    column += values
            if len(columns[0]) > GROUP:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
                columns = [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _newton(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights of the squared-hinge machine: 0.5 w'ridge w + sum of cost x max(0, 1 - y x w)^2."""
    w = np.zeros(x.shape[1])
    before = None
    for _ in range(steps):
        short = y * (x @ w) < 1
        if before is not None and (short == before).all():
            break
        before, xs = short, x[short] * cost[short, None]
        w = np.linalg.solve(ridge + 2 * xs.T @ x[short], 2 * xs.T @ y[short])
    return w


def with_one_more(word: str) -> list[str]:
    """The word with one character put in at each place inside it: one of its own, or one of a few others."""
    places = range(2, len(word))
    return [word[:at] + more + word[at:] for at in places for more in dict.fromkeys((word[at - 1], "x", "0"))]


def fit_machine(marks: Landmarks, clean: Sequence[str], said: Sequence[tuple[int, Sequence[tuple[str, float]]]]) -> Machine:
    """A machine from words of clean sentences and from sentences of toxic documents.

    ``said`` has, for each such sentence, its document and its words that are commoner in toxic documents, with
    their excess there. A sentence counts as toxic for the words in it that are at least half as bad as the worst of
    its document: first by excess, then by the machine. Each document has the weight of one clean word in all.
    """
    toxic = sorted({word for _, own in said for word, _ in own})
    base = marks.kernel(marks.texts).astype(np.float64)
    values, vectors = np.linalg.eigh((base + base.T) / 2)
    kept = values > 1e-6
    inverse = vectors[:, kept] / np.sqrt(values[kept])  # Nyström: features are kernel values times this
    features = [np.c_[marks.kernel(texts) @ inverse, np.ones(len(texts))] for texts in (toxic, list(clean))]
    place = {word: i for i, word in enumerate(toxic)}
    docs = np.unique([d for d, _ in said], return_inverse=True)[1]
    doc = np.repeat(docs, [len(own) for _, own in said])
    spoken = np.array([place[word] for _, own in said for word, _ in own])
    bad = np.array([excess for _, own in said for _, excess in own])
    ridge = np.eye(features[1].shape[1])
    ridge[-1, -1] = 1e-3
    weight = np.zeros(len(ridge))
    for _ in range(ROUNDS):
        worst = np.full(doc.max() + 1, -np.inf)
        np.maximum.at(worst, doc, bad)
        positive = bad >= np.where(worst > 0, worst / 2, worst)[doc]
        share = 1 / np.bincount(doc[positive], minlength=len(worst))[doc[positive]]
        cost = np.bincount(spoken[positive], share, len(toxic))
        chosen = np.flatnonzero(cost)
        rows = np.r_[features[0][chosen], features[1]]
        weight = _newton(
            rows, np.r_[np.ones(len(chosen)), -np.ones(len(features[1]))], np.r_[cost[chosen], np.ones(len(features[1]))], ridge
        )
        found = features[0] @ weight
        bad = found[spoken]
    # insults with one more character are insults too
    spread = [v for word in (toxic[w] for w in chosen if found[w] > 0.5) for v in with_one_more(word)]
    if spread:
        more = np.c_[marks.kernel(spread) @ inverse, np.ones(len(spread))]
        each = cost.sum() / 2 / len(spread)
        weight = _newton(
            np.r_[rows, more], np.r_[np.ones(len(chosen)), -np.ones(len(features[1])), np.ones(len(spread))],
            np.r_[cost[chosen], np.ones(len(features[1])), np.full(len(spread), each)], ridge,
        )
    return Machine(marks, inverse @ weight[:-1], float(weight[-1]))


def _chance(margins: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (margin, label), with Platt's smoothed targets."""
    high, low = (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2)
    goal = np.where(toxic, high, low)
    x, w = np.c_[margins, np.ones(len(margins))], np.zeros(2)
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (chance * (1 - chance))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (goal - chance))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("_toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "_id")
    # at most ``sample`` rows of two values are broadcast
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = stage(rows.select(F.col("_id").cast("long").alias("doc"), F.col("_toxic").alias("toxic"), "text"), "toxicity-sample")
    sizes = rows.agg(F.count_distinct(F.when(F.col("toxic"), F.col("doc"))), F.count_distinct(F.when(~F.col("toxic"), F.col("doc")))).first()
    if not sizes[0] or not sizes[1]:
        share = (sizes[0] + 0.5) / (sizes[0] + sizes[1] + 1)
        return Machine(Landmarks([]), np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    said = stage(rows.mapInArrow(_sentence_pieces, "doc long, toxic boolean, sentence int, piece string"), "toxicity-words")
    per = said.groupBy("piece").agg(
        F.count_distinct(F.when(F.col("toxic"), F.col("doc"))).alias("of_toxic"),
        F.count_distinct(F.when(~F.col("toxic"), F.col("doc"))).alias("of_clean"),
    )
    per = stage(per, "toxicity-counts")
    share = (F.col("of_toxic") + F.col("of_clean")) / float(sizes[0] + sizes[1])
    excess = (F.col("of_toxic") - share * sizes[0]) / F.sqrt(share * sizes[0] + 1e-9)
    telling = per.where("of_toxic >= 2 AND of_toxic > of_clean").select("piece", excess.alias("excess"))
    telling = telling.orderBy(F.col("excess").desc(), "piece").limit(CANDIDATES).toPandas()
    suspects = apart(telling["piece"], TOXIC_MARKS)
    shared = documents.sparkSession.sparkContext.broadcast(Landmarks(suspects))

    @F.arrow_udf(DoubleType())
    def nearest(texts: pa.Array) -> pa.Array:
        found = shared.value.kernel(texts.to_pylist())
        return pa.array(found.max(axis=1, initial=0).astype(np.float64), pa.float64())

    harmless = per.where("of_clean > 0").select("piece", nearest("piece").alias("near"))
    close = [r[0] for r in harmless.orderBy(F.col("near").desc(), "piece").limit(CLOSE).collect()]
    usual = [r[0] for r in harmless.select("piece").orderBy(F.xxhash64("piece"), "piece").limit(USUAL).collect()]
    clean = list(dict.fromkeys(close + usual))
    marks = Landmarks(list(dict.fromkeys(suspects + apart(close[:CANDIDATES], CLEAN_MARKS))))
    listed = documents.sparkSession.createDataFrame(telling, "piece string, excess double")  # at most CANDIDATES rows
    own = F.collect_set(F.struct("piece", "excess")).alias("own")
    found = said.where("toxic").join(F.broadcast(listed), "piece").groupBy("doc", "sentence").agg(own)
    found = found.orderBy(F.xxhash64("doc", "sentence"), "doc", "sentence").limit(SENTENCES).collect()
    machine = fit_machine(marks, clean, [(r["doc"], sorted((w["piece"], w["excess"]) for w in r["own"])) for r in found])
    points = rows.select("toxic", margin_column(rows, machine).alias("m")).orderBy(F.xxhash64("doc"), "doc").limit(sample).toPandas()
    machine.slope, machine.offset = _chance(points["m"].to_numpy(np.float64), points["toxic"].to_numpy(bool))
    return machine


def margin_column(documents: DataFrame, machine: Machine) -> Column:
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf(DoubleType())
    def margins(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.worst(texts.to_pylist()), pa.float64())

    return margins("text")


def score(documents: DataFrame, machine: Machine) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf(DoubleType())
    def chances(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.chances(shared.value.worst(texts.to_pylist())), pa.float64())

    return documents.select(
        "doc_id", (remainder(F.col("doc_id")) == HELD_OUT).alias("held_out"), chances("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
