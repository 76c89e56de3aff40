"""Quality scores: boosted trees over statistics of whole texts.

The statistics are counts and shares of bytes, words and lines; language, source, id and labels are no
inputs. The trees are fitted on the driver, on at most ``sample`` labelled rows (those with the smallest
hash of their id), none of them held out. Every document is then scored in one pass.

Defined cases: null and empty text has all statistics 0 and is scored like any other; a null doc_id counts
as the empty text, is not held out and has no label; documents with contradicting labels have label 1 if at
least half of them say so; null labels are ignored; without labels of both classes the score is a
constant; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .boosted_trees import Trees, fit

SAMPLE = 20_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
_CLASSES = [bytes(range(65, 91)), b"0123456789", b"#*$%&|<>@^~=+_\\/{}[]", b"!", b"?", b".,;:", b"\"'()-", b" \t\n\r\x0b\x0c"]
_OF_CLASS = np.zeros((256, len(_CLASSES)))
for _number, _bytes in enumerate(_CLASSES):
    _OF_CLASS[list(_bytes), _number] = 1
NAMES = [
    "log_words", "word_length", "word_spread", "short_words", "long_words", "different_words", "commonest_word",
    "same_again", "different_pairs", "log_lines", "line_words", "repeated_lines", "closed_lines", "byte_entropy",
    "upper", "digits", "symbols", "exclamations", "questions", "stops", "quotes", "spaces", "beyond_ascii",
]


def statistics(text: str) -> list[float]:
    """The document's statistics, in the order of NAMES."""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    occurs = np.bincount(data, minlength=256)
    shares = occurs[occurs > 0] / len(data)
    pairs = max(1, n - 1)
    return [
        float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), float((lengths <= 3).mean()),
        float((lengths >= 12).mean()), len(counts) / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / pairs,
        len(set(zip(words, words[1:]))) / pairs, float(np.log1p(len(lines))), n / len(lines),
        1 - len(set(lines)) / len(lines), sum(line.rstrip().endswith((".", "!", "?", ":", '"')) for line in lines) / len(lines),
        float(-(shares * np.log2(shares)).sum()), *(occurs @ _OF_CLASS / len(data)).tolist(),
        float(occurs[128:].sum() / len(data)),
    ]


def matrix(texts: Sequence[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], np.float64).reshape(len(texts), len(NAMES))


@F.arrow_udf(ArrayType(DoubleType()))
def statistics_column(texts: pa.Array) -> pa.Array:
    return pa.array(matrix(texts.to_pylist()).tolist(), pa.list_(pa.float64()))


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees from labelled documents that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("_label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "_id")
    # at most ``sample`` rows of two numbers are broadcast; repeated documents do not add to what is collected
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    found = rows.select("doc_id", "_label", statistics_column("text").alias("_x")).limit(sample).toPandas()
    found = found.sort_values("doc_id", kind="stable")
    x = np.array(found["_x"].tolist(), np.float64).reshape(len(found), len(NAMES))
    return fit(x, found["_label"].to_numpy(np.float64))


def score(documents: DataFrame, trees: Trees) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = documents.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf(DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(matrix(texts.to_pylist())), pa.float64())

    return documents.select(
        "doc_id", (remainder(F.col("doc_id")) == HELD_OUT).alias("held_out"), scored("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
