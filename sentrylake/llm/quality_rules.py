"""Quality rules with thresholds that adapt to language and source (DataFrame functions only).

Each document is measured once. Rates are bucketed on a log-linear scale (the top ``SKETCH_BITS`` bits
of the number), and the counts per language, source, rate and bucket are the quantile sketch: counts
of parts add up to the counts of the whole, in any order, and a quantile read from them is low by less
than 1 part in 2 ** (SKETCH_BITS - 1). Sketches of sources merge into sketches of languages and of everything,
which serve groups with fewer than ``min_docs`` documents. A document is rejected if a rate lies
beyond its group's fence, ``reach`` interquartile ranges above the upper (or below the lower)
quartile; the thresholds come to the documents by an equi-join.

Defined cases: null or empty text has no words and fails the base rules; null languages and sources
are groups of their own; repeated rows are measured each on its own; an empty table gives an empty
result; other columns are carried along and never read. Windows of three words are compared by 64-bit
hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .common import WORD, let

SKETCH_BITS = 7
# rate: (numerator, factor, denominator, smallest interquartile range, two-sided)
RATES = {
    "symbols": ("n_symbols", 10_000, "n_words", 300, False),
    "repeated": ("n_repeat_words", 10_000, "n_words", 1_200, False),
    "dup_lines": ("n_dup_lines", 10_000, "n_lines", 2_000, False),
    "word_length": ("word_chars", 1_000, "n_words", 400, True),
    "capitals": ("n_capitals", 10_000, "word_chars", 300, False),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def repeated_words(words: Column) -> Column:
    """Words covered by windows of three words that occur twice or more."""
    last = F.size(words) - 3

    def spread(found: Column) -> Column:
        """Each window covers three words, or as many as there are up to the next window."""
        return F.aggregate(
            found, F.struct(F.lit(-3).alias("end"), F.lit(0).alias("sum")),
            lambda acc, at: F.struct(at.alias("end"), (acc["sum"] + F.least(F.lit(3), at - acc["end"])).alias("sum")),
        )["sum"]

    def marked(ordered: Column) -> Column:
        def same(k: Column, x: Column) -> Column:
            return F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))

        return F.sort_array(
            F.filter(F.transform(ordered, lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["i"])), F.isnotnull)
        )

    def counted(hashes: Column) -> Column:
        numbered = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            spread(let(F.sort_array(numbered), marked))
        )

    windows = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(last < 1, F.lit(0)).otherwise(let(windows, counted))


def measure(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add the struct ``_m`` of all measures (long)."""
    value = F.coalesce(F.col(text), F.lit(""))

    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(value, "\n"), lambda line: F.rlike(line, F.lit(WORD)))

        def joined(lines: Column) -> Column:
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.regexp_count(value, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                repeated_words(words).cast("long").alias("n_repeat_words"),
                F.size(lines).cast("long").alias("n_lines"),
                F.regexp_count(value, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
            )

        return let(lines, joined)

    return documents.withColumn("_m", let(F.regexp_extract_all(value, F.lit(WORD), F.lit(0)), of_words))


def base_failed(m: str = "_m") -> Column:
    return F.expr(f"{m}.n_words < 50 OR 100 * {m}.n_repeat_words > 50 * {m}.n_words")


def rate(name: str) -> Column:
    """A rate as a whole number; 0 where its denominator is 0."""
    above, factor, below, _, _ = RATES[name]
    return F.expr(f"CASE WHEN _m.{below} > 0 THEN {factor} * _m.{above} DIV _m.{below} ELSE 0L END")


def bucket(value: Column) -> Column:
    """The lower end of the value's bucket: its highest SKETCH_BITS bits."""
    spare = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0))
    return value - F.pmod(value, F.pow(F.lit(2), spare).cast("long"))


def sketch(measured: DataFrame) -> DataFrame:
    """Counts per (lang, source, rate, bucket): add the counts of two sketches to merge them."""
    rates = F.array(*[F.struct(F.lit(n).alias("rate"), rate(n).alias("value")) for n in RATES])
    return (
        measured.select("lang", "source", F.inline(rates))
        .groupBy("lang", "source", "rate", bucket(F.col("value")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quartiles(sketched: DataFrame, group: list[str]) -> DataFrame:
    """Quartiles per group and rate, read from the merged sketch."""
    merged = sketched.groupBy(*group, "rate", "bucket").agg(F.sum("n").alias("n"))
    scope = Window.partitionBy(*group, "rate")
    running = merged.withColumn("up_to", F.sum("n").over(scope.orderBy("bucket"))).withColumn(
        "docs", F.sum("n").over(scope)
    )

    def at(quarter: int) -> Column:
        return F.min(F.when(F.col("up_to") * 4 >= F.col("docs") * quarter, F.col("bucket")))

    return running.groupBy(*group, "rate").agg(
        F.max("docs").alias("docs"), at(1).alias("q1"), at(3).alias("q3")
    )


def fences(sketched: DataFrame, weight: int = 200, reach: int = 3) -> DataFrame:
    """One row per (lang, source) with columns ``<rate>_high``, and ``<rate>_low`` for two-sided rates.

    A group's quartiles are blended with those of its language as if ``weight`` documents spoke for these, and a
    language's in the same way with those of all documents: the larger a group, the more its own count. The
    tables joined have one row per group and rate.
    """

    def blended(docs: str, mine: str, whole: str) -> Column:
        return (F.col(docs) * F.col(mine) + weight * F.col(whole)) / (F.col(docs) + weight)

    overall = quartiles(sketched, []).select(F.col("rate").alias("_r"), F.col("q1").cast("double").alias("a1"), F.col("q3").cast("double").alias("a3"))
    by_lang = quartiles(sketched, ["lang"]).join(overall, F.col("rate") == F.col("_r")).select(
        F.col("lang").alias("_l"), F.col("rate").alias("_lr"), blended("docs", "q1", "a1").alias("l1"), blended("docs", "q3", "a3").alias("l3")
    )
    ranged = quartiles(sketched, ["lang", "source"]).join(by_lang, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("rate") == F.col("_lr")))
    ranged = ranged.select("lang", "source", "rate", blended("docs", "q1", "l1").alias("q1"), blended("docs", "q3", "l3").alias("q3"))
    columns = []
    for name, (_, _, _, least, two_sided) in RATES.items():
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(float(least)))
        mine = F.col("rate") == name
        columns.append(F.max(F.when(mine, F.col("q3") + reach * spread)).alias(f"{name}_high"))
        if two_sided:
            columns.append(F.max(F.when(mine, F.col("q1") - reach * spread)).alias(f"{name}_low"))
    return ranged.groupBy("lang", "source").agg(*columns)


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to measured documents."""
    verdict = ~F.col("_base_failed")
    for name, (_, _, _, _, two_sided) in RATES.items():
        verdict = verdict & (rate(name) <= F.col(f"{name}_high"))
        if two_sided:
            verdict = verdict & (rate(name) >= F.col(f"{name}_low"))
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return measured.withColumn("_base_failed", base_failed()).join(limits, same).withColumn("_kept", verdict)


def assess(documents: DataFrame, carry: list[Column] | None = None, weight: int = 200, reach: int = 3) -> DataFrame:
    """One row per document with the measures, ``base_failed`` and ``kept``, and the columns of ``carry``."""
    slim = documents.select("doc_id", "lang", "source", "text", *(carry or []))
    measured = measure(slim)
    measured = stage(measured.drop("text"), "quality-measures")
    # written, so that the planner knows how small they are before it moves documents to them
    judged = judge(measured, stage(fences(sketch(measured), weight, reach), "quality-fences"))
    extra = [c for c in slim.columns if c not in ("doc_id", "lang", "source", "text")]
    return judged.select(
        "doc_id", *[F.col(f"_m.{m}").alias(m) for m in MEASURES],
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), *extra,
    )


def keep_good(documents: DataFrame, **settings) -> DataFrame:
    """The rows of ``documents`` that pass, all columns as they were."""
    judged = assess(documents, carry=[F.struct(*documents.columns).alias("_row")], **settings)
    return judged.where("kept").select("_row.*")
