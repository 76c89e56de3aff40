"""Secret scans: patterns, and a battery of randomness tests under false-discovery control (DataFrame functions only).

The base kinds are patterns. The method adds kind ``random``: tokens of key-like characters whose
encoding is inferred and which pass a battery of tests. The encoding is the smallest alphabet that holds the token:
hex, letters of one case, base32 and alphanumeric of one case, alphanumeric, base64.

1. A token must look uniform over its alphabet: chi-squared statistic of its characters, number of runs
   of character classes, and correlation of neighbouring characters each lie within ``normal`` standard
   deviations of what a uniform string of that length gives.
2. It must not look like text: bounds on the probability that text has so few equal pairs of characters
   (chi-squared side) and so many runs give a p-value.
3. The p-values of all tokens of the corpus, by encoding and length (octaves), go through the
   Benjamini-Hochberg procedure at ``rate``. Counts per p-value step are enough for that, so no p-value
   is sorted; the cut-offs, one per encoding and octave, are the only rows that reach the driver.

Defined cases: null and empty text has no spans; repeated rows are scanned each on its own and all count
for the false-discovery control; an empty table gives an empty result; other columns are carried along
and never read. Spans are in code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .common import let

# The base patterns. Runs shorter than the stated length are no match, so the least
# length of access keys and hex runs can be in the pattern.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
# encoding: (characters, alphabet size, chance that neighbours are of different classes), smallest alphabet first
ENCODINGS = {
    "hex": ("^[0-9a-f]+$|^[0-9A-F]+$", 16, 2 * 10 * 6 / 16**2),
    "letters": ("^[a-z]+$|^[A-Z]+$", 26, 0),
    "base32": ("^[A-Z2-7]+$", 32, 2 * 26 * 6 / 32**2),
    "lower32": ("^[a-z2-7]+$", 32, 2 * 26 * 6 / 32**2),  # by case: words of text with digits are mostly lower-case
    "base36": ("^[A-Z0-9]+$", 36, 2 * 26 * 10 / 36**2),
    "lower36": ("^[a-z0-9]+$", 36, 2 * 26 * 10 / 36**2),
    "alnum": ("^[A-Za-z0-9]+$", 62, 1 - (26**2 + 26**2 + 10**2) / 62**2),
    "base64": ("", 64, 1 - (26**2 + 26**2 + 10**2) / 62**2),
}
LARGER_FIRST = [name for name in reversed(ENCODINGS) if name != "base64"]
TEXT_PAIRS, TEXT_CHANGES = 0.066, 0.08  # chance that two characters of text are equal; that neighbours change class
STEPS, LAST_STEP = 4, 400  # p-value steps per power of ten, and their number
BLOCK = 256


def running_sums(values: Column) -> Column:
    """Inclusive prefix sums of an array, block by block so that long arrays are not copied per element."""
    none = F.array().cast("array<bigint>")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(values, b * BLOCK + 1, BLOCK),
    )

    def block_sums(block: Column, before: Column) -> Column:
        return F.aggregate(
            block, F.struct(before.alias("sum"), none.alias("out")),
            lambda acc, x: let(acc["sum"] + x, lambda s: F.struct(s.alias("sum"), F.concat(acc["out"], F.array(s)).alias("out"))),
        )

    def add(acc: Column, block: Column) -> Column:
        return let(block_sums(block, acc["sum"]), lambda r: F.struct(
            r["sum"].alias("sum"), F.concat(acc["out"], F.array(r["out"])).alias("out")
        ))

    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.when(F.size(values) == 0, none).otherwise(F.flatten(F.aggregate(blocks, start, add)["out"]))


def spans(text: Column, pattern: str) -> Column:
    """Matches as array<struct<start, end, token>>: their places follow from the lengths of what lies between."""
    kind = "array<struct<start:bigint,end:bigint,token:string>>"

    def located(matches: Column) -> Column:
        def placed(between: Column) -> Column:
            steps = F.transform(matches, lambda m, i: (F.length(m) + F.length(F.get(between, i))).cast("bigint"))
            return let(running_sums(steps), lambda ends: F.transform(matches, lambda m, i: F.struct(
                (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("token")
            )))

        return let(F.split(text, pattern, -1), placed)

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast(kind))


def assignments(text: Column) -> Column:
    """Spans of assignments whose value has 8 characters or more."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return let(values, lambda v: F.filter(
        F.transform(spans(text, ASSIGN), lambda s, i: F.when(F.length(F.get(v, i)) >= 8, s)), F.isnotnull
    ))


def _battery(token: Column, normal: float) -> Column:
    """struct<enc, octave, step>: step of the p-value, 0 for tokens that fail a test."""
    body = F.regexp_replace(token, "[-_]", "")
    body = F.when(F.rlike(body, F.lit(ENCODINGS["hex"][0])), body).otherwise(token)

    def tests(body: Column) -> Column:
        enc = F.lit("base64")
        for name in LARGER_FIRST:
            enc = F.when(F.rlike(body, F.lit(ENCODINGS[name][0])), F.lit(name)).otherwise(enc)
        codes = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), F.ascii)
        return let(codes, lambda c: let(enc, lambda e: scored(c, e)))

    def scored(codes: Column, enc: Column) -> Column:
        n = F.size(codes).cast("double")

        def of_encoding(column: int) -> Column:
            value = F.lit(float(ENCODINGS["base64"][column]))
            for name in LARGER_FIRST:
                value = F.when(enc == name, F.lit(float(ENCODINGS[name][column]))).otherwise(value)
            return value

        # sum over characters of count squared: a run of r equal codes adds 1 + 3 + ... + (2r - 1)
        squares = F.aggregate(
            F.sort_array(codes), F.struct(F.lit(-1).alias("was"), F.lit(0).alias("run"), F.lit(0).cast("bigint").alias("sum")),
            lambda acc, c: let(F.when(acc["was"] == c, acc["run"] + 1).otherwise(F.lit(1)), lambda r: F.struct(
                c.alias("was"), r.alias("run"), (acc["sum"] + 2 * r - 1).alias("sum")
            )),
        )["sum"].cast("double")
        kind = F.filter(F.transform(codes, lambda c: F.when((c >= 97) & (c <= 122), 1).when(
            (c >= 65) & (c <= 90), 2).when((c >= 48) & (c <= 57), 3)), F.isnotnull)
        changes = let(kind, lambda k: F.aggregate(
            F.transform(k, lambda x, i: F.when(x != F.get(k, i - 1), 1).otherwise(0)), F.lit(0), lambda a, b: a + b
        )).cast("double")
        mean = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / n

        def products(mean: Column) -> Column:
            around = F.transform(codes, lambda c: c - mean)
            return let(around, lambda x: F.struct(
                F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v).alias("own"),
                F.aggregate(F.transform(x, lambda v, i: v * F.coalesce(F.get(x, i - 1), F.lit(0.0))),
                            F.lit(0.0), lambda a, v: a + v).alias("next"),
            ))

        values = F.struct(
            n.alias("n"), of_encoding(1).alias("k"), of_encoding(2).alias("change"), squares.alias("squares"),
            changes.alias("changes"), let(mean, products).alias("serial"), enc.alias("enc"),
        )
        return let(values, judged)

    def judged(v: Column) -> Column:
        n, k = v["n"], v["k"]
        chi = (k / n * v["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        spread = F.sqrt((n - 1) * v["change"] * (1 - v["change"]))
        runs = F.when(spread > 0, (v["changes"] - (n - 1) * v["change"]) / spread).otherwise(F.lit(0.0))  # letters have one class
        serial = F.when(v["serial"]["own"] > 0, v["serial"]["next"] / v["serial"]["own"]).otherwise(F.lit(1.0)) * F.sqrt(n)
        uniform = (F.abs(chi) <= normal) & (F.abs(runs) <= normal) & (F.abs(serial) <= normal)
        # Chernoff bounds under the text model, in natural logarithms
        expected, pairs = n * (n - 1) / 2 * TEXT_PAIRS, (v["squares"] - n) / 2
        few = F.when(pairs >= expected, F.lit(0.0)).otherwise(
            expected - pairs + F.when(pairs > 0, pairs * F.ln(pairs / expected)).otherwise(F.lit(0.0))
        )
        share = F.least(v["changes"] / (n - 1), F.lit(0.999))
        many = F.when(share <= TEXT_CHANGES, F.lit(0.0)).otherwise(
            (n - 1) * (share * F.ln(share / TEXT_CHANGES) + (1 - share) * F.ln((1 - share) / (1 - TEXT_CHANGES)))
        )
        power = (F.greatest(few, many) - F.log(F.lit(2.0))) / F.log(F.lit(10.0))  # -log10 p, two tests
        step = F.floor(F.least(F.greatest(power, F.lit(0.0)) * STEPS, F.lit(float(LAST_STEP))))
        return F.struct(
            v["enc"].alias("enc"), F.floor(F.log2(n)).cast("int").alias("octave"),
            F.when(uniform, step).otherwise(F.lit(0)).cast("int").alias("step"),
        )

    return let(body, tests)


def scan(documents: DataFrame, normal: float = 3.9, carry: Sequence[Column] = ()) -> DataFrame:
    """One row per document: doc_id, base (array of struct<start, rank, end>), candidates, and ``carry``."""
    text = F.coalesce("text", F.lit(""))

    def ranked(found: Column, rank: int) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))

    base = F.sort_array(F.concat(ranked(assignments(text), 0), ranked(spans(text, ACCESS), 1), ranked(spans(text, HEX), 2)))
    tokens = F.filter(spans(text, CANDIDATE), lambda s: F.rlike(s["token"], F.lit("[A-Za-z]")))
    tested = F.transform(tokens, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), _battery(s["token"], normal).alias("test")
    ))
    return documents.select("doc_id", base.alias("base"), tested.alias("candidates"), *carry)


def cut_offs(scanned: DataFrame, rate: float = 0.01) -> dict[tuple[str, int], int]:
    """Smallest p-value step that the Benjamini-Hochberg procedure admits, by encoding and octave."""
    tests = scanned.select(F.explode("candidates.test").alias("t")).select("t.*")
    counts = tests.groupBy("enc", "octave", "step").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("enc", "octave")
    found = F.sum("n").over(group.orderBy(F.col("step").desc()))
    admitted = F.sum("n").over(group) * F.pow(F.lit(10.0), -F.col("step") / STEPS) <= found * rate
    rows = (
        counts.withColumn("admitted", admitted).where("admitted AND step > 0")
        .groupBy("enc", "octave").agg(F.min("step").alias("step")).collect()  # encodings x octaves
    )
    return {(r["enc"], r["octave"]): r["step"] for r in rows}


def secrets(documents: DataFrame, rate: float = 0.01, carry: Sequence[Column] = ()) -> DataFrame:
    """One row per document: doc_id, base, spans (arrays of struct<start, rank, end>, sorted), and ``carry``."""
    scanned = stage(scan(documents, carry=carry), "secrets")
    allowed = cut_offs(scanned, rate)

    def discovered(c: Column) -> Column:
        test, chosen = c["test"], F.lit(False)
        for (enc, octave), step in sorted(allowed.items()):
            chosen = chosen | ((test["enc"] == enc) & (test["octave"] == octave) & (test["step"] >= step))
        return chosen

    added = F.transform(F.filter("candidates", discovered), lambda c: F.struct(
        c["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), c["end"].alias("end")
    ))
    return scanned.withColumn("spans", F.sort_array(F.concat("base", added))).drop("candidates")


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")
