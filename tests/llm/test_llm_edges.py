"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import tracemalloc

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import (
    bpe, chat, html_diff, iblt, line_dedup, mixing, quality_model, quality_rules, secret_scan, simhash,
)
from sentrylake.llm.lexicon import Lexicon

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
LINE = "This line is certainly longer than forty code points, it is."
# names that the operators use themselves
CLASH = [
    "size", "source_size", "target", "copies", "taken", "place", "n_words", "kept", "base_failed", "ids", "decoded", "gone", "h", "g",
    "last", "fp", "component_id", "root", "first", "base", "spans", "candidates", "score", "predicted", "held_out", "n", "rate",
]
TEXTS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\f\r ", None, "a"), (4, LONG, "en", None), (5, LINE, "en", "a"),
    (5, LINE, "en", "a"), (6, LINE, "de", "b"), (7, LINE, "de", "b"), (8, LINE + "\nx", "de", "b"), (None, LINE, "en", "a"),
    (9, "é" * 41 + "\n" + "É" * 41, "fr", "b"), (10, "\n\n\n", "fr", "b"), (11, "\U0001f600 a\x00b", "fr", "b"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, lang, source, len(t or "")) for i, t, lang, source in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def nothing(spark, documents):
    return spark.createDataFrame([], documents.schema)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))


def ids(df):
    return sorted([r["doc_id"] for r in df.select("doc_id").collect()], key=lambda i: (i is None, i))


EVERY = sorted([i for i, *_ in TEXTS], key=lambda i: (i is None, i))


def test_mix(documents, nothing):
    rows = mixing.mix(documents).collect()
    assert sorted([r["doc_id"] for r in rows], key=lambda i: (i is None, i)) == EVERY
    assert {r["doc_id"]: r["size"] for r in rows}[1] == 0
    for source in ("a", "b", None):
        own = [r for r in rows if r["source"] == source]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert own[0]["target"] <= 3 * own[0]["source_size"]
        assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in own)
    total = sum(r["size"] for r in rows)
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - total) < 1e-6 * total
    again = mixing.mix(documents.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.mix(nothing).count() == 0


def test_mixed_rows_keep_columns(documents, nothing):
    mixed = mixing.mixed_rows(documents)
    assert mixed.columns == documents.columns
    assert {r["size"] for r in mixed.collect()} <= {"own size"}
    assert mixing.mixed_rows(nothing).count() == 0


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 10), ("c", 100), (None, 1000)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # weights 1, 2, 3, 1; a, b and c stop at three times their size, the rest goes to the null source
    assert got == {"a": 30.0, "b": 30.0, "c": 300.0, None: 760.0}


def test_rules(documents, nothing):
    rows = {r["doc_id"]: r for r in quality_rules.assess(documents).collect()}
    assert rows[1]["n_words"] == rows[2]["n_words"] == rows[3]["n_words"] == 0 and rows[1]["base_failed"]
    assert rows[4]["n_words"] == 60_000 and rows[4]["n_repeat_words"] == 60_000
    assert rows[11]["word_chars"] == 5 - 1 and rows[9]["n_capitals"] == 41
    assert quality_rules.assess(documents).count() == len(TEXTS)
    assert quality_rules.keep_good(documents).columns == documents.columns
    assert quality_rules.assess(nothing).count() == 0 == quality_rules.keep_good(nothing).count()


def test_sketches_merge(spark):
    """Sketches of parts add up to the sketch of the whole, and quantiles read from them are close."""
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "'en' AS lang", "concat('s', id % 3) AS source",
        "concat_ws(' ', repeat('word ', 60), repeat('## ', cast(id % 500 as int))) AS text",
    )
    measured = quality_rules.measure(docs)
    whole = quality_rules.sketch(measured)
    parts = quality_rules.sketch(measured.where("doc_id % 2 = 0")).union(quality_rules.sketch(measured.where("doc_id % 2 = 1")))
    summed = parts.groupBy("lang", "source", "rate", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(str, summed.collect())) == sorted(map(str, whole.collect()))
    read = quality_rules.quartiles(whole, ["lang"]).where("rate = 'symbols'").first()
    exact = measured.select(quality_rules.rate("symbols").alias("v")).agg(F.percentile("v", 0.75)).first()[0]
    assert exact * (1 - 2 ** -6) - 1 <= read["q3"] <= exact + 1


def test_bpe(documents, nothing, vocabulary):
    lexicon = bpe.build_lexicon(documents, vocabulary, size=100)
    coded = bpe.decode(bpe.encode(documents, vocabulary, lexicon), vocabulary)
    rows = {r["doc_id"]: r for r in coded.collect()}
    assert rows[1]["ids"] == rows[2]["ids"] == rows[3]["ids"] == [] and rows[1]["decoded"] == ""
    assert len(rows[4]["ids"]) > 60_000 and coded.count() == len(TEXTS)
    assert set(coded.columns) == set(documents.columns)
    both = bpe.round_trip(documents, vocabulary, lexicon).select("doc_id", "ids", "decoded", "fp")
    assert sorted(map(str, both.collect())) == sorted(map(str, coded.select("doc_id", "ids", "decoded", "fp").collect()))
    empty = bpe.decode(bpe.encode(nothing, vocabulary, bpe.build_lexicon(nothing, vocabulary)), vocabulary)
    assert empty.count() == 0


def test_the_driver_needs_little_for_the_lexicon(spark, vocabulary):
    """Words and ids pass one at a time; as rows, lists and nested states they took 489 bytes a word."""
    words = 20_000
    documents = spark.range(2 * words).selectExpr(f"translate(cast(100000 + id % {words} AS string), '0123456789', 'abcdefghij') AS text")
    bpe.build_lexicon(documents.limit(1), vocabulary)  # modules are loaded
    tracemalloc.start()
    try:
        lexicon = bpe.build_lexicon(documents, vocabulary)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    listed = Lexicon(lexicon)
    assert len(listed.offsets) == words + 1 and listed.ranks([b"baaaaa", b"bbjjjj", b"baaaa"]).tolist() == [0, words - 1, -1]
    assert peak < 200 * words


def test_lines(documents, nothing):
    rows = line_dedup.dedup(documents, batches=3, fanout=2).collect()
    left = {}
    for r in rows:
        left.setdefault(r["doc_id"], []).append((r["text"], r["_lines"], r["_dropped"]))
    # 5, 5, 6, 7, 8 and null hold the line; 8 is the largest and keeps it
    assert left[5] == [("", 1, 1)] * 2 and left[6] == left[7] == left[None] == [("", 1, 1)]
    assert left[8] == [(LINE + "\nx", 2, 0)] and left[1] == [(None, 1, 0)] and left[10] == [("\n\n\n", 4, 0)]
    assert line_dedup.without_repeated_lines(documents).columns == documents.columns
    assert line_dedup.dedup(nothing).count() == 0


def test_op5_sorts_no_texts(documents):
    """Texts meet their line numbers as a stream; before, a merge join sorted them and an executor ran out of memory."""
    plan = line_dedup.dedup(documents)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "LeftOuter, BuildRight" in plan and "SortMergeJoin" not in plan.split("ShuffledHashJoin")[0]
    texts = plan.split("ShuffledHashJoin", 1)[1].split("Exchange", 1)[0]
    assert "Sort " not in texts


def test_line_runs_grow_by_batches(spark):
    """A line goes once enough batches hold it, whatever the levels the runs are on."""
    runs, last = line_dedup.LineRuns(spark, fanout=2), None
    for number in range(5):
        docs = spark.createDataFrame([(number, LINE)], "doc_id bigint, text string")
        last = line_dedup.line_keys(docs, 40)
        runs.add(last)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    total = runs.repeated(5).collect()
    assert [(r["n"], r["last"]) for r in total] == [(5, 4)]
    assert runs.going(last, 5).count() == 0 and runs.repeated(6).count() == 0


def test_fingerprints(documents, nothing):
    rows = iblt.fingerprints(documents).collect()
    assert sorted([r["doc_id"] for r in rows], key=lambda i: (i is None, i)) == EVERY
    by_id = {r["doc_id"]: r for r in rows}
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (5, 6, 7, None)}) == 1
    assert by_id[7]["near_next"] == 1.0 and by_id[2]["near_next"] == 1.0 and by_id[1]["n_chars"] == 0
    assert by_id[1]["edited_sha256"] == hashlib.sha256(b"").hexdigest()  # a null text is followed by the largest id
    assert iblt.fingerprints(nothing).count() == 0
    alone = iblt.fingerprints(documents.where("doc_id = 8")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_scores(spark, documents, nothing):
    labels = spark.createDataFrame(
        [(4, 1, 0), (5, 0, 0), (5, 0, 0), (6, 0, 0), (7, None, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int"
    )
    trees = quality_model.train(documents, labels)
    rows = quality_model.score(documents, trees).collect()
    assert sorted([r["doc_id"] for r in rows], key=lambda i: (i is None, i)) == EVERY
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert quality_model.score(nothing, trees).count() == 0
    untrained = quality_model.train(nothing, labels)
    assert {r["score"] for r in quality_model.score(documents, untrained).collect()} == {0.5}


def test_secrets(documents, nothing):
    rows = {r["doc_id"]: r for r in secret_scan.secrets(documents).collect()}
    assert all(not r["base"] and not r["spans"] for r in rows.values()) and len(rows) == len(set(EVERY))
    assert secret_scan.secrets(documents).count() == len(TEXTS)
    assert secret_scan.secrets(nothing).count() == 0


def test_near_duplicates(documents, nothing):
    rows = simhash.near_duplicates(documents).collect()
    assert sorted([r["doc_id"] for r in rows], key=lambda i: (i is None, i)) == EVERY
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["fp"] == by_id[2]["fp"] == by_id[3]["fp"] == by_id[10]["fp"] == 0
    assert {by_id[i]["component_id"] for i in (1, 2, 3, 10)} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6, 7, None)} == {5}
    kept = simhash.one_of_each(documents)
    assert kept.columns == documents.columns and ids(kept).count(5) == 1 and not {2, 3, 6, 7, None} & set(ids(kept))
    assert simhash.near_duplicates(nothing).count() == 0 == simhash.one_of_each(nothing).count()


def test_pages(spark):
    schema = "page_id bigint, url string, html string, host string, lines string"
    menu = "<div>Same menu</div>"
    rows = [
        (1, "http://a.org/x/1", f"{menu}<div>One\n  own&nbsp;text &lt;here&gt;</div>"), (2, "http://a.org/x/2", f"{menu}<div>Two</div>"),
        (3, None, "<p>No host"), (4, "http://b.org/", None), (5, "http://b.org/q", ""), (5, "http://b.org/q", ""), (None, "odd url", "<"),
        (6, "http://c.org/", "<p>" + "long " * 100_000),
    ]
    pages = spark.createDataFrame([(*r, "h", "l") for r in rows], schema)
    got = {}
    for r in html_diff.extract(pages).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got == {
        1: ["One own text <here>"], 2: ["Two"], 3: ["No host"], 4: [""], 5: ["", ""], None: ["<"], 6: [" ".join(["long"] * 100_000)],
    }
    assert html_diff.extract(spark.createDataFrame([], schema)).count() == 0


def test_chats(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, speaker string, start string"
    rows = [
        (1, 0, "system", "Rules"), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob b", None), (1, 3, "ann", "Bye"), (1, 3, "ann", "Bye"),
        (2, 0, "system", "alone"), (None, 0, None, "who"), (None, 1, "cy", "me"),
    ]
    conversations = spark.createDataFrame([(*r, "s", "t") for r in rows], schema)
    out = chat.rotate(conversations).collect()
    assert {(r["conv_id"], r["perspective"]) for r in out} == {(1, "ann"), (1, "bob b"), (None, "cy")}
    for conv, who in {(r["conv_id"], r["perspective"]) for r in out}:
        own = sorted((r for r in out if (r["conv_id"], r["perspective"]) == (conv, who)), key=lambda r: r["start"])
        dialogue = "".join(r["segment"] for r in own)
        assert [r["start"] for r in own] == [0, *[r["stop"] for r in own][:-1]] and own[-1]["stop"] == len(dialogue)
        for r in own:
            mask = dialogue[r["mask_start"] : r["mask_stop"]]
            assert r["trained"] == (r["speaker"] == who) == bool(mask)
            assert not mask or mask.endswith("<|im_end|>")
    bob = [r["segment"] for r in sorted(out, key=lambda r: r["start"]) if r["perspective"] == "bob b"]
    assert bob == [
        "<|im_start|>system\nRules<|im_end|>\n", "<|im_start|>user name=ann\nHi <im_end><|im_end|>\n",
        "<|im_start|>assistant\n<|im_end|>\n", *["<|im_start|>user name=ann\nBye<|im_end|>\n"] * 2,
    ]
    assert chat.rotate(spark.createDataFrame([], schema)).count() == 0
