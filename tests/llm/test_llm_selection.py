"""Draws towards a target, hard negatives and toxicity: against plain versions, and the odd cases of each."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sentrylake.llm import bond, importance, subsequences, toxicity
from sentrylake.session import stage

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
CLASH = [
    "_row", "score", "rank", "weight", "n", "bucket", "n_words", "place", "_low", "_id", "label2", "row", "vector2", "anchor_row",
    "positives", "held_out", "predicted", "_id", "toxic2", "doc", "piece", "sentence",
]


def clashing(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH if c not in df.columns})


# --- draws towards a target


def plain_draw(documents, target, longest=1, least=20, percent=10, buckets=10_000):
    def found(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    s, t = [0] * buckets, [0] * buckets
    for _, text in documents:
        for b in found(text)[1]:
            s[b] += 1
    for text in target:
        for b in found(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    rows = []
    for doc, text in documents:
        n, own = found(text)
        weight = math.floor(sum(gain[b] for b in own) / len(own)) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((-r[4], r[0] is None, r[0] or 0) for r in rows if r[1] >= least)
    return rows, order[: len(order) * percent // 100]


VOCABULARY = ["apple", "Berry", "ÉCLAIR", "éclair", "d2", "x", "中文", "a-b", "c_d", "e'f", "\x00", "<p>"]


@pytest.mark.parametrize("longest", [1, 3])
def test_draw_equals_the_plain_version(spark, monkeypatch, longest):
    monkeypatch.setattr(importance, "DIRECT", 8)
    deal = random.Random(longest)
    documents = [(i, " ".join(deal.choices(VOCABULARY, k=deal.choice([0, 5, 19, 25, 60])))) for i in range(300)]
    documents += [(400, None), (401, ""), (402, LONG), (None, "apple " * 30), (5, documents[5][1]), (5, documents[5][1])]
    target = ["apple éclair " * 5, None, ""]
    df = clashing(spark.createDataFrame(documents, "doc_id bigint, text string"))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    rows, drawn = plain_draw(documents, target, longest, percent=30)
    for parts in (1, 7):
        got = importance.resample(df.repartition(parts), goal, longest=longest, percent=30).collect()
        own = [(r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got]
        assert sorted(own, key=str) == sorted(rows, key=str)
        ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
        assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked] == drawn


def test_draw_from_nothing_and_to_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(i, "apple " * 25) for i in range(20)], "doc_id bigint, text string")
    assert importance.resample(none, some).count() == 0
    got = importance.resample(some, none.select("text")).collect()
    assert sum(r["rank"] is not None for r in got) == 2
    assert all(r["rank"] is None for r in importance.resample(some, some, least_words=26).collect())


@given(st.lists(st.integers(-3, 3), min_size=1, max_size=60), st.data())
@settings(max_examples=12, deadline=None)
def test_cut_is_exact_for_any_ties(spark, scores, data):
    wanted = data.draw(st.integers(1, len(scores)))
    rows = [(s, False, i % 4, i) for i, s in enumerate(scores)]
    keys = spark.createDataFrame(rows, "_low bigint, _unnamed boolean, _id bigint, _row bigint").repartition(3)
    before, importance.DIRECT = importance.DIRECT, 2
    try:
        assert importance.cutoff(keys, wanted, len(rows)) == sorted(rows)[wanted - 1]
    finally:
        importance.DIRECT = before


def test_half_of_the_rows_share_one_score(spark, monkeypatch):
    monkeypatch.setattr(importance, "DIRECT", 16)
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast("long").alias("score"), (F.col("id") % 3).alias("doc_id"))
    got = importance.draw(rows.repartition(9), 60, F.lit(True)).where("rank IS NOT NULL")
    assert got.count() == 2400 and got.select("rank").distinct().count() == 2400
    assert got.where("score = 7").count() == 2400 - rows.where("score > 7").count()


# --- hard negatives


def plain_negatives(rows, positives=5, negatives=5, low=80, high=100):
    usable = [(n, *r) for n, r in enumerate(rows) if r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    for n, anchor, label, vector, is_anchor in usable:
        if not is_anchor:
            continue
        def key(x):
            return (-x[0], x[1] is None, x[1] or 0)
        scored = [(sum(a * b for a, b in zip(vector, v)), i, own) for m, i, own, v, _ in usable if m != n]
        near = sorted((s for s in scored if s[2] == label), key=key)[:positives]
        for p, positive, _ in near:
            inside = sorted((s for s in scored if s[2] != label and low * p <= 100 * s[0] <= high * p), key=key)[:negatives]
            out += [(anchor, positive, rank, i, p, s) for rank, (s, i, _) in enumerate(inside, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("scale", [3, 60, 2**27])
def test_negatives_equal_the_plain_version(spark, scale):
    deal = random.Random(scale)
    dims = 37
    rows = [
        (i, deal.choice([0, 0, 0, 1, 2]), [deal.randint(-scale, scale) + scale // 2 for _ in range(dims)], i % 25 == 0) for i in range(240)
    ]
    rows += [(300, None, [1] * dims, True), (301, 1, None, True), (302, 1, [1, None] + [2] * (dims - 2), True), (None, 2, rows[3][2], False)]
    rows += [(304, 0, [5, 4], False), (305, 1, [], True), (306, 9, [scale] * dims, True)]
    df = clashing(spark.createDataFrame(rows, "vec_id bigint, label int, vector array<bigint>, anchor boolean"))
    for parts in (1, 6):
        got = bond.hard_negatives(df.repartition(parts), F.col("anchor")).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_negatives(rows)


def test_copies_and_ties_of_vectors(spark):
    rows = [(i // 2, i % 3 % 2, [1, 2, 3], i == 0) for i in range(30)]  # ids twice, all scores alike
    df = spark.createDataFrame(rows, "vec_id bigint, label int, vector array<bigint>, anchor boolean")
    got = sorted(tuple(r) for r in bond.hard_negatives(df, F.col("anchor")).collect())
    assert got == sorted(plain_negatives(rows))
    assert bond.hard_negatives(df.limit(0), F.col("anchor")).count() == 0
    assert bond.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


@given(st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_bounds_never_lose_a_row(seed):
    deal = np.random.default_rng(seed)
    rows, dims, k = int(deal.integers(1, 80)), int(deal.integers(1, 50)), int(deal.integers(1, 7))
    columns = deal.integers(-9, 10, (dims, rows)).astype(np.float64)
    order = np.arange(rows)
    block = bond.Block(order, order, np.zeros(rows, bool), order, columns, columns.min(axis=1), columns.max(axis=1))
    anchor = deal.integers(-9, 10, dims).astype(np.float64)
    scores = anchor @ columns
    at, found = bond.vertical_scan(block, anchor, order, bond._best(k))
    assert (found == scores[at]).all()
    assert set(np.flatnonzero(scores >= np.sort(scores)[::-1][min(k, rows) - 1])) <= set(at.tolist())
    floors, tops = np.array([-20.0, 60.0]), np.array([5.0, 61.0])
    at, found = bond.vertical_scan(block, anchor, order, bond._windows(floors, tops))
    assert (found == scores[at]).all()
    inside = ((scores[:, None] >= floors) & (scores[:, None] <= tops)).any(axis=1)
    assert set(np.flatnonzero(inside)) == set(at.tolist())


# --- toxicity


def plain_kernel(s, t):
    """Sum over shared triples of DECAY to the power of both spans, without any table."""
    total = 0.0
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, len(s)):
                for a in range(len(t)):
                    for b in range(a + 1, len(t)):
                        for c in range(b + 1, len(t)):
                            if (s[i], s[j], s[k]) == (t[a], t[b], t[c]):
                                total += subsequences.DECAY ** (k - i + 1 + c - a + 1)
    return total


@given(st.lists(st.text("abcé1", max_size=7), min_size=1, max_size=4), st.lists(st.text("abcé1", min_size=3, max_size=6), min_size=1, max_size=3))
@settings(max_examples=60, deadline=None)
def test_kernel_equals_its_definition(texts, marks):
    got = subsequences.Landmarks(marks).kernel(texts)
    for i, s in enumerate(texts):
        for j, t in enumerate(marks):
            both = plain_kernel(s, s) * plain_kernel(t, t)
            want = (plain_kernel(s, t) / math.sqrt(both)) ** subsequences.POWER if both else 0.0
            assert got[i, j] == pytest.approx(want, abs=1e-4)


def test_windows_cover_every_place():
    word = "".join(chr(97 + i % 26) for i in range(203))
    found = subsequences.windows(word)
    assert max(map(len, found)) == subsequences.WIDTH
    whole = subsequences.START + word
    assert all(any(whole[i : i + 8] in w for w in found) for i in range(len(whole) - 7))


INSULTS = ["grimbold", "snarkle", "plonker"]


def sentence(deal):
    return " ".join("".join(deal.choices(["ta", "re", "mi", "so", "lu", "ne"], k=deal.randint(1, 3))) for _ in range(9)) + "."


@pytest.fixture(scope="module")
def judged(spark):
    """Texts of syllables; a third hold insults in one of their sentences, and some labels are wrong."""
    deal = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        own = [sentence(deal) for _ in range(4)]
        toxic = i % 3 == 0
        if toxic:
            own[deal.randrange(4)] += " " + " ".join(deal.sample(INSULTS, 2)) + "."
        rows.append((i, "\n".join(own)))
        labels.append((i, int(toxic or i % 50 == 1)))
    return clashing(spark.createDataFrame(rows, "doc_id bigint, text string")), spark.createDataFrame(labels, "doc_id bigint, toxic int")


@pytest.fixture(scope="module")
def machine(judged):
    return toxicity.train(*judged)


def test_toxic_texts_are_found(judged, machine):
    got = {r["doc_id"]: r for r in toxicity.score(judged[0], machine).collect()}
    assert all(r["predicted"] == (i % 3 == 0) for i, r in got.items())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 for r in got.values())


@pytest.mark.parametrize("said", [
    "snarkle", "SNARKLE!", "s.n.a.r.k.l.e", "s n a r k l e", "s-n-a-r k l e snark-le", "snarrkle", "snar_kle", "plonkker", "p*l*o*n*k*e*r",
    "grim-bold", "grimboold", "G R I M B O L D",
])
def test_gaps_and_inserted_characters(machine, said):
    assert machine.chances(machine.worst([f"tare mi {said} solu ne"]))[0] >= 0.7


@pytest.mark.parametrize("said", ["tare mi solu ne", "remi", "", None, "a b c", "tarelumi" * 40, "grim", "bold"])
def test_clean_words_stay_clean(machine, said):
    assert machine.chances(machine.worst([said]))[0] < 0.5


def test_memory_of_words_changes_nothing(judged, machine, monkeypatch):
    texts = [r["text"] for r in judged[0].select("text").limit(60).collect()]
    want = machine.worst(texts).tolist()
    monkeypatch.setattr(toxicity, "REMEMBERED", 5)
    monkeypatch.setattr(toxicity, "GROUP", 3)
    machine.known.clear()
    assert machine.worst(texts).tolist() == pytest.approx(want, abs=1e-9)


@given(st.lists(st.text("abegiklmnoprsd .-", max_size=60), max_size=6))
@settings(max_examples=100, deadline=None)
def test_bounded_words_equal_all_words(machine, texts):
    texts = texts + [t.replace("a", "snarkle") for t in texts]
    machine.known.clear()
    got = machine.worst(texts)
    for text, worst in zip(texts, got):
        cut = [p for word in toxicity.words(text) for p in toxicity.pieces(word)]
        values = machine.marks.kernel(cut) @ machine.weight + machine.constant
        assert worst == pytest.approx(max([machine.floor, *values.tolist()]), abs=1e-5)
        assert (machine.marks.at_most(cut, machine.weight) + machine.constant >= values - 1e-6).all()


def test_odd_texts_and_labels(spark, judged, machine):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "plonker"), (5, "plonker"), (None, "x"), (6, "!!! ???"), (7, "a" * 100_000)]
    odd = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = toxicity.score(odd, machine).collect()
    assert len(got) == len(rows) and sum(r["predicted"] for r in got) == 2
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3, 6)}) == 1
    assert toxicity.score(odd.limit(0), machine).count() == 0
    for label in (0, 1):
        one = judged[1].withColumn("toxic", F.lit(label))
        assert len({r["score"] for r in toxicity.score(odd, toxicity.train(judged[0], one)).collect()}) == 1
    nulls = judged[1].withColumn("toxic", F.lit(None).cast("int"))
    assert 0 < toxicity.score(odd, toxicity.train(judged[0], nulls)).first()["score"] < 1
    none = stage(judged[0].limit(0), "none")
    assert toxicity.score(none, toxicity.train(none, judged[1])).count() == 0


def test_held_out_rows_teach_nothing(judged, machine):
    """With other texts and labels for the held-out rows the machine is the same."""
    out = toxicity.remainder(F.col("doc_id")) == toxicity.HELD_OUT
    documents = judged[0].withColumn("text", F.when(out, F.lit("other words")).otherwise(F.col("text")))
    labels = judged[1].withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(documents, labels)
    assert again.marks.texts == machine.marks.texts
    assert np.allclose(again.weight, machine.weight) and again.slope == pytest.approx(machine.slope)
