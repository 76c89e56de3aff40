"""Quantiles, thresholds, scaling, samples, running totals, entropy."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentrylake.functions import entropy as entropies
from sentrylake.functions.entropy import char_entropy, mean_token_entropy
from sentrylake.functions.values import conn_suspicious, integer, login_failed, number, utc_time
from sentrylake.operators.quantiles import RobustScaler, exact_quantiles, score_threshold
from sentrylake.operators.ranges import running_total
from sentrylake.operators.sampling import capped, sample_per_day, smallest_by_hash


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    # half of the values are copies of one value, some are null
    a, b = rng.normal(size=n).tolist(), [7.0 if i % 2 else float(i) for i in range(n)]
    df = spark.createDataFrame([(x, y, None if i % 5 == 4 else x) for i, (x, y) in enumerate(zip(a, b))], "a double, b double, c double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = {r["feature"]: r for r in exact_quantiles(df.repartition(5), ["a", "b", "c"], probs).collect()}
    for name, values in {"a": a, "b": b, "c": [x for i, x in enumerate(a) if i % 5 != 4]}.items():
        assert got[name]["n"] == len(values)
        expected = np.quantile(values, probs)
        assert [got[name][f"q{i}"] for i in range(len(probs))] == pytest.approx(expected.tolist(), abs=1e-12)


def test_thresholds(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "score double")
    row = score_threshold(df, "score").first()
    assert (row["threshold"], row["n_over"]) == (95.0, 6)
    row = score_threshold(df, "score", method="other").first()
    assert row["threshold"] == pytest.approx(50 + np.std(range(101), ddof=1))


def test_robust_scaling_keeps_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 3), (3.0, 3), (None, 3)], "a double, b int")
    scaler = RobustScaler.fit(df, ["a", "b"])
    assert (scaler.centers, scaler.scales) == ({"a": 1.5, "b": 3.0}, {"a": 1.5, "b": 1.0})
    assert sorted(r["a"] for r in scaler.transform(df).collect()) == pytest.approx([-1, -1 / 3, 1 / 3, 1])


@pytest.mark.parametrize("group", [[], ["g"]])
def test_running_total(spark, group):
    values = list(range(1000))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v, v % 7, v % 3) for v in values], "k int, w int, g int").repartition(9)
    for r in running_total(df, group, ["k"], "w").collect():
        mine = [j for j in range(1000) if not group or j % 3 == r["g"]]
        assert r["before"] == sum(j % 7 for j in mine if j < r["k"]) and r["total"] == sum(j % 7 for j in mine)


def brute_sample(rows, k, seed=42):
    return sorted(hashlib.md5(f"{uid}{seed}".encode()).hexdigest() for uid, _ in rows)[:k]


def hashes(df, seed=42):
    return sorted(hashlib.md5(f"{r['event_uid']}{seed}".encode()).hexdigest() for r in df.collect())


@pytest.mark.parametrize("k", [0, 1, 50, 299, 300, 1000])
def test_samples_equal_brute_force(spark, k):
    # a third of the rows are copies of one id
    rows = [(7 if i % 3 == 0 else i, "d") for i in range(300)]
    df = spark.createDataFrame(rows, "event_uid int, dt string")
    assert hashes(smallest_by_hash(df.repartition(6), k)) == brute_sample(rows, k)
    assert hashes(capped(df, k)) == brute_sample(rows, k)


def test_sample_per_day(spark):
    rows = [(i, "big" if i % 10 else "small") for i in range(500)]
    got = sample_per_day(spark.createDataFrame(rows, "event_uid int, dt string"), 100)
    for day in ("big", "small"):
        mine = [r for r in rows if r[1] == day]
        assert hashes(got.filter(F.col("dt") == day)) == brute_sample(mine, 100)


def entropy(text):
    counts = collections.Counter(text or "")
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


def test_entropy_of_texts_and_tokens(spark):
    rng = random.Random(3)
    alphabet = "ab c\n\té😀漢 xyz"
    texts = [None, "", "a", "aaaa", "ab", "😀😀é"] + ["".join(rng.choices(alphabet, k=rng.randrange(300))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    got = {r["i"]: r["e"] for r in df.select("i", char_entropy(F.col("t")).alias("e")).collect()}
    assert all(got[i] == pytest.approx(entropy(t), abs=1e-9) for i, t in enumerate(texts))
    lists = [None, [], [""], ["ab", "", "aa"], ["ab", None, "abcd"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i int, t array<string>")
    got = {r["i"]: r["e"] for r in df.select("i", mean_token_entropy(F.col("t")).alias("e")).collect()}
    assert [got[i] for i in range(5)] == pytest.approx([0, 0, 0, 0.5, 1.5])


def test_entropy_is_the_same_in_small_portions(monkeypatch):
    texts = pa.array(["", "aab", "x" * 500, "\U0001f600a" * 40, "", "abcabc"])
    whole = entropies._entropies(texts)
    monkeypatch.setattr(entropies, "TOGETHER", 100)
    assert entropies._entropies(texts).tolist() == whole.tolist() == pytest.approx([entropy(t) for t in texts.to_pylist()])


def test_flags_and_conversions(spark):
    rows = [("4625", None, None), (None, "FAILURE", "4444.0"), ("4624", "S0", "x"), (None, "s0", None)]
    df = spark.createDataFrame(rows, "code string, outcome string, port string")
    got = df.select(
        login_failed(F.col("code"), F.col("outcome")).alias("l"), conn_suspicious(F.col("port"), F.col("outcome")).alias("c"),
        integer(F.col("port")).alias("p"), number(F.col("port")).alias("n"), utc_time(F.col("outcome")).alias("t"),
    ).collect()
    assert [(r["l"], r["c"], r["p"], r["n"], r["t"]) for r in got] == [
        (1, 0, None, None, None), (1, 1, 4444, 4444.0, None), (0, 1, None, None, None), (0, 0, None, None, None)
    ]
