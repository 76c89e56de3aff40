import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.model.forest import (
    Forest, ForestConfig, Stacked, coerce_features, fit_forest, grow_tree, isolation, mean_depth, mean_paths, numeric_features,
    offered_rows, offers, score, tree_arrays, tree_samples,
)
from sentrylake.model.shap import contributions, explain_by_shap, leaf_paths

NAMES = ["x", "y", "z"]
CONFIG = ForestConfig(n_estimators=20, max_samples=64)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(size=2)), 1.0) for i in range(1500)] + [(9999, 12.0, -12.0, 1.0)]
    return spark.createDataFrame(rows, "event_uid int, x double, y double, z double").cache()


@pytest.fixture(scope="module")
def forest(points):
    return fit_forest(points, NAMES, CONFIG)


def test_rows_that_no_tree_draws_are_left_out_first(spark):
    """Every row of a large table went through the whole draw, though a tree wants about one in a hundred."""
    for trees, share in ((30, 0.05), (150, 6e-5), (1, 0.5), (150, 0.9)):
        df = spark.range(30_000).withColumn("trees", offers(F.col("id"), trees, share, 7))
        some = offered_rows(spark.range(30_000), "id", trees, share, 7)
        assert {r["id"] for r in some.collect()} == {r["id"] for r in df.filter("trees IS NOT NULL").select("id").collect()}
    drawn = offered_rows(spark.range(100_000).withColumnRenamed("id", "event_uid"), "event_uid", 150, 6e-5, 42)
    assert 0 < drawn.count() < 2_000


def test_mean_depth():
    assert mean_depth(np.array([0, 1, 2])).tolist() == [0, 0, 1]
    assert float(mean_depth(256)) == pytest.approx(2 * (math.log(255) + np.euler_gamma) - 2 * 255 / 256)


def test_tree_sizes_add_up():
    points = np.random.default_rng(1).normal(size=(64, 3))
    tree = grow_tree(points, 0, 42, 6)
    inner = tree[tree.feature >= 0]
    assert (tree["size"].to_numpy()[inner.left] + tree["size"].to_numpy()[inner.right] == inner["size"]).all()
    assert tree["size"][0] == 64 and tree["depth"].max() <= 6


def test_samples_have_exact_size(points):
    drawn = tree_samples(points, "event_uid", 20, 64, 1501, 42)
    sizes = {r["count"] for r in drawn.groupBy("tree_id").count().collect()}
    assert sizes == {64} and drawn.select("tree_id", "event_uid").distinct().count() == 20 * 64
    small = tree_samples(points, "event_uid", 2, 8, 1501, 42)
    assert {r["count"] for r in small.groupBy("tree_id").count().collect()} == {8}


def test_trees_draw_from_all_rows_of_a_large_table(spark):
    drawn = tree_samples(spark.range(60_000).withColumnRenamed("id", "event_uid"), "event_uid", 150, 256, 60_000, 42).cache()
    assert {r["count"] for r in drawn.groupBy("tree_id").count().collect()} == {256}
    ids = drawn.select("event_uid").distinct()
    assert ids.count() > 25_000 and ids.agg(F.avg("event_uid")).first()[0] == pytest.approx(30_000, rel=0.02)


def test_a_tree_is_offered_its_share_of_rows_and_a_row_no_tree_twice(spark):
    df = spark.range(20_000).withColumn("trees", offers(F.col("id"), 30, 0.05, 7))
    assert df.filter(F.size(F.array_distinct("trees")) != F.size("trees")).count() == 0
    per_tree = {r["tree"]: r["count"] for r in df.select(F.explode("trees").alias("tree")).groupBy("tree").count().collect()}
    assert sorted(per_tree) == list(range(30)) and all(800 < n < 1200 for n in per_tree.values())
    per_row = df.select(F.coalesce(F.size("trees"), F.lit(0)).alias("n")).groupBy("n").count().collect()
    for r in per_row:
        if r["n"] <= 4:  # binomial
            want = 20_000 * math.comb(30, max(r["n"], 0)) * 0.05 ** max(r["n"], 0) * 0.95 ** (30 - max(r["n"], 0))
            assert r["count"] == pytest.approx(want, rel=0.1)


def test_stacked_trees_equal_one_by_one():
    import pandas as pd

    rng = np.random.default_rng(5)
    data = np.round(rng.normal(size=(300, 5)), 1)
    trees = tree_arrays(pd.concat([grow_tree(data[rng.integers(0, 300, 64)], t, 3, 6) for t in range(25)]))
    trees += tree_arrays(grow_tree(np.ones((4, 5)), 99, 3, 6))  # a tree of one leaf
    batch = np.concatenate([data, rng.normal(size=(200, 5)) * 9, np.full((1, 5), np.inf)])
    assert Stacked.of(trees).mean_paths(batch, cells=400) == pytest.approx(mean_paths(trees, batch))


def test_fit_does_not_depend_on_partitions(points, forest):
    again = fit_forest(points.repartition(13), NAMES, CONFIG)
    assert forest.nodes.equals(again.nodes) and forest.offset == again.offset


def test_scores(points, forest):
    rows = score(points, forest).select("event_uid", "anom_score").collect()
    scores = {r["event_uid"]: r["anom_score"] for r in rows}
    assert 9999 in sorted(scores, key=scores.get)[-8:]  # few trees have seen it
    assert all(-1 < s < 1 for s in scores.values())
    share = sum(s > 0 for s in scores.values()) / len(scores)
    assert share == pytest.approx(CONFIG.contamination, abs=0.01)


def test_score_equals_a_walk_down_the_trees(points, forest):
    row = points.filter("event_uid = 9999").withColumn("s", isolation(forest)).first()
    total = 0.0
    for _, tree in forest.nodes.groupby("tree_id"):
        nodes = tree.set_index("node_id")
        at = 0
        while nodes.feature[at] >= 0:
            name = NAMES[nodes.feature[at]]
            value = (row[name] - forest.scaler.centers[name]) / forest.scaler.scales[name]
            at = nodes.left[at] if value <= nodes.split[at] else nodes.right[at]
        total += nodes.depth[at] + float(mean_depth(nodes["size"][at]))
    assert row["s"] == pytest.approx(2 ** (-total / 20 / float(mean_depth(64))))


def test_save_and_load(spark, points, forest, tmp_path):
    forest.save(spark, str(tmp_path / "m"))
    loaded = Forest.load(spark, str(tmp_path / "m"))
    assert loaded.config == forest.config and set(loaded.features) == set(NAMES)
    a = {r["event_uid"]: r["anom_score"] for r in score(points, forest).collect()}
    b = {r["event_uid"]: r["anom_score"] for r in score(points, loaded).collect()}
    assert a == pytest.approx(b)


def test_coercion_and_column_choice(spark):
    df = spark.createDataFrame([("1.5", 2, None, "s"), ("x", 3, 1.0, "t")], "a string, b int, c double, session_id string")
    assert numeric_features(df) == ["b", "c"]
    rows = coerce_features(df, ["a", "b", "c", "d"]).orderBy("b").collect()
    assert [(r["a"], r["b"], r["c"], r["d"]) for r in rows] == [(1.5, 2.0, 0.0, 0.0), (0.0, 3.0, 1.0, 0.0)]


def test_empty_training_table_is_an_error(points):
    with pytest.raises(ValueError):
        fit_forest(points.filter("false"), NAMES, CONFIG)


def brute_shapley(trees, x):
    """Shapley values by all subsets, each valued by the cover-weighted walk."""

    def value(tree, known, node=0):
        f = tree["feature"][node]
        if f < 0:
            return tree["path"][node]
        left, right = tree["left"][node], tree["right"][node]
        if f in known:
            return value(tree, known, left if x[f] <= tree["split"][node] else right)
        share = tree["size"][left] / tree["size"][node]
        return share * value(tree, known, left) + (1 - share) * value(tree, known, right)

    def total(known):
        return sum(value(t, known) for t in trees) / len(trees)

    d = len(x)
    phi = np.zeros(d)
    for j in range(d):
        others = [i for i in range(d) if i != j]
        for k in range(d):
            for subset in itertools.combinations(others, k):
                weight = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
                phi[j] += weight * (total({*subset, j}) - total(set(subset)))
    return phi, total(set())


def test_contributions_equal_brute_force_and_add_up():
    import pandas as pd

    rng = np.random.default_rng(4)
    data = rng.normal(size=(64, 4))
    data[:, 3] = np.round(data[:, 3])
    trees = tree_arrays(pd.concat([grow_tree(data, t, 7, 5) for t in range(6)]))
    groups, sample = leaf_paths(trees), data[:5]
    phi, base = contributions(groups, sample)
    for x, mine in zip(sample, phi):
        expected, expected_base = brute_shapley(trees, x)
        assert mine == pytest.approx(expected, abs=1e-9) and base == pytest.approx(expected_base)
    assert base + phi.sum(axis=1) == pytest.approx(mean_paths(trees, sample))


def test_explanation_names_the_cause(points, forest):
    row = explain_by_shap(points.filter("event_uid = 9999"), forest, k=2).first()
    assert {x["feature"] for x in row["top_features"]} == {"x", "y"}
    assert all(x["value"] < 0 for x in row["top_features"])
