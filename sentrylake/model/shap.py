"""Feature contributions by path-dependent TreeSHAP (Lundberg et al. 2018)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.explain import top_features
from .forest import Forest, coerce_features, scaled_points, tree_arrays

BLOCK = 1_000_000


def leaf_paths(trees: list[dict[str, np.ndarray]]) -> dict[int, dict[str, np.ndarray]]:
    """All leaves of all trees, grouped by the number of distinct features on their path.

    Per leaf and feature: the interval (low, high] a point must lie in to follow the path, and the
    share of the training rows that follows it at the splits on that feature.
    """
    found: dict[int, list[tuple]] = {}
    for tree in trees:
        todo = [(0, {})]
        while todo:
            node, path = todo.pop()
            feature = int(tree["feature"][node])
            if feature < 0:
                found.setdefault(len(path), []).append((float(tree["path"][node]), path))
                continue
            cut = float(tree["split"][node])
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            for child, bounds in (
                (int(tree["left"][node]), (low, min(high, cut))),
                (int(tree["right"][node]), (max(low, cut), high)),
            ):
                cover = tree["size"][child] / tree["size"][node]
                todo.append((child, {**path, feature: (*bounds, share * cover)}))
    groups = {}
    for m, leaves in found.items():
        groups[m] = {
            "value": np.array([value for value, _ in leaves]) / len(trees),
            "feature": np.array([list(path) for _, path in leaves], dtype=int).reshape(len(leaves), m),
            "low": np.array([[b[0] for b in path.values()] for _, path in leaves]).reshape(len(leaves), m),
            "high": np.array([[b[1] for b in path.values()] for _, path in leaves]).reshape(len(leaves), m),
            "share": np.array([[b[2] for b in path.values()] for _, path in leaves]).reshape(len(leaves), m),
        }
    return groups


def contributions(groups: dict[int, dict[str, np.ndarray]], points: np.ndarray) -> tuple[np.ndarray, float]:
    """Shapley values of the mean path length per point and feature, and the base value.

    A leaf is worth its value times the product, over the features of its path, of 'follows' (known
    feature) or share (unknown). The Shapley value of one feature weighs the subsets of the others
    by size only, so the polynomial of the others' factors gives all subsets of a size at once.
    """
    phi = np.zeros(points.shape)
    base = 0.0
    for m, leaf in groups.items():
        base += float((leaf["value"] * leaf["share"].prod(axis=1)).sum())
        if m == 0:
            continue
        weights = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
        block = max(1, BLOCK // (len(leaf["value"]) * m))
        for start in range(0, len(points), block):
            rows = points[start : start + block]
            x = rows[:, leaf["feature"]]
            follows = ((x > leaf["low"]) & (x <= leaf["high"])).astype(float)
            for j in range(m):
                poly = [np.ones(follows.shape[:2])]
                for i in range(m):
                    if i == j:
                        continue
                    kept = [p * leaf["share"][:, i] for p in poly] + [0.0]
                    for k, p in enumerate(poly):
                        kept[k + 1] = kept[k + 1] + p * follows[:, :, i]
                    poly = kept
                inner = sum(w * p for w, p in zip(weights, poly))
                gain = inner * (follows[:, :, j] - leaf["share"][:, j]) * leaf["value"]
                for f in np.unique(leaf["feature"][:, j]):
                    phi[start : start + block, f] += gain[:, leaf["feature"][:, j] == f].sum(axis=1)
    return phi, base


def shap_values(forest: Forest) -> Column:
    """``array<double>``: contribution of each feature to the row's mean path length."""
    groups, matrix = leaf_paths(tree_arrays(forest.nodes)), scaled_points(forest)

    @F.pandas_udf("array<double>")
    def explain(*columns: pd.Series) -> pd.Series:
        return pd.Series(list(contributions(groups, matrix(columns))[0]))

    return explain(*[F.col(f) for f in forest.features])


def explain_by_shap(df: DataFrame, forest: Forest, k: int = 5) -> DataFrame:
    """Add ``top_features``: the ``k`` largest contributions. Negative ones shorten the path."""
    valued = coerce_features(df, forest.features).withColumn("_shap", shap_values(forest))
    values = {f: F.col("_shap")[i] for i, f in enumerate(forest.features)}
    return valued.withColumn("top_features", top_features(values, k)).drop("_shap")
