"""Isolation Forest (Liu, Ting, Zhou 2008) fitted and applied with Spark."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.values import number
from ..operators.quantiles import RobustScaler, exact_quantiles
from ..schema import ID_COLUMNS
from ..session import stage

NODE_SCHEMA = (
    "tree_id int, node_id int, feature int, split double, left int, right int, depth int, size int"
)


@dataclass(frozen=True)
class ForestConfig:
    """The default settings."""

    n_estimators: int = 150
    max_samples: int = 256
    contamination: float = 0.05
    random_state: int = 42


@dataclass(frozen=True)
class Forest:
    """A fitted forest. Its size depends on the settings only: at most trees x (2 x samples - 1) nodes."""

    features: list[str]
    scaler: RobustScaler
    nodes: pd.DataFrame
    samples: int
    offset: float
    config: ForestConfig

    def params(self) -> str:
        return json.dumps(asdict(self.config), sort_keys=True)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        rows = [(f, self.scaler.centers[f], self.scaler.scales[f]) for f in self.features]
        scale = spark.createDataFrame(rows, "feature string, center double, scale double")
        scale.withColumns(
            {"samples": F.lit(self.samples), "offset": F.lit(self.offset), "config": F.lit(self.params())}
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Forest":
        rows = spark.read.parquet(f"{path}/params").collect()  # one row per feature
        scaler = RobustScaler({r["feature"]: r["center"] for r in rows}, {r["feature"]: r["scale"] for r in rows})
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        return cls(
            [r["feature"] for r in rows], scaler, nodes, rows[0]["samples"], rows[0]["offset"],
            ForestConfig(**json.loads(rows[0]["config"])),
        )


def numeric_features(df: DataFrame) -> list[str]:
    """All numeric columns that do not identify a row."""
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in ID_COLUMNS
    ]


def coerce_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Every feature as a number: absent, null and non-numeric become 0.0."""
    return df.withColumns(
        {
            c: F.coalesce(number(F.col(c)), F.lit(0.0)) if c in df.columns else F.lit(0.0)
            for c in features
        }
    )


def mean_depth(n: np.ndarray | float) -> np.ndarray:
    """c(n): the mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    value = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, value))


def grow_tree(points: np.ndarray, tree_id: int, seed: int, depth_limit: int) -> pd.DataFrame:
    """One isolation tree: random feature among those that vary, random cut between min and max."""
    rng = np.random.default_rng([seed, tree_id])
    rows: list[list] = []
    todo = [(np.arange(len(points)), 0, -1, False)]
    while todo:
        members, depth, parent, is_right = todo.pop()
        node = len(rows)
        rows.append([tree_id, node, -1, 0.0, -1, -1, depth, len(members)])
        if parent >= 0:
            rows[parent][5 if is_right else 4] = node
        if depth >= depth_limit or len(members) <= 1:
            continue
        low, high = points[members].min(axis=0), points[members].max(axis=0)
        varying = np.flatnonzero(high > low)
        if not len(varying):
            continue
        feature = int(rng.choice(varying))
        cut = float(rng.uniform(low[feature], high[feature]))
        to_left = points[members, feature] <= cut
        if to_left.all():
            continue
        rows[node][2], rows[node][3] = feature, cut
        todo.append((members[~to_left], depth + 1, node, True))
        todo.append((members[to_left], depth + 1, node, False))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])


def _drawn(uid: Column, seed: int) -> Column:
    return F.xxhash64(uid, F.lit(seed), F.lit("offers")) / F.lit(2.0**64) + 0.5


def offered_rows(df: DataFrame, uid: str, trees: int, share: float, seed: int) -> DataFrame:
    """The rows for which ``offers`` is not null, by one hash of the id and nothing else."""
    return df.filter(_drawn(F.col(uid), seed) >= F.lit((1 - share) ** trees))


def offers(uid: Column, trees: int, share: float, seed: int) -> Column:
    """The trees that a row is offered to, each with probability ``share``; for most rows of a large table none.

    How many they are is binomial, so it is drawn by the inverse of that distribution from one hash of the id; which
    ones, from a second hash as a start and a step prime to their number. ``offered_rows`` are those that some tree draws.
    """
    chance, passed, limits = (1 - share) ** trees, 0.0, []
    for k in range(trees):
        passed += chance
        limits.append(passed)
        if 1 - passed < 1e-18:
            break
        chance *= (trees - k) / (k + 1) * share / (1 - share)
    drawn = _drawn(uid, seed)
    n = F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda limit: limit <= drawn))
    steps = [s for s in range(1, trees + 1) if math.gcd(s, trees) == 1]
    which = F.xxhash64(uid, F.lit(seed), F.lit("trees"))
    first, step = F.pmod(which, F.lit(trees)), F.get(F.array(*map(F.lit, steps)), F.pmod(F.shiftright(which, 20), F.lit(len(steps))).cast("int"))
    # an empty range if no tree is drawn: sequence(1, 0) would count down
    some = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda j: F.pmod(first + j * step, F.lit(trees)).cast("int"))
    return F.when(n > 0, some)


def tree_samples(df: DataFrame, uid: str, trees: int, samples: int, n: int, seed: int) -> DataFrame:
    """Each tree's own sample of ``samples`` rows of all, without replacement, as rows with ``tree_id``.

    A tree takes the rows of smallest hash of (id, tree) of those that are offered to it, somewhat more than
    ``samples``, which are written; should a tree get too few, twice as many are offered. Only a table not
    much larger than a sample is offered to every tree as a whole. The cut to ``samples`` is exact.
    """
    share = (samples + 6 * math.sqrt(samples) + 16) / max(n, 1)
    while True:
        if share >= 1.0:
            offered = df.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        else:
            some = offered_rows(df, uid, trees, share, seed)
            offered = some.withColumn("tree_id", F.explode(offers(F.col(uid), trees, share, seed)))
        offered = stage(offered.withColumn("_h", F.xxhash64(F.col(uid), F.col("tree_id"), F.lit(seed))), "tree-samples")
        full = offered.groupBy("tree_id").count().filter(F.col("count") >= min(samples, n)).count()
        if full == trees or share >= 1.0:
            break
        share *= 2
    rank = Window.partitionBy("tree_id").orderBy("_h", F.col(uid))
    # a stated number of partitions: AQE would put these few rows, and so all trees, into one task
    tasks = min(trees, df.sparkSession.sparkContext.defaultParallelism)
    return offered.repartition(tasks, "tree_id").withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= samples)


def fit_and_score(
    train: DataFrame, features: list[str] | None = None, config: ForestConfig = ForestConfig(),
    uid: str = "event_uid",
) -> tuple[Forest, DataFrame]:
    """The forest fitted on ``train``, and ``train`` with ``anom_score``, as a written table.

    Scaling, trees and offset come from all rows. Every row goes through the trees once: the offset is a
    quantile of the scores that are written.
    """
    features = features or numeric_features(train)
    rows = stage(coerce_features(train, features), "train")
    n = rows.count()
    if n == 0:
        raise ValueError("feature table is empty")
    scaler = RobustScaler.fit(rows, features)
    samples = min(config.max_samples, n)
    depth_limit = math.ceil(math.log2(max(samples, 2)))
    seed = config.random_state
    drawn = tree_samples(scaler.transform(rows.select(uid, *features)), uid, config.n_estimators, samples, n, seed)

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("_rank", kind="stable")
        return grow_tree(sample[features].to_numpy(float), int(sample["tree_id"].iloc[0]), seed, depth_limit)

    grown = drawn.groupBy("tree_id").applyInPandas(grow, NODE_SCHEMA)
    nodes = grown.toPandas().sort_values(["tree_id", "node_id"], ignore_index=True)
    bare = Forest(features, scaler, nodes, samples, 0.0, config)
    scored = stage(rows.withColumn("anom_score", isolation(bare)), "scored")
    trained = scored.select((-F.col("anom_score")).alias("score_samples"))
    offset = exact_quantiles(trained, ["score_samples"], [config.contamination]).first()["q0"]
    forest = Forest(features, scaler, nodes, samples, offset, config)
    return forest, scored.withColumn("anom_score", F.col("anom_score") + F.lit(offset))


def fit_forest(
    train: DataFrame, features: list[str] | None = None, config: ForestConfig = ForestConfig(),
    uid: str = "event_uid",
) -> Forest:
    """The forest of ``fit_and_score`` alone."""
    return fit_and_score(train, features, config, uid)[0]


def tree_arrays(nodes: pd.DataFrame) -> list[dict[str, np.ndarray]]:
    """Per tree the node columns as arrays, with the path length that each leaf stands for."""
    trees = []
    for _, tree in nodes.sort_values(["tree_id", "node_id"]).groupby("tree_id"):
        arrays = {c: tree[c].to_numpy() for c in ("feature", "split", "left", "right", "depth", "size")}
        arrays["path"] = arrays["depth"] + mean_depth(arrays["size"])
        trees.append(arrays)
    return trees


def mean_paths(trees: list[dict[str, np.ndarray]], batch: np.ndarray) -> np.ndarray:
    """Mean path length of each point over all trees, one vectorised step per tree level.

    Log features repeat a lot, so each distinct point of the batch is followed only once.
    """
    points, back = np.unique(batch, axis=0, return_inverse=True)
    total = np.zeros(len(points))
    rows = np.arange(len(points))
    for tree in trees:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(int(tree["depth"].max())):
            feature = tree["feature"][node]
            inner = feature >= 0
            go_left = points[rows, np.maximum(feature, 0)] <= tree["split"][node]
            node = np.where(inner, np.where(go_left, tree["left"][node], tree["right"][node]), node)
        total += tree["path"][node]
    return total[back.reshape(-1)] / len(trees)


@dataclass(frozen=True)
class Stacked:
    """All trees as one array of nodes, so that a batch goes down all of them together; leaves lead to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    below: np.ndarray  # (nodes, 2): where to go if not above the split, if above
    path: np.ndarray
    depth: int

    @classmethod
    def of(cls, trees: list[dict[str, np.ndarray]]) -> "Stacked":
        sizes = [len(tree["feature"]) for tree in trees]
        roots = np.cumsum([0, *sizes])[:-1]
        leaf = np.concatenate([tree["feature"] < 0 for tree in trees])
        itself = np.arange(len(leaf))
        left, right = (np.concatenate([tree[side] + root for tree, root in zip(trees, roots)]) for side in ("left", "right"))
        below = np.where(leaf[:, None], itself[:, None], np.column_stack([left, right]))
        feature, split, path = (np.concatenate([tree[name] for tree in trees]) for name in ("feature", "split", "path"))
        return cls(roots, np.maximum(feature, 0), split, below.ravel(), path, max(int(tree["depth"].max()) for tree in trees))

    def mean_paths(self, batch: np.ndarray, cells: int = 1 << 19) -> np.ndarray:
        """As the function of that name, in as many steps as the deepest tree has levels."""
        points, back = np.unique(batch, axis=0, return_inverse=True)
        total, step = np.zeros(len(points)), max(1, cells // len(self.roots))
        for start in range(0, len(points), step):
            part = points[start : start + step]
            flat, base = part.ravel(), np.arange(len(part))[:, None] * part.shape[1]
            node = np.repeat(self.roots[None, :], len(part), axis=0)
            for _ in range(self.depth):
                above = flat[base + self.feature[node]] > self.split[node]
                node = self.below[2 * node + above]
            total[start : start + step] = self.path[node].sum(axis=1)
        return total[back.reshape(-1)] / len(self.roots)


def scaled_points(forest: Forest) -> Callable[[tuple[pd.Series, ...]], np.ndarray]:
    """Feature series of one Arrow batch -> scaled matrix; nulls count as 0."""
    centers = np.array([forest.scaler.centers[f] for f in forest.features])
    scales = np.array([forest.scaler.scales[f] for f in forest.features])

    def matrix(columns: tuple[pd.Series, ...]) -> np.ndarray:
        raw = np.column_stack([c.to_numpy(dtype=float, na_value=0.0) for c in columns])
        return (np.nan_to_num(raw, nan=0.0, posinf=np.inf, neginf=-np.inf) - centers) / scales

    return matrix


def isolation(forest: Forest) -> Column:
    """2^(-E[h] / c(samples)) of the feature columns, in (0, 1); only these columns go to Python."""
    trees, matrix = Stacked.of(tree_arrays(forest.nodes)), scaled_points(forest)
    norm = float(mean_depth(forest.samples)) or 1.0

    @F.pandas_udf("double")
    def evaluate(*columns: pd.Series) -> pd.Series:
        return pd.Series(np.exp2(-trees.mean_paths(matrix(columns)) / norm))

    return evaluate(*[F.col(f) for f in forest.features])


def score(df: DataFrame, forest: Forest) -> DataFrame:
    """Add ``anom_score``: larger is more anomalous, above 0 for about the contamination share.

    The scores are lazy: a table that is read more than once should be written first.
    """
    return coerce_features(df, forest.features).withColumn("anom_score", isolation(forest) + F.lit(forest.offset))
