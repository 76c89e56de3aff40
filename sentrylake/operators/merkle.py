"""Evidence over a folder that grows: a hash tree whose nodes are kept.

A file's leaf is a hash of its path, SHA-256 and size. Leaves are grouped by the first DIGITS hex digits of the hash of
their path; a group's node is the hash of its leaves, and the node of each shorter prefix the hash of the nodes below
it, up to one root that stands for all files. ``update`` reads only files that are new or whose size or time
changed, and works out only the nodes above files that came, went or changed. ``proof`` gives what is needed, beside
a file's own record, to work out the root: a file that is in the root can be shown to be so without the others.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stage
from .evidence import hashed, hashed_empty

DIGITS = 4
FILES = "path string, sha256 string, size bigint, changed timestamp, key string"
NODES = "prefix string, digest string"
VERSIONS = "version bigint, root string, n_files bigint, n_hashed bigint, n_nodes bigint"


def versions(spark: SparkSession, tree: str) -> DataFrame:
    """One row per complete state: its root, the number of files, and of files and nodes hashed for it."""
    try:
        return spark.read.schema(VERSIONS).parquet(f"{tree}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSIONS)


def _last(spark: SparkSession, tree: str) -> int:
    return versions(spark, tree).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def _state(spark: SparkSession, tree: str, version: int, name: str, schema: str) -> DataFrame:
    if not version:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{tree}/{name}/version={version}")


def _listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``path``, ``size`` and time of change of all files that are not empty; they are not opened."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, size bigint, changed timestamp")
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def leaf(path: Column, sha256: Column, size: Column) -> Column:
    return F.sha2(F.concat_ws("\n", path, sha256, size.cast("string")), 256)


def _joined(order: str, digest: Column) -> Column:
    """Hash of the digests one after the other; a group holds few, as prefixes are of hashes."""
    held = F.sort_array(F.collect_list(F.struct(F.col(order), digest.alias("digest"))))
    return F.sha2(F.array_join(F.transform(held, lambda x: x["digest"]), ""), 256)


def update(spark: SparkSession, folder: str, tree: str, pattern: str = "*") -> DataFrame:
    """Bring the tree up to date with the folder; ``path``, ``sha256``, ``size`` of its files."""
    version = _last(spark, tree)
    known = _state(spark, tree, version, "files", FILES)
    there = stage(_listed(spark, folder, pattern), "listed-files")
    same = there.join(known.select("path", "size", "changed", "sha256"), ["path", "size", "changed"])
    fresh = there.join(same.select("path"), "path", "left_anti")
    read = stage(hashed(fresh).join(fresh.select("path", "changed"), "path"), "hashed-files")
    empty = hashed_empty(spark, folder, pattern).withColumn("changed", F.lit(None).cast("timestamp"))
    columns = ["path", "sha256", "size", "changed"]
    files = same.select(*columns).unionByName(read.select(*columns)).unionByName(empty.select(*columns))
    files = stage(files.withColumn("key", F.sha2("path", 256)), "evidence-files")
    record = ["path", "sha256", "size", "key"]
    touched = files.select(*record).exceptAll(known.select(*record)).unionByName(known.select(*record).exceptAll(files.select(*record)))
    touched = stage(touched.select(F.substring("key", 1, DIGITS).alias("prefix")).distinct(), "touched-groups")

    nodes = _state(spark, tree, version, "nodes", NODES)
    below = files.withColumn("prefix", F.substring("key", 1, DIGITS)).join(touched, "prefix", "left_semi")
    made = [stage(below.groupBy("prefix").agg(_joined("key", leaf(F.col("path"), F.col("sha256"), F.col("size"))).alias("digest")), "tree-nodes")]
    for length in range(DIGITS - 1, -1, -1):
        changed = touched.select(F.substring("prefix", 1, length).alias("prefix")).distinct()
        old = nodes.filter(F.length("prefix") == length + 1).join(touched.select(F.substring("prefix", 1, length + 1).alias("prefix")).distinct(), "prefix", "left_anti")
        children = old.unionByName(made[-1]).withColumnRenamed("prefix", "child").withColumn("prefix", F.substring("child", 1, length))
        children = children.join(changed, "prefix", "left_semi")
        made.append(stage(children.groupBy("prefix").agg(_joined("child", F.col("digest")).alias("digest")), "tree-nodes"))
    new = made[0]
    for level in made[1:]:
        new = new.unionByName(level)
    stale = None
    for length in range(DIGITS + 1):
        own = touched.select(F.substring("prefix", 1, length).alias("prefix")).distinct()
        stale = own if stale is None else stale.unionByName(own)
    every = nodes.join(stale, "prefix", "left_anti").unionByName(new)
    files.write.mode("overwrite").parquet(f"{tree}/files/version={version + 1}")
    every.write.mode("overwrite").parquet(f"{tree}/nodes/version={version + 1}")
    root = _state(spark, tree, version + 1, "nodes", NODES).filter("prefix = ''").first()
    row = (version + 1, root["digest"] if root else hashlib.sha256().hexdigest(), files.count(), read.count(), new.count())
    spark.createDataFrame([row], VERSIONS).coalesce(1).write.mode("append").parquet(f"{tree}/versions")
    return _state(spark, tree, version + 1, "files", FILES).select("path", "sha256", "size")


def proof(spark: SparkSession, tree: str, path: str, version: int | None = None) -> list[list[str | None]]:
    """From the file's group up to the root, the digests hashed together; None where the file's own branch stands."""
    version = version or _last(spark, tree)
    files = _state(spark, tree, version, "files", FILES)
    key = hashlib.sha256(path.encode()).hexdigest()
    group = files.filter(F.startswith("key", F.lit(key[:DIGITS]))).orderBy("key")
    steps = [[None if r["path"] == path else r["d"] for r in group.select("path", leaf(F.col("path"), F.col("sha256"), F.col("size")).alias("d")).collect()]]
    if None not in steps[0]:
        raise KeyError(path)
    nodes = _state(spark, tree, version, "nodes", NODES)
    for length in range(DIGITS, 0, -1):
        beside = nodes.filter((F.length("prefix") == length) & F.startswith("prefix", F.lit(key[: length - 1]))).orderBy("prefix")
        steps.append([None if r["prefix"] == key[:length] else r["digest"] for r in beside.collect()])  # 16 at most
    return steps


def verify(path: str, sha256: str, size: int, steps: list[list[str | None]], root: str) -> bool:
    """Whether the file's record, with the digests of its proof, gives the root."""
    digest = hashlib.sha256(f"{path}\n{sha256}\n{size}".encode()).hexdigest()
    for step in steps:
        if step.count(None) != 1:
            return False
        digest = hashlib.sha256("".join(digest if d is None else d for d in step).encode()).hexdigest()
    return digest == root
