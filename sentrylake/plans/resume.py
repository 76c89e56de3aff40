"""The whole analysis, taken up where it stopped.

A ledger has one row per finished stage: a digest of what the stage read, and of its settings. A rerun skips stages
whose digest is the same and begins at the first that differs, or that never finished. Digests are of the names,
sizes and times of the files, which are listed, not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession, functions as F

from ..operators.evidence import Run
from . import run as stages
from .run import Settings


def folder_digest(spark: SparkSession, path: str) -> str:
    """One text for the state of a folder of files; ``none`` if it is not there."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return "none"
    row = files.agg(
        F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0))
    ).first()
    return "-".join(map(str, row))


def _ledger_path(settings: Settings, name: str) -> str:
    return f"{settings.path('stages')}/stage={name}"


def finished(spark: SparkSession, settings: Settings, name: str) -> str | None:
    """The digest under which a stage has finished."""
    try:
        row = spark.read.schema("digest string").parquet(_ledger_path(settings, name)).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row["digest"] if row else None


def resume(spark: SparkSession, settings: Settings, run: Run) -> list[str]:
    """Run the stages whose input or settings changed, and all that follow from them; the names of those that ran.

    A stage is noted as finished after it has written everything, so one that was killed runs again as a whole.
    """
    model = replace(settings, threshold_method="", top_n=0, high=0.0, medium=0.0, risk_by_rank=False, context_minutes=0)
    reading = replace(model, sample_per_day=None, max_scores=None, forest=Settings.__dataclass_fields__["forest"].default_factory())
    plan: list[tuple[str, list[str], object, Callable[[], object]]] = [
        ("ingest", [settings.raw], reading, lambda: stages.ingest(spark, settings)),
        ("featurize", [settings.path("ecs")], model.sample_per_day, lambda: stages.featurize(spark, settings)),
        ("train", [settings.path("features")], model, lambda: stages.train(spark, settings)),
        ("alerts", [settings.path("scores"), settings.path("model")], (settings, run.created_at), lambda: stages.alerts(spark, settings, run.created_at)),
        ("bundles", [settings.path("alerts"), settings.path("ecs")], (settings, run), lambda: stages.bundles(spark, settings, run)),
    ]
    ran = []
    for name, inputs, said, work in plan:
        state = [repr(said), *(folder_digest(spark, path) for path in inputs)]
        digest = hashlib.sha256("\n".join(state).encode()).hexdigest()
        if finished(spark, settings, name) == digest:
            continue
        work()
        spark.createDataFrame([(digest,)], "digest string").coalesce(1).write.mode("overwrite").parquet(_ledger_path(settings, name))
        ran.append(name)
    return ran
