"""Queries over the stages of the whole run: events written to the store, each stage's table read back."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.evidence import Run
from ..plans.run import Settings, alerts, bundles, featurize, train
from ..schema import ID_COLUMNS, STORE_SCHEMA, feature_names
from ..session import new_folder
from ..sources.store import write_store
from .features import FEATURES_SQL
from .views import EVENTS_SQL, day_sql, events, report, ts_sql

NOW = "2025-01-01T00:00:00Z"


def _stored(spark: SparkSession, sf_dir: str) -> Settings:
    """The events in a new store, with their own ids."""
    settings = Settings(raw="", root=new_folder(spark, "analysis"), default_year=2024)
    v0 = events(spark, sf_dir).withColumn("source", F.lit("events"))
    write_store(
        v0.select(*[(F.col(f.name) if f.name in v0.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in STORE_SCHEMA]),
        settings.path("ecs"),
    )
    return settings


def stage_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table as the run writes it."""
    table = featurize(spark, _stored(spark, sf_dir))
    return report(table.withColumn("event_uid", F.col("event_uid").cast("bigint")).select(*ID_COLUMNS, *feature_names()))


STAGE_FEATURES = f"""
WITH {FEATURES_SQL}
SELECT event_uid, {ts_sql('event_ts')} AS event_ts, {day_sql()} AS dt, host_name, user_name, source_ip, destination_ip, session_id,
  {', '.join(feature_names())} FROM features"""


def stage_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts that the run writes after training on all features."""
    settings = _stored(spark, sf_dir)
    featurize(spark, settings)
    train(spark, settings)
    found = alerts(spark, settings, NOW)
    return report(found.select("alert_id", "event_ts", "host_name", "user_name", "anom_score", "threshold", "risk_level", "reason"))


def stage_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the evidence that the run writes: per alert and file its lines and bytes."""
    settings = _stored(spark, sf_dir)
    featurize(spark, settings)
    train(spark, settings)
    alerts(spark, settings, NOW)
    written = spark.read.text(bundles(spark, settings, Run(NOW, "analyst")))
    return report(
        written.groupBy("alert_id", "file_name").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("value")).alias("size"))
    )


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and days of the table that each stage writes, with a training sample of 20 rows a day."""
    settings = replace(_stored(spark, sf_dir), sample_per_day=20, max_scores=500)
    featurize(spark, settings)
    train(spark, settings)
    alerts(spark, settings, NOW)
    frames = []
    for name in ("ecs", "features", "sample", "scores", "scores_capped", "alerts"):
        rows = spark.read.parquet(settings.path(name))
        frames.append(rows.agg(F.count("*").alias("n_rows"), F.count_distinct("dt" if name != "scores_capped" else F.lit(1)).alias("n_days")).withColumn("stage", F.lit(name)))
    return report(reduce(DataFrame.unionByName, frames).filter("stage <> 'alerts'").unionByName(
        frames[-1].withColumn("n_days", F.lit(0)).filter("n_rows > 0")
    ))


STAGE_COUNTS = f"""
WITH {EVENTS_SQL}, days AS (SELECT dt, count(*) AS n FROM v0 GROUP BY dt), n AS (SELECT count(*) AS n, count(DISTINCT dt) AS d FROM v0)
SELECT stage, n AS n_rows, d AS n_days FROM n, (VALUES ('ecs'), ('features'), ('scores')) AS s(stage)
UNION ALL SELECT 'sample', CAST(sum(least(n, 20)) AS BIGINT), count(*) FROM days
UNION ALL SELECT 'scores_capped', least(n, 500), 1 FROM n
UNION ALL SELECT 'alerts', least(10, n), 0 FROM n"""

QUERIES = {
    "stage_counts": (stage_counts, STAGE_COUNTS),
    "stage_features": (stage_features, STAGE_FEATURES),
    "stage_alerts": (stage_alerts, None),
    "stage_bundles": (stage_bundles, None),
}
