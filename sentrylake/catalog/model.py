"""Queries over the model. Random trees have no SQL form: these are covered by property tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model.forest import Forest, fit_and_score
from ..model.shap import explain_by_shap
from ..operators.alerts import select_alerts
from ..operators.features import feature_table
from ..schema import feature_names
from .views import events, report


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[Forest, DataFrame]:
    return fit_and_score(feature_table(events(spark, sf_dir)), feature_names())


def iforest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scored = _fitted(spark, sf_dir)
    return report(scored.select("event_uid", "event_ts", "host_name", "anom_score"))


def iforest_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset, and the share of rows that score above 0 with it."""
    forest, scored = _fitted(spark, sf_dir)
    return report(
        scored.agg(
            F.lit(forest.offset).alias("offset"), F.lit(forest.samples).alias("samples"),
            F.avg((F.col("anom_score") > 0).cast("double")).alias("share_over_zero"),
        )
    )


def tree_shap_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contributions to the top alerts of the forest."""
    forest, scored = _fitted(spark, sf_dir)
    explained = explain_by_shap(select_alerts(scored), forest)
    top = explained.select("event_uid", "anom_score", F.posexplode("top_features").alias("rank", "top"))
    return report(
        top.select("event_uid", "anom_score", (F.col("rank") + 1).alias("rank"),
                   F.col("top.feature").alias("feature"), F.col("top.value").alias("value"))
    )


QUERIES = {
    "iforest_scores": (iforest_scores, None),
    "iforest_offset": (iforest_offset, None),
    "tree_shap_explain": (tree_shap_explain, None),
}
