"""The whole analysis as stages that hand over Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model.forest import Forest, ForestConfig, fit_and_score, fit_forest, score
from ..model.shap import explain_by_shap
from ..operators.alerts import alert_context, select_alerts
from ..operators.evidence import (
    Run, bundle_documents, bundle_manifest, context_lines, custody_records, file_hashes, manifest_documents, run_records,
    write_bundle,
)
from ..operators.explain import triage
from ..operators.features import feature_table
from ..operators.merkle import update
from ..operators.quantiles import exact_quantiles
from ..operators.sampling import capped, sample_per_day
from ..session import stage
from ..sources.flows import flow_files, read_flows, skipped_files
from ..sources.jsonl import SYSMON, WINDOWS_EVTX, ZEEK_CONN, read_json_source
from ..sources.logs import read_logs
from ..sources.store import isolated, read_store, read_table, union_sources, write_days, write_store


@dataclass(frozen=True)
class Settings:
    """Where things lie and the settings of every stage."""

    raw: str
    root: str
    default_year: int
    tz: str = "UTC"
    host: str | None = None
    time_col: str | None = None
    time_unit: str | None = None  # of bare numbers in the time column of CSV files
    quoted_newlines: bool = False
    recursive: bool = True
    compression: str = "zstd"
    sample_per_day: int | None = None  # train on so many rows of a day, written as the table ``sample``; None: on all
    max_scores: int | None = None  # also write a copy of the scores of at most so many rows
    threshold_method: str = "quantile"
    top_n: int = 10
    context_minutes: int = 5
    high: float = 0.95
    medium: float = 0.85
    risk_by_rank: bool = True  # the cut-offs apply to the share of all scores below the alert's, not to the score
    forest: ForestConfig = field(default_factory=ForestConfig)

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"


def ingest(spark: SparkSession, settings: Settings) -> dict[str, str]:
    """Read every source into the store, replacing the days that occur; returns failed sources.

    Files that give no events are listed in the table ``skipped``.
    """
    raw = settings.raw.rstrip("/")
    readers = {
        source.name: lambda source=source: read_json_source(spark, f"{raw}/{source.file_name}", source)
        for source in (WINDOWS_EVTX, SYSMON, ZEEK_CONN)
    }
    readers["syslog_auth"] = lambda: read_logs(spark, raw, settings.default_year, settings.tz, settings.host)
    files = stage(flow_files(spark, raw, settings.time_col, settings.recursive), "flow-files")
    skipped_files(files).write.mode("overwrite").parquet(settings.path("skipped"))
    readers["custom_csv"] = lambda: read_flows(
        spark, raw, time_unit=settings.time_unit, recursive=settings.recursive, quoted_newlines=settings.quoted_newlines, files=files
    )
    frames, failures = isolated(readers)
    for name, frame in frames.items():
        # one write per source: a source that fails at run time leaves the others in place
        try:
            write_store(union_sources({name: frame}), settings.path("ecs"), compression=settings.compression)
        except Exception as error:  # noqa: BLE001
            failures[name] = str(error)
    return failures


def featurize(spark: SparkSession, settings: Settings) -> DataFrame:
    """Features of all days, and where its size is set the training sample, which may be empty."""
    features = feature_table(read_store(spark, settings.path("ecs")))
    write_days(features, settings.path("features"), ["dt"], ["event_ts"])
    table = spark.read.schema(features.schema).parquet(settings.path("features"))
    if settings.sample_per_day is not None:
        sample = sample_per_day(table, settings.sample_per_day, seed=settings.forest.random_state)
        sample.write.mode("overwrite").option("compression", settings.compression).parquet(settings.path("sample"))
    return table


def train(spark: SparkSession, settings: Settings) -> Forest:
    """Fit on all rows of the feature table and write their scores; on a sample only where its size is set."""
    table = read_table(spark, settings.path("features"))
    if settings.sample_per_day is not None:
        forest = fit_forest(read_table(spark, settings.path("sample")), config=settings.forest)
        scored = score(table, forest)
    else:
        forest, scored = fit_and_score(table, config=settings.forest)
    forest.save(spark, settings.path("model"))
    _write_scores(spark, settings, scored)
    return forest


def _write_scores(spark: SparkSession, settings: Settings, scored: DataFrame) -> DataFrame:
    write_days(scored, settings.path("scores"), ["dt"], ["event_ts"])
    table = read_table(spark, settings.path("scores"))
    if settings.max_scores is not None:
        few = capped(table, settings.max_scores, seed=settings.forest.random_state)
        few.write.mode("overwrite").parquet(settings.path("scores_capped"))
    return table


def score_all(spark: SparkSession, settings: Settings) -> DataFrame:
    """Scores of all days by the stored forest, for days that came after the training."""
    forest = Forest.load(spark, settings.path("model"))
    return _write_scores(spark, settings, score(read_table(spark, settings.path("features")), forest))


def alerts(spark: SparkSession, settings: Settings, created_at: str) -> DataFrame:
    """The top alerts with explanation and triage, written as a table."""
    forest = Forest.load(spark, settings.path("model"))
    scores = read_table(spark, settings.path("scores"))
    chosen = select_alerts(
        scores, "anom_score", settings.top_n, settings.threshold_method, settings.forest.contamination,
    )
    if settings.risk_by_rank:
        cuts = {"high": settings.high, "medium": settings.medium}
        limits = exact_quantiles(scores, ["anom_score"], list(cuts.values())).first()
        cuts = {name: limits[f"q{i}"] for i, name in enumerate(cuts)}
    else:
        cuts = {"high": settings.high, "medium": settings.medium}
    triaged = triage(explain_by_shap(chosen, forest), created_at=created_at, **cuts)
    triaged.withColumn("alert_id", F.concat_ws("-", F.lit("alert"), "event_uid")).write.mode("overwrite").parquet(
        settings.path("alerts")
    )
    return spark.read.parquet(settings.path("alerts"))


def bundles(spark: SparkSession, settings: Settings, run: Run) -> str:
    """Evidence of all alerts in one go: documents, context, a manifest per alert, file records, custody."""
    out = settings.path("bundles")
    forest = Forest.load(spark, settings.path("model"))
    found = spark.read.parquet(settings.path("alerts"))
    context = alert_context(
        read_store(spark, settings.path("ecs")), found.select("alert_id", "event_ts"), settings.context_minutes
    )
    lines = context_lines(context).select("alert_id", F.lit("raw_logs.jsonl").alias("file_name"), "content")
    inputs = update(spark, settings.path("ecs"), settings.path("evidence"), "*.parquet")  # only files that are new are read
    documents = bundle_documents(found, forest.features, params=forest.params())
    files = stage(documents.unionByName(lines), "bundle-files")
    content = files.unionByName(manifest_documents(bundle_manifest(files)))
    write_bundle(content.unionByName(run_records(inputs, "evidence_manifest.json")), out, mode="overwrite")
    sources = inputs.unionByName(file_hashes(spark, settings.path("scores"), "*.parquet"))
    outputs = file_hashes(spark, out, "*.txt")
    write_bundle(run_records(custody_records(sources, outputs, run), "coc.json"), out)
    manifest = file_hashes(spark, out, "*.txt")
    manifest.write.mode("overwrite").parquet(settings.path("manifest"))
    return out


def run_all(spark: SparkSession, settings: Settings, run: Run) -> str:
    """Ingest, features, training with scores, alerts, bundles."""
    ingest(spark, settings)
    featurize(spark, settings)
    train(spark, settings)
    alerts(spark, settings, run.created_at)
    return bundles(spark, settings, run)
