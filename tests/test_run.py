"""The whole analysis on a few hand-made files."""

import json

import pytest
from pyspark.sql import functions as F

from sentrylake.model.forest import ForestConfig
from sentrylake.operators.evidence import Run
from sentrylake.plans.run import Settings, ingest, run_all
from sentrylake.sources.store import read_store

from test_jsonl import FLOWS, LOGONS, WINDOWS, ZEEK
from test_logs import AUTH, CBS

FAILED_LOGS = [AUTH[0], AUTH[2], CBS[0]]  # the lines that the log parser calls a failure


@pytest.fixture(scope="module")
def settings(tmp_path_factory):
    raw, root = tmp_path_factory.mktemp("raw"), tmp_path_factory.mktemp("root")
    (raw / "windows_evtx.jsonl").write_text("\n".join(WINDOWS))  # sysmon.jsonl is missing on purpose
    (raw / "zeek_conn.jsonl").write_text("\n".join(ZEEK))
    (raw / "auth.log").write_text("\n".join(AUTH + CBS))
    (raw / "notes.csv").write_text("a,b\n1,2\n")
    (raw / "flows.csv").write_text("timestamp,src_ip,dst_ip,dst_port\n" + "".join(
        f"2025-10-01 09:{i:02d}:00,10.0.0.{i},10.0.1.1,{4444 if i == 5 else 80}\n" for i in range(40)))
    return Settings(str(raw), str(root), 2025, top_n=3, forest=ForestConfig(n_estimators=25))


def test_ingest_is_repeatable(spark, settings):
    for _ in range(2):
        assert ingest(spark, settings) == {}
        counts = {r["source"]: r["count"] for r in read_store(spark, settings.path("ecs")).groupBy("source").count().collect()}
        assert counts == {"windows_evtx": 7, "zeek_conn": 6, "syslog_auth": 7, "custom_csv": 40}


def test_run_all(spark, settings):
    out = run_all(spark, settings, Run("2025-10-02T00:00:00Z", "tester"))
    features = spark.read.parquet(settings.path("features"))
    scores = spark.read.parquet(settings.path("scores"))
    alerts = spark.read.parquet(settings.path("alerts"))
    assert features.count() == scores.count() == 60
    failed = sum(code == 4625 for _, _, _, code, *_ in LOGONS) + sum("ailed" in line or "ailure" in line for line in FAILED_LOGS)
    suspicious = sum(port == 4444 or state == "S0" for *_, port, state in FLOWS) + 1
    assert features.agg(F.sum("login_failed"), F.sum("conn_suspicious")).first()[:] == (failed, suspicious)
    skipped = {r["file_path"].rsplit("/", 1)[1]: r["status"] for r in spark.read.parquet(settings.path("skipped")).collect()}
    assert skipped == {"notes.csv": "no time column"}
    assert 1 <= alerts.count() <= 3
    assert {r["risk_level"] for r in alerts.collect()} == {"HIGH"}  # above 95 of 100 scores
    files = spark.read.text(out)
    names = {(r["alert_id"], r["file_name"]) for r in files.select("alert_id", "file_name").distinct().collect()}
    per_alert = {"raw_logs.jsonl", "features.json", "shap_explanation.json", "model_meta.json", "ai_analysis.json", "ai_analysis.md", "manifest.json"}
    expected = {(r["alert_id"], f) for r in alerts.collect() for f in per_alert}
    assert names == expected | {("run", "evidence_manifest.json"), ("run", "coc.json")}
    meta = json.loads(files.filter("file_name = 'model_meta.json'").first()["value"])
    assert meta["algorithm"] == "IsolationForest" and meta["alert_score"] >= meta["score_threshold"]
    custody = [json.loads(r["value"]) for r in files.filter("file_name = 'coc.json'").collect()]
    assert {r["operator"] for r in custody} == {"tester"} and {r["role"] for r in custody} == {"input", "output"}
    manifest = spark.read.parquet(settings.path("manifest"))
    assert manifest.filter(F.col("path").contains("coc.json")).count() >= 1
    assert manifest.filter(F.length("sha256") == 64).count() == manifest.count()
