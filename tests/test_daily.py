"""Summaries of days, runs that are taken up again, and logs over New Year."""

import datetime as dt
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.model.forest import ForestConfig
from sentrylake.operators import daily
from sentrylake.operators.evidence import Run
from sentrylake.operators.quantiles import exact_quantiles
from sentrylake.plans import run as stages
from sentrylake.plans.resume import finished, folder_digest, resume
from sentrylake.plans.run import Settings, featurize
from sentrylake.sources.logs import read_logs
from sentrylake.sources.store import write_days, write_store

from test_jsonl import WINDOWS
from test_logs import AUTH

START = dt.datetime(2025, 1, 1)


def scored(spark, seed, n=600, days=6, ties=False):
    deal = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + dt.timedelta(seconds=deal.randrange(days * 86400))
        value = deal.choice([None, float("nan"), 1.0, 2.0, 2.0, 3.0]) if ties else deal.gauss(0, 5)
        rows.append((str(i), at, deal.choice([None, *[f"h{k}" for k in range(30)]]), value))
    return spark.createDataFrame(rows, "event_uid string, event_ts timestamp, host_name string, anom_score double").withColumn("dt", F.to_date("event_ts"))


def test_only_changed_days_are_read_again(spark, tmp_path):
    table, days = str(tmp_path / "t"), str(tmp_path / "d")
    rows = scored(spark, 1)
    write_days(rows, table, ["dt"])
    assert len(daily.refresh_days(spark, table, days)) == 6 and daily.refresh_days(spark, table, days) == []
    third = F.col("dt") == F.lit("2025-01-03").cast("date")
    time.sleep(0.01)
    write_days(rows.filter(third).limit(5), table, ["dt"])
    assert daily.refresh_days(spark, table, days) == ["2025-01-03"]
    got = {str(r["dt"]): r["n_rows"] for r in daily.days_between(spark, days).collect()}
    assert got == {str(r["dt"]): r["count"] for r in spark.read.parquet(table).groupBy("dt").count().collect()}
    import shutil

    shutil.rmtree(f"{table}/dt=2025-01-06")
    assert daily.refresh_days(spark, table, days) == ["2025-01-06"] and daily.refresh_days(spark, table, days) == []
    assert daily.days_between(spark, days).count() == 5


def test_overview_of_a_span(spark, tmp_path):
    table, days = str(tmp_path / "t"), str(tmp_path / "d")
    rows = scored(spark, 2).cache()
    write_days(rows, table, ["dt"])
    daily.refresh_days(spark, table, days)
    own = rows.filter("dt BETWEEN '2025-01-02' AND '2025-01-04'")
    got = daily.overview_of_days(daily.days_between(spark, days, "2025-01-02", "2025-01-04")).first()
    want = own.agg(F.count("*"), F.max("anom_score"), F.min("event_ts"), F.max("event_ts")).first()
    assert tuple(got)[:4] == tuple(want) and got["n_hosts"] == 31
    none = daily.overview_of_days(daily.days_between(spark, days, "2030-01-01")).first()
    assert (none["n_rows"], none["n_hosts"], none["max_score"]) == (0, 0, None)


def test_distinct_hosts_within_the_stated_error(spark):
    rows = spark.range(60_000).select(
        F.lit("2025-01-01").cast("date").alias("dt"), F.lit(START).alias("event_ts"), F.concat(F.lit("h"), F.col("id") % 20_000).alias("host_name"),
        F.col("id").cast("double").alias("anom_score"),
    )
    assert daily.overview_of_days(daily.summarize(rows)).first()["n_hosts"] == pytest.approx(20_000, rel=0.04)


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("spread", [0.02, 1e-9])
def test_quantile_of_days_is_exact(spark, monkeypatch, ties, spread):
    monkeypatch.setattr(daily, "SPREAD", spread)  # a bracket that is too narrow is widened
    rows = scored(spark, 3, 900, ties=ties).cache()
    days = daily.summarize(rows).cache()
    some = days.filter("dt >= '2025-01-03'")
    values = [r["anom_score"] for r in rows.filter("dt >= '2025-01-03'").collect() if r["anom_score"] is not None and r["anom_score"] == r["anom_score"]]
    for p in (0.0, 0.5, 0.95, 1.0):
        assert daily.quantile_of_days(rows, some, p) == pytest.approx(np.quantile(values, p), abs=1e-12)
    whole = exact_quantiles(rows.filter(~F.isnan("anom_score")), ["anom_score"], [0.9]).first()["q0"]
    assert daily.quantile_of_days(rows, days, 0.9) == pytest.approx(whole)
    assert daily.quantile_of_days(rows, days.limit(0), 0.5) is None


# --- runs that are taken up again


@pytest.fixture()
def settings(tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "windows_evtx.jsonl").write_text("\n".join(WINDOWS))
    (tmp_path / "raw" / "auth.log").write_text("\n".join(AUTH))
    return Settings(str(tmp_path / "raw"), str(tmp_path / "root"), 2025, top_n=2, forest=ForestConfig(n_estimators=5), sample_per_day=1000)


def test_a_run_is_taken_up_where_it_stopped(spark, settings, monkeypatch):
    run = Run("2025-10-02T00:00:00Z", "tester")

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(stages, "alerts", killed)
        with pytest.raises(RuntimeError):
            resume(spark, settings, run)
    model = folder_digest(spark, settings.path("model"))
    assert finished(spark, settings, "train") and not finished(spark, settings, "alerts")
    assert resume(spark, settings, run) == ["alerts", "bundles"]  # trains nothing
    assert folder_digest(spark, settings.path("model")) == model
    assert resume(spark, settings, run) == []
    alerts = sorted(map(str, spark.read.parquet(settings.path("alerts")).select("alert_id", "anom_score").collect()))
    assert resume(spark, settings, Run("2025-10-03T00:00:00Z", "tester")) == ["alerts", "bundles"]
    assert sorted(map(str, spark.read.parquet(settings.path("alerts")).select("alert_id", "anom_score").collect())) == alerts
    with open(os.path.join(settings.raw, "auth.log"), "a") as log:
        log.write("\nOct  3 10:00:00 web1 sshd[1]: Failed password for root from 10.0.0.9 port 22")
    assert resume(spark, settings, run) == ["ingest", "featurize", "train", "alerts", "bundles"]


def test_an_empty_run_writes_an_empty_sample(spark, settings):
    from sentrylake.schema import STORE_SCHEMA

    write_store(spark.createDataFrame([], STORE_SCHEMA), settings.path("ecs"))
    assert featurize(spark, settings).count() == 0
    sample = spark.read.parquet(settings.path("sample"))
    assert sample.count() == 0 and "event_ts" in sample.columns


# --- logs over New Year


def log_line(at, n):
    return f"{at:%b} {at.day:2d} {at:%H:%M:%S} web1 sshd[1]: line {n}"


@pytest.mark.parametrize("split", [200, 1 << 20])
def test_years_turn_inside_a_file(spark, tmp_path, split):
    times = [dt.datetime(2022, 11, 1) + dt.timedelta(days=5 * n) for n in range(170)]  # into 2025: two turns and more
    lines = [log_line(at, n) for n, at in enumerate(times)]
    lines[40:40] = ["no syslog line", ""]
    (tmp_path / "a.log").write_text("\n".join(lines))
    other = [dt.datetime(2025, 2, 1) + dt.timedelta(days=n) for n in range(20)]
    (tmp_path / "b.log").write_text("\n".join(log_line(at, n) for n, at in enumerate(other)))
    (tmp_path / "empty.log").write_text("nothing\n")
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, split)
    try:
        got = read_logs(spark, str(tmp_path), 2025, over_new_year=True).select("event_ts", "message", F.col("log_file_path").endswith("b.log").alias("b")).collect()
    finally:
        spark.conf.set(key, old)
    for second, want in ((False, times), (True, other)):
        found = sorted((int(r["message"].split()[-1]), r["event_ts"]) for r in got if r["b"] == second)
        assert found == list(enumerate(want))


def test_lines_a_little_out_of_order_round_new_year(spark, tmp_path):
    times = [dt.datetime(2024, 12, 31, 23, 59), dt.datetime(2025, 1, 1), dt.datetime(2024, 12, 31, 23, 59, 30), dt.datetime(2025, 1, 1, 0, 1)]
    (tmp_path / "a.log").write_text("\n".join(log_line(at, n) for n, at in enumerate(times)))
    got = read_logs(spark, str(tmp_path), 2025, over_new_year=True)
    assert [r["event_ts"] for r in got.orderBy("message").collect()] == times
    assert {r["event_ts"].year for r in read_logs(spark, str(tmp_path), 2025).collect()} == {2025}
