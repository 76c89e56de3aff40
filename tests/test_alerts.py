import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sentrylake.catalog.alerts import alert_context_bucketed
from sentrylake.operators.alerts import (
    alert_context, alert_table, first_rows, host_list, last_rows, overview, rows_of_host, select_alerts, timeline,
)
from sentrylake.operators.explain import explain_by_size, triage

START = dt.datetime(2025, 1, 1, 23, 0, 0)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    # a third of the events in one five-minute bucket
    rows = [
        (i, START + dt.timedelta(seconds=rng.randrange(300) if i % 3 == 0 else rng.randrange(3 * 3600)),
         rng.choice(["h1", "h2", None]), float(rng.randrange(1000)))
        for i in range(600)
    ]
    rows += [(1000, START - dt.timedelta(minutes=5), "h1", 0.0), (1001, START + dt.timedelta(minutes=5), "h1", 0.0),
             (1002, START + dt.timedelta(minutes=5, microseconds=1), "h1", 0.0), (1003, START, "h1", 2000.0)]
    return spark.createDataFrame(rows, "event_uid int, event_ts timestamp, host_name string, score double").withColumn(
        "dt", F.to_date("event_ts")
    ).cache()


def pairs(context):
    return sorted((r["alert_id"], r["event_uid"]) for r in context.collect())


def brute(events, alerts, minutes):
    span = dt.timedelta(minutes=minutes)
    return sorted(
        (a["event_uid"], e["event_uid"]) for a in alerts.collect() for e in events.collect()
        if abs(e["event_ts"] - a["event_ts"]) <= span
    )


def test_context_equals_theta_join(spark, events):
    top = select_alerts(events, "score", 5)
    every = select_alerts(events, "score", None)
    for alerts in (top, every):
        for minutes in (5, 1, 90):
            expected = brute(events, alerts, minutes)
            for salt in (1, 4):
                assert pairs(alert_context(events, alerts, minutes, "event_uid", salt=salt)) == expected
    found = {e for a, e in pairs(alert_context(events, top, 5, "event_uid")) if a == 1003}
    assert {1000, 1001, 1003} <= found and 1002 not in found


def test_context_without_days(spark, events):
    top = select_alerts(events, "score", 3)
    assert pairs(alert_context(events.drop("dt"), top, 5, "event_uid")) == brute(events, top, 5)


def test_limited_alerts_are_broadcast_and_never_a_nested_loop(spark, events):
    limited = plan_of(alert_context(events, events.orderBy("score").limit(5), 5, "event_uid"))
    assert "BroadcastHashJoin" in limited
    assert "NestedLoop" not in limited and "Cartesian" not in limited


def test_many_alerts_are_a_salted_shuffled_join(spark, events):
    over = select_alerts(events, "score", None, contamination=0.5)
    assert over.count() > 200
    plan = plan_of(alert_context(events, over, 5, alert_id="event_uid", salt=8))
    assert "SortMergeJoin [_bucket" in plan and "_salt" in plan.split("SortMergeJoin [", 1)[1].split("]", 1)[0]
    assert "Broadcast" not in plan and "CartesianProduct" not in plan


def test_times_become_text_before_they_are_paired(spark, events, tmp_path):
    noted = events.withColumn("note", F.concat(F.lit("n"), "event_uid"))
    carried = alert_context(events, select_alerts(noted, "score", 5), 5, "event_uid", carry=["note"]).collect()
    assert carried and all(r["note"] == f"n{r['alert_id']}" for r in carried)
    rows = events.select(
        F.col("event_uid").cast("bigint").alias("event_id"), F.to_timestamp_ntz(F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("ts"),
        F.lit(7).cast("bigint").alias("user_id"), F.lit("view").alias("event_type"), F.col("score").alias("value"), F.lit('{"k": 3}').alias("props"),
    )
    rows.write.parquet(str(tmp_path / "events.parquet"))
    found = alert_context_bucketed(spark, str(tmp_path))
    assert "date_format" not in plan_of(found).split("SortMergeJoin", 1)[0]
    over = select_alerts(events, "score", None)
    got = {(r["alert_id"], r["event_uid"], r["alert_ts"], r["event_ts"]) for r in found.collect()}
    shown = {r["event_uid"]: r["event_ts"].strftime("%Y-%m-%d %H:%M:%S.%f") for r in events.collect()}
    assert got == {(a, e, shown[a], shown[e]) for a, e in brute(events, over, 5)}


def test_rows_of_a_host_are_filtered_in_the_scan(spark, events, tmp_path):
    events.write.parquet(str(tmp_path / "scores"))
    stored = spark.read.parquet(str(tmp_path / "scores"))
    found = rows_of_host(stored.withColumn("user_name", F.lit(None).cast("string")), "h1")
    assert "EqualTo(host_name,h1)" in plan_of(found).split("PushedFilters: [", 1)[1]
    unknown = rows_of_host(stored.withColumn("user_name", F.lit("u")), "unknown")
    assert unknown.count() == stored.filter("host_name IS NULL").count() > 0


def test_selection(spark, events):
    top = select_alerts(events, "score", 3).collect()
    assert top[0]["event_uid"] == 1003 and len(top) == 3
    scores = sorted((r["score"] for r in events.collect()), reverse=True)
    assert [r["score"] for r in top] == scores[:3]
    assert "TakeOrderedAndProject" in plan_of(select_alerts(events, "score", 3))


def test_rows_per_key_are_cut_before_the_shuffle(spark, events):
    latest = last_rows(events, "host_name", 10)
    assert plan_of(latest).count("WindowGroupLimit") == 2
    got = [r["event_uid"] for r in latest.filter("host_name = 'h1'").orderBy("position").collect()]
    mine = sorted((r for r in events.collect() if r["host_name"] == "h1"), key=lambda r: (r["event_ts"], r["event_uid"]))
    assert got == [r["event_uid"] for r in reversed(mine[-10:])]
    context = alert_context(events, select_alerts(events, "score", 2), 90, "event_uid")
    preview = first_rows(context, 20).groupBy("alert_id").agg(F.count("*").alias("n"), F.max("position").alias("p"))
    assert [(r["n"], r["p"]) for r in preview.collect()] == [(20, 20), (20, 20)]


def test_reports(spark, events):
    assert [r["host_name"] for r in host_list(events).collect()] == ["h1", "h2", "unknown"]
    named = events.withColumn("user_name", F.lit(None).cast("string"))
    unknown = rows_of_host(named, "unknown").collect()
    assert unknown and {r["user_name"] for r in unknown} == {"unknown"}
    assert overview(events, "score").first()["n_rows"] == 604
    times = [(r["event_ts"], r["event_uid"]) for r in timeline(events, "score").collect()]
    assert times == sorted(times)
    full = named.withColumn("source_ip", F.lit("1")).withColumn("destination_ip", F.lit("2"))
    assert alert_table(full, "score").filter("host_name is null or user_name is null").count() == 0


def test_explanation_and_triage(spark):
    row = (dt.datetime(2025, 1, 1, 1, 2, 3, 450000), "h", None, "1.1.1.1", "", 0.9, 2, -3.5, 2.0, None, 1.0, 0.5)
    df = spark.createDataFrame(
        [row], "event_ts timestamp, host_name string, user_name string, source_ip string, destination_ip string, "
        "anom_score double, a int, b double, c double, d double, e double, f double"
    )
    got = triage(explain_by_size(df, list("abcdef")), created_at="2025-01-01T00:00:00Z").first()
    assert [(x["feature"], x["value"]) for x in got["top_features"]] == [("b", -3.5), ("a", 2.0), ("c", 2.0), ("e", 1.0), ("f", 0.5)]
    assert got["reason"] == "b(-3.500), a(+2.000), c(+2.000), e(+1.000), f(+0.500)"
    assert (got["risk_level"], got["note"], got["created_at"]) == ("MEDIUM", "fallback_no_shap", "2025-01-01T00:00:00Z")
    assert [(x["type"], x["value"]) for x in got["iocs"]] == [("source.ip", "1.1.1.1"), ("host.name", "h")]
    assert "- Time: 2025-01-01 01:02:03.450000+00:00\n- Score: 0.9000\n" in got["markdown"]
    assert "User: None" in got["markdown"] and len(got["actions"]) == 3
    assert triage(explain_by_size(df, list("abcdef")), high=0.9).first()["risk_level"] == "HIGH"
