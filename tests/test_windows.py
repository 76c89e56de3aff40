"""Rolling counts and sessions against brute force, on data with hot keys and copies."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from sentrylake.operators.rolling import rolling_counts, rolling_rates
from sentrylake.operators.sessions import sessionize

FLAGS = ["login_failed", "conn_suspicious"]
START = dt.datetime(2025, 1, 1, 22, 0, 0)
SCHEMA = "event_uid bigint, event_ts timestamp, user_name string, login_failed int, conn_suspicious int"


def random_rows(n, seed):
    """A third of the rows share one key and one time; others cross midnight; some keys are null."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            user, at = "hot", START
        else:
            user = rng.choice(["hot", "a", "b", None])
            at = START + dt.timedelta(microseconds=rng.randrange(4 * 3600 * 1_000_000))
            if rng.random() < 0.5:
                at = at.replace(second=0, microsecond=0)
        rows.append((i, at, user, int(rng.random() < 0.4), int(rng.random() < 0.1)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("dt", F.to_date("event_ts"))


def brute_counts(rows, minutes, flag, daily):
    out = {}
    for uid, at, user, *flags in rows:
        low = at - dt.timedelta(minutes=minutes)
        out[uid] = float(sum(
            other[3 + flag] for other in rows
            if user is not None and other[2] == user and low < other[1] <= at and (not daily or other[1].date() == at.date())
        ))
    return out


@pytest.mark.parametrize("daily", [True, False])
@pytest.mark.parametrize("partitions", [1, 13])
def test_rolling_counts_equal_brute_force(spark, daily, partitions):
    rows = random_rows(400, seed=partitions)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = rolling_counts(
            frame(spark, rows).repartition(partitions), ["user_name"], FLAGS, [1, 5, 15, 90], reset_daily=daily
        ).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == len(rows)
    for w in (1, 5, 15, 90):
        for i, flag in enumerate(FLAGS):
            assert {r["event_uid"]: r[f"{flag}_count_{w}m"] for r in got} == brute_counts(rows, w, i, daily)
    assert all(r["login_failed_count_1m"] <= r["login_failed_count_5m"] <= r["login_failed_count_15m"] for r in got)


def test_window_is_open_at_its_start(spark):
    at = dt.datetime(2025, 1, 1, 10, 0, 0)
    times = [at, at + dt.timedelta(seconds=60), at + dt.timedelta(seconds=119, microseconds=999999)]
    got = rolling_counts(
        frame(spark, [(i, t, "u", 1, 0) for i, t in enumerate(times)]), ["user_name"], FLAGS, [1]
    ).orderBy("event_uid").collect()
    assert [r["login_failed_count_1m"] for r in got] == [1.0, 1.0, 2.0]


def test_rates(spark):
    rows = [(0, START, "u", 1, 0)]
    row = rolling_rates(rolling_counts(frame(spark, rows), ["user_name"], FLAGS, [5]), FLAGS, [5]).first()
    assert row["login_failed_rate_5m"] == pytest.approx(0.2)


def test_rolling_plan_has_no_single_partition_window(spark):
    plan = rolling_counts(frame(spark, random_rows(10, 1)), ["user_name"], FLAGS, [1, 5])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text and "CartesianProduct" not in text
    assert text.count("Window [") == 2  # times within a chunk, and one row per chunk


def test_long_windows_keep_short_chunks(spark):
    """One key, an event a minute for two days and a window of a day: no window group outgrows its chunk."""
    start = 1_735_689_600
    rows = [(i, dt.datetime.fromtimestamp(start + 60 * i, dt.timezone.utc), "u", int(i % 3 == 0)) for i in range(2880)]
    df = spark.createDataFrame(rows, "event_uid int, event_ts timestamp, user_name string, login_failed int")
    df = df.withColumn("dt", F.to_date("event_ts"))
    counted = rolling_counts(df, ["user_name"], ["login_failed"], [1440], reset_daily=False)
    got = {r["event_uid"]: r["login_failed_count_1440m"] for r in counted.collect()}
    flags = [f for *_, f in rows]
    assert got == {i: float(sum(flags[max(0, i - 1439) : i + 1])) for i in range(2880)}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    groups = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[(\w+)", plan)
    assert {order for _, order in groups} == {"t", "chunk"}
    assert all("chunk" in keys for keys, order in groups if order == "t")


def brute_sessions(rows, timeout, daily):
    last, ordinal, out = {}, {}, {}
    for uid, at, user, *_ in sorted(rows, key=lambda r: r[1]):
        key = (at.date() if daily else None, user or "")
        if key not in last or (at - last[key]) > dt.timedelta(seconds=timeout):
            ordinal[key] = ordinal.get(key, 0) + 1
        last[key] = at
        out[uid] = (key, ordinal[key])
    return out


@pytest.mark.parametrize("daily", [True, False])
@pytest.mark.parametrize("chunk", [1, 7, 600])
def test_sessions_equal_brute_force(spark, daily, chunk):
    rows = random_rows(400, seed=chunk)
    got = sessionize(
        frame(spark, rows), ["user_name"], 120, reset_daily=daily, dense=True, chunk_minutes=chunk
    ).collect()
    expected = brute_sessions(rows, 120, daily)
    assert {r["event_uid"]: r["session_ordinal"] for r in got} == {uid: o for uid, (_, o) in expected.items()}
    scope = (lambda key: key[0]) if daily else (lambda key: None)
    for r in got:
        key, _ = expected[r["event_uid"]]
        before = {v for v in expected.values() if scope(v[0]) == scope(key) and v[0] < key} if daily else {
            v for v in expected.values() if v[0][1] < key[1]}
        assert r["session_number"] == len(before) + r["session_ordinal"]


def test_gap_of_exactly_the_timeout_stays(spark):
    at = dt.datetime(2025, 1, 1, 10, 0, 0)
    times = [at, at + dt.timedelta(seconds=120), at + dt.timedelta(seconds=240, microseconds=1)]
    got = sessionize(frame(spark, [(i, t, "u", 0, 0) for i, t in enumerate(times)]), ["user_name"]).orderBy("event_uid")
    assert [r["session_ordinal"] for r in got.collect()] == [1, 1, 2]


def test_transport_splits_sessions_and_nulls_are_one_key(spark):
    at = dt.datetime(2025, 1, 1, 10, 0, 0)
    rows = [(1, at, "1.1.1.1", "tcp"), (2, at, "1.1.1.1", "udp"), (3, at, None, None), (4, at, None, None)]
    df = spark.createDataFrame(rows, "event_uid int, event_ts timestamp, source_ip string, network_transport string")
    df = df.withColumn("destination_ip", F.lit("2.2.2.2")).withColumn("dt", F.to_date("event_ts"))
    got = {r["event_uid"]: r["session_id"] for r in sessionize(df).collect()}
    assert len(set(got.values())) == 3 and got[3] == got[4]
    assert got[1] == "2025-01-01|1.1.1.1|2.2.2.2|tcp|1"


def test_session_shuffles_are_shared(spark):
    df = sessionize(frame(spark, random_rows(50, 2)), ["user_name"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df.collect()
        assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_that_are_small_only_as_files_are_not_broadcast(spark, tmp_path):
    """Files of a few MB hold events that are hundreds of MB as rows of counts."""
    i = F.col("id")
    made = spark.range(200_000).select(
        i.alias("event_uid"), F.timestamp_seconds(1735689600 + i % 80_000).alias("event_ts"), F.concat(F.lit("u"), i % 40).alias("user_name"),
        *[F.lit(1).alias(f) for f in FLAGS],
    )
    made.withColumn("dt", F.to_date("event_ts")).write.parquet(str(tmp_path / "events"))
    assert sum(f.stat().st_size for f in (tmp_path / "events").iterdir()) < 5_000_000
    stored = spark.read.parquet(str(tmp_path / "events"))
    counted = rolling_counts(sessionize(stored, ["user_name"]), ["user_name"], FLAGS, [5, 60], source=stored)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
