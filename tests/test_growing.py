"""Stores that grow: batches, arriving files, carried state, segments of context, skipped files."""

import datetime as dt
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from sentrylake.operators.alerts import alert_context
from sentrylake.operators.carried import advance, labelled_rows, late_rows, versions
from sentrylake.operators.rolling import rolling_counts
from sentrylake.operators.segments import alert_ranges, listed_pairs, segment_context, sweep
from sentrylake.operators.sessions import sessionize
from sentrylake.sources import skipping
from sentrylake.sources.batches import append_batch, drop_replaced, ledger, merge_batches, read_batches
from sentrylake.sources.jsonl import ZEEK_CONN, read_json_source
from sentrylake.sources.logs import read_logs
from sentrylake.sources.store import union_sources
from sentrylake.streaming.files import available, json_reader, log_reader

from test_jsonl import ZEEK
from test_logs import AUTH, CBS


def moments(spark, *times, host="h"):
    rows = [(dt.datetime.fromisoformat(t) if t else None, host) for t in times]
    return union_sources({"a": spark.createDataFrame(rows, "event_ts timestamp, host_name string")})


def held(spark, root):
    return sorted((r["source"], str(r["event_ts"]), r["event_uid"], r["host_name"]) for r in read_batches(spark, root).collect())


# --- batches


def test_a_batch_counts_once(spark, tmp_path):
    root = str(tmp_path)
    first = moments(spark, "2025-01-01 10:00:00", "2025-01-01 10:00:00", "2025-01-02 00:00:00", None)
    assert append_batch(first, root, "one").first()["n_rows"] == 3
    before = held(spark, root)
    for name in ("one", "one-again"):  # the same name, and the same rows under another
        assert append_batch(first, root, name).first()[1:3] == ((3, 0) if name == "one" else (0, 3))
        assert held(spark, root) == before
    more = append_batch(moments(spark, "2025-01-02 00:00:00", "2025-01-03 00:00:00", "2025-01-01 10:00:00"), root, "two").first()
    assert (more["n_rows"], more["n_known"]) == (1, 2) and len(held(spark, root)) == 4
    assert append_batch(moments(spark), root, "empty").first()["n_rows"] == 0
    assert ledger(spark, root).count() == 4
    with pytest.raises(ValueError):
        append_batch(first, root, "../x")


def test_what_a_killed_write_leaves_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    append_batch(moments(spark, "2025-01-01 10:00:00"), root, "one")
    half = tmp_path / "data" / "batch=two" / "source=a" / "dt=2025-01-09"
    source = next((tmp_path / "data" / "batch=one").rglob("*.parquet"))
    half.mkdir(parents=True)
    shutil.copy(source, half / "part-0.parquet")
    assert len(held(spark, root)) == 1
    from sentrylake.sources import batches

    def killed(*_, **__):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(batches, "_commit", killed)
        with pytest.raises(RuntimeError):
            append_batch(moments(spark, "2025-01-02 10:00:00", "2025-01-03 10:00:00"), root, "two")
    assert len(held(spark, root)) == 1
    append_batch(moments(spark, "2025-01-02 10:00:00", "2025-01-03 10:00:00"), root, "two")
    assert [time[:10] for _, time, *_ in held(spark, root)] == ["2025-01-01", "2025-01-02", "2025-01-03"]
    assert not half.exists()


def test_merged_batches_hold_the_same_rows(spark, tmp_path):
    root = str(tmp_path)
    for day in range(1, 5):
        append_batch(moments(spark, f"2025-01-0{day} 10:00:00", "2025-01-09 00:00:00"), root, f"day-{day}")
    before = held(spark, root)
    merge_batches(spark, root, "merged")
    assert held(spark, root) == before and {r["batch"] for r in read_batches(spark, root).select("batch").collect()} == {"merged"}
    assert append_batch(moments(spark, "2025-01-02 10:00:00"), root, "day-2").first()["batch"] == "day-2"
    assert append_batch(moments(spark, "2025-01-02 10:00:00"), root, "new").first()["n_rows"] == 0
    assert drop_replaced(spark, root) == [f"day-{d}" for d in range(1, 5)]
    assert held(spark, root) == before and drop_replaced(spark, root) == []


# --- arriving files


def test_files_in_drops_give_the_rows_of_one_batch(spark, tmp_path):
    raw, store, checkpoint = tmp_path / "raw", str(tmp_path / "store"), str(tmp_path / "checkpoint")
    json_of, log_of = json_reader(ZEEK_CONN), log_reader(2025, host="n")
    assert available(spark, "zeek_conn", str(raw / "zeek"), json_of, store, checkpoint) == []
    (raw / "zeek").mkdir(parents=True)
    (raw / "logs").mkdir()
    for drop in range(3):
        (raw / "zeek" / f"{drop}.jsonl").write_text("\n".join(ZEEK[drop::3]) + "\n{broken\n")
        (raw / "logs" / f"{drop}.log").write_text("\n".join((AUTH + CBS)[drop::3]))
        for again in range(2):
            found = available(spark, "zeek_conn", str(raw / "zeek"), json_of, store, checkpoint)
            found += available(spark, "syslog_auth", str(raw / "logs"), log_of, store, checkpoint, "*.log")
            assert len(found) == (0 if again else 2)
    columns = ["source", "event_ts", "event_id", "source_ip", "message", "event_outcome"]
    whole = union_sources({"zeek_conn": read_json_source(spark, str(raw / "zeek"), ZEEK_CONN), "syslog_auth": read_logs(spark, str(raw / "logs"), 2025, host="n")})
    want = sorted(map(str, whole.select(*columns).collect()))
    assert sorted(map(str, read_batches(spark, store).select(*columns).collect())) == want
    # the stream forgets that its last micro-batch was complete, as after a loss: it repeats it under the same number
    last = max((f for f in os.listdir(f"{checkpoint}/zeek_conn/commits") if f.isdigit()), key=int)
    os.remove(f"{checkpoint}/zeek_conn/commits/{last}")
    crc = f"{checkpoint}/zeek_conn/commits/.{last}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert available(spark, "zeek_conn", str(raw / "zeek"), json_of, store, checkpoint) == [f"zeek_conn-{int(last):09d}"]
    assert sorted(map(str, read_batches(spark, store).select(*columns).collect())) == want


def test_files_one_at_a_time(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for at, line in enumerate(ZEEK[:3]):
        (raw / f"{at}.jsonl").write_text(line)
    found = available(spark, "z", str(raw), json_reader(ZEEK_CONN), str(tmp_path / "s"), str(tmp_path / "c"), files_per_batch=1)
    assert found == [f"z-{n:09d}" for n in range(3)]


# --- carried state

SCHEMA = "event_uid bigint, event_ts timestamp, user_name string, source_ip string, destination_ip string, network_transport string, " \
    "login_failed int, conn_suspicious int"


def flows(seed, n=500, days=4):
    deal, start = random.Random(seed), dt.datetime(2025, 1, 1)
    rows = []
    for i in range(n):
        at = start + dt.timedelta(seconds=deal.randrange(days * 86400))
        if i % 3 == 0:  # a hot key, dense round midnight
            at = start + dt.timedelta(days=deal.randrange(1, days), seconds=deal.randrange(-200, 200))
        key = ("hot", "x", "tcp") if i % 3 == 0 else (deal.choice(["a", "b", None]), deal.choice("xy"), deal.choice(["tcp", "udp"]))
        rows.append((i, at, deal.choice(["u", "v", None]), *key, int(deal.random() < 0.4), int(deal.random() < 0.2)))
    return rows


LABELS = ["event_uid", "session_ordinal", "session_id", *[f"{f}_count_{w}m" for w in (5, 90, 2000) for f in ("login_failed", "conn_suspicious")]]
SETTINGS = {"timeout_seconds": 100, "windows": [5, 90, 2000]}


@pytest.mark.parametrize("seed", [1, 2])
def test_days_one_by_one_equal_all_at_once(spark, tmp_path, seed):
    rows, root = flows(seed), str(tmp_path)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("dt", F.to_date("event_ts"))
    for day in range(1, 5):
        own = df.filter(F.to_date("event_ts") == F.lit(f"2025-01-0{day}").cast("date"))
        for _ in range(2):  # a repeated batch changes nothing
            got = advance(own, root, f"day-{day}", dt.datetime(2025, 1, day + 1), **SETTINGS)
        assert got.count() == own.count()
    whole = sessionize(df, timeout_seconds=100, reset_daily=False)
    whole = rolling_counts(whole, ["user_name"], ["login_failed", "conn_suspicious"], [5, 90, 2000], reset_daily=False)
    assert sorted(map(tuple, labelled_rows(spark, root).select(*LABELS).collect())) == sorted(map(tuple, whole.select(*LABELS).collect()))
    assert [r["version"] for r in versions(spark, root).orderBy("version").collect()] == [1, 2, 3, 4]
    # only what a window can still reach is carried on
    reach = dt.datetime(2025, 1, 5) - dt.timedelta(minutes=2000)
    assert spark.read.parquet(f"{root}/points/version=4").filter(F.col("event_ts") <= reach).count() == 0


def test_late_events_are_kept_apart_and_a_killed_batch_is_repeated(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    rows = flows(3, 60, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    first, second = df.filter("event_ts < timestamp'2025-01-02'"), df.filter("event_ts >= timestamp'2025-01-02' AND event_ts < timestamp'2025-01-03'")
    advance(first, root, "one", dt.datetime(2025, 1, 2), **SETTINGS)
    from sentrylake.operators import carried

    def killed(*_, **__):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(carried, "rolling_counts", killed)
        with pytest.raises(RuntimeError):
            advance(second, root, "two", dt.datetime(2025, 1, 3), **SETTINGS)
    assert versions(spark, root).count() == 1
    early = first.limit(3)
    advance(second.unionByName(early), root, "two", dt.datetime(2025, 1, 3), **SETTINGS)
    assert late_rows(spark, root).count() == 3 and labelled_rows(spark, root).count() == first.count() + second.count()
    with pytest.raises(ValueError):
        advance(second, root, "three", dt.datetime(2025, 1, 2, 12), **SETTINGS)
    assert advance(df.limit(0), root, "nothing", dt.datetime(2025, 1, 4), **SETTINGS).count() == 0
    assert versions(spark, root).agg(F.max("until_us")).first()[0] == 1735948800000000


# --- segments


def storm(spark, seed, n_events=400, n_alerts=60):
    deal, start = random.Random(seed), dt.datetime(2025, 1, 1, 23, 30)
    times = [start + dt.timedelta(seconds=deal.randrange(3600 * 3)) for _ in range(n_events)]
    events = spark.createDataFrame([(i, t) for i, t in enumerate([*times, None])], "event_uid bigint, event_ts timestamp").withColumn("dt", F.to_date("event_ts"))
    chosen = [start + dt.timedelta(seconds=3000 + deal.randrange(300)) for _ in range(n_alerts)]
    chosen += deal.choices(times, k=5) + [times[0], times[0]] + [None]  # on events, twice the same, without time
    alerts = spark.createDataFrame([(f"a{i}", t) for i, t in enumerate(chosen)], "alert_id string, event_ts timestamp")
    return events, alerts


@pytest.mark.parametrize("salt", [1, 3])
def test_segments_list_the_same_pairs(spark, salt):
    events, alerts = storm(spark, salt)
    want = alert_context(events, alerts, 5)
    context = segment_context(events, alerts, 5, salt=salt)
    pairs = sorted((r["alert_id"], r["event_uid"]) for r in want.collect())
    got = listed_pairs(context, alert_ranges(alerts), 5)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((r["alert_id"], r["event_uid"]) for r in got.collect()) == pairs
    found = context.collect()
    assert len(found) == len({uid for _, uid in pairs}) < len(pairs) / 5  # each event once
    per_event = {uid: sum(u == uid for _, u in pairs) for _, uid in pairs}
    assert {r["event_uid"]: r["n_alerts"] for r in found} == per_event


def test_segments_of_touching_intervals(spark):
    start = dt.datetime(2025, 1, 1)
    alerts = spark.createDataFrame([("a", start), ("b", start + dt.timedelta(minutes=10))], "alert_id string, event_ts timestamp")
    covered = [r["n_alerts"] for r in sweep(alerts).orderBy("segment").collect()]
    assert covered == [1, 2, 1, 0]  # both ends belong to an interval, so they share one microsecond
    events = spark.createDataFrame([(i, start + dt.timedelta(minutes=m)) for i, m in enumerate([-6, -5, 0, 5, 6, 15, 16])], "event_uid bigint, event_ts timestamp")
    got = {r["event_uid"]: r["n_alerts"] for r in segment_context(events, alerts).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1}
    assert segment_context(events, alerts.limit(0)).count() == 0 and segment_context(events.limit(0), alerts).count() == 0


# --- skipped files


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("indexed")
    start = dt.datetime(2025, 1, 1)
    rows = [(start + dt.timedelta(minutes=7 * i), None if i % 50 == 0 else "hot" if i % 3 == 0 else f"h{i % 40}") for i in range(1200)]
    df = union_sources({"a": spark.createDataFrame(rows, "event_ts timestamp, host_name string")}).withColumn("event_uid", F.col("event_ts").cast("string"))
    store, index = str(root / "store"), str(root / "index")
    skipping.cluster_by_host(df, store, files=20)
    skipping.build_index(spark, store, index)
    return store, index, rows


def times_of(df):
    return sorted(r["event_ts"] for r in df.collect())


@pytest.mark.parametrize("host", ["hot", "h7", "h39", None, "nobody"])
def test_indexed_rows_equal_a_full_scan(spark, indexed, host):
    store, index, rows = indexed
    assert times_of(skipping.host_rows_indexed(spark, store, index, host)) == sorted(t for t, h in rows if h == host)
    span = dt.datetime(2025, 1, 2, 3), dt.datetime(2025, 1, 3, 4)
    got = skipping.host_rows_indexed(spark, store, index, host, *span)
    assert times_of(got) == sorted(t for t, h in rows if h == host and span[0] <= t <= span[1])


def test_fewer_files_are_read(spark, indexed):
    store, index, _ = indexed
    every = len(spark.read.parquet(store).inputFiles())
    of_host = len(skipping.host_rows_indexed(spark, store, index, "h7").inputFiles())
    of_day = len(skipping.host_rows_indexed(spark, store, index, "h7", dt.datetime(2025, 1, 2), dt.datetime(2025, 1, 2, 12)).inputFiles())
    assert 0 < of_day < of_host < every
    assert skipping.files_to_read(spark, store, index, "host_name", "nobody").count() < every / 4


def test_no_file_of_a_value_is_left_out(spark, indexed):
    store, index, _ = indexed
    held_by = spark.read.parquet(store).select("host_name", F.col("_metadata.file_path").alias("file")).distinct().collect()
    for host in {r["host_name"] for r in held_by}:
        named = {r["file"] for r in skipping.files_to_read(spark, store, index, "host_name", host).collect()}
        assert {r["file"] for r in held_by if r["host_name"] == host} <= named


def test_files_that_came_later_are_read(spark, indexed, tmp_path, monkeypatch):
    old, index, rows = indexed
    store = str(tmp_path / "store")
    new = union_sources({"b": spark.createDataFrame([(dt.datetime(2025, 1, 1), "h7")], "event_ts timestamp, host_name string")})
    skipping.cluster_by_host(new.withColumn("event_uid", F.lit("new")), store, files=1)
    assert skipping.host_rows_indexed(spark, store, index, "h7").count() == 1  # none of its files is in the index
    assert skipping.host_rows_indexed(spark, store, index, "h8").count() == 0
    monkeypatch.setattr(skipping, "MOST_PATHS", 1)
    assert times_of(skipping.host_rows_indexed(spark, old, index, "h7")) == sorted(t for t, h in rows if h == "h7")
