"""Files that keep arriving, from the raw folder to carried features."""

import datetime as dt
import json

from pyspark.sql import functions as F

from sentrylake.operators.carried import labelled_rows, late_rows
from sentrylake.operators.features import feature_table
from sentrylake.plans.arriving import featurize_arrived, ingest_arriving
from sentrylake.plans.run import Settings
from sentrylake.schema import feature_names
from sentrylake.sources.batches import read_batches


def record(day, minute, user="u", code=4625):
    data = {"TargetUserName": user, "IpAddress": "10.0.0.1", "CommandLine": f"run {minute}"}
    return json.dumps({"Event": {"System": {"Computer": "h", "EventID": code}, "EventData": data},
                       "@timestamp": f"2025-01-0{day}T{minute // 60:02d}:{minute % 60:02d}:00Z"})


def test_two_days_arrive_and_a_late_file(spark, tmp_path):
    raw = tmp_path / "raw" / "windows_evtx"
    raw.mkdir(parents=True)
    settings = Settings(str(tmp_path / "raw"), str(tmp_path / "root"), 2025)
    (raw / "a.jsonl").write_text("\n".join(record(1, m) for m in range(1420, 1440, 2)))
    assert {k: len(v) for k, v in ingest_arriving(spark, settings).items()} == {"windows_evtx": 1, "sysmon": 0, "zeek_conn": 0, "syslog_auth": 0}
    for _ in range(2):
        assert featurize_arrived(spark, settings, dt.datetime(2025, 1, 2)).count() == 10
    (raw / "b.jsonl").write_text("\n".join(record(2, m) for m in range(0, 20, 2)))
    (raw / "late.jsonl").write_text(record(1, 5, user="slow"))
    ingest_arriving(spark, settings)
    for _ in range(2):
        assert featurize_arrived(spark, settings, dt.datetime(2025, 1, 3)).count() == 10
    root = settings.path("carried")
    assert late_rows(spark, root).count() == 1
    store = read_batches(spark, settings.path("batches"))
    assert store.count() == 21
    columns = ["event_uid", "session_id", *feature_names()]
    whole = feature_table(store.filter(F.col("user_name") != "slow"), reset_daily=False).select(*columns)
    got = labelled_rows(spark, root).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert featurize_arrived(spark, settings, dt.datetime(2025, 1, 4)).count() == 0
