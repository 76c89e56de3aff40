import datetime as dt

import pytest

from sentrylake.sources.store import available_days, isolated, read_store, read_table, union_sources, with_event_uid, write_store


def events(spark, *times, host="h"):
    rows = [(dt.datetime.fromisoformat(t) if t else None, host) for t in times]
    return spark.createDataFrame(rows, "event_ts timestamp, host_name string")


def counts(spark, path):
    return {(r["source"], str(r["dt"])): r["n_rows"] for r in available_days(read_store(spark, path)).collect()}


def test_overwrite_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "ecs")
    write_store(union_sources({"a": events(spark, "2025-01-01 10:00:00", "2025-01-01 11:00:00", "2025-01-02 00:00:00", None),
                               "b": events(spark, "2025-01-01 10:00:00")}), path)
    assert counts(spark, path) == {("a", "2025-01-01"): 2, ("a", "2025-01-02"): 1, ("b", "2025-01-01"): 1}
    write_store(union_sources({"a": events(spark, "2025-01-01 12:00:00")}), path)
    assert counts(spark, path) == {("a", "2025-01-01"): 1, ("a", "2025-01-02"): 1, ("b", "2025-01-01"): 1}
    write_store(union_sources({"a": events(spark, "2025-01-01 12:00:00")}), path, mode="append")
    assert counts(spark, path)["a", "2025-01-01"] == 2


def test_exact_copies_get_their_own_id(spark, tmp_path):
    path = str(tmp_path / "ecs")
    write_store(union_sources({"a": events(spark, *["2025-01-01 10:00:00"] * 50)}), path)
    assert read_store(spark, path).select("event_uid").distinct().count() == 50


def test_ids_do_not_depend_on_splits(spark):
    base = events(spark, *["2025-01-01 10:00:00"] * 300, *[f"2025-01-02 10:00:{i:02d}" for i in range(60)])
    one, many = (
        sorted(r["event_uid"] for r in with_event_uid(union_sources({"a": base.repartition(n)})).collect()) for n in (1, 11)
    )
    assert one == many and len(set(one)) == 360


def test_unreadable_file_can_be_skipped(spark, tmp_path):
    path = str(tmp_path / "ecs")
    write_store(union_sources({"a": events(spark, "2025-01-01 10:00:00")}), path)
    (tmp_path / "ecs" / "source=a" / "dt=2025-01-01" / "broken.parquet").write_text("not parquet")
    assert read_store(spark, path, skip_unreadable=True).select("event_ts").count() == 1


def test_day_filter_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "ecs")
    write_store(union_sources({"a": events(spark, "2025-01-01 10:00:00", "2025-01-02 10:00:00")}), path)
    plan = read_store(spark, path).filter("dt = date'2025-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_failing_source_is_isolated(spark):
    frames, failures = isolated({"good": lambda: events(spark, "2025-01-01"), "bad": lambda: 1 / 0})
    assert list(frames) == ["good"] and list(failures) == ["bad"]


def test_empty_table_is_an_error(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "t"))
