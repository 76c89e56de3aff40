import hashlib
import json

from pyspark.sql import functions as F

from sentrylake.operators.evidence import (
    Run, bundle_manifest, content_hashes, context_lines, custody_records, file_hashes, write_bundle,
)


def test_files_are_hashed(spark, tmp_path):
    contents = {"a.bin": b"x" * 10, "day=1/b.bin": b"y" * 5000, "day=2/c.bin": b"z", "day=2/e.bin": b""}
    for name, data in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    expected = {name: (hashlib.sha256(data).hexdigest(), len(data)) for name, data in contents.items()}
    (tmp_path / "_hidden.bin").write_bytes(b"")
    rows = file_hashes(spark, str(tmp_path), "*.bin").collect()
    assert {r["path"].split(str(tmp_path) + "/")[1]: (r["sha256"], r["size"]) for r in rows} == expected
    assert {r["path"].split("/")[0] for r in rows} == {"file:"}


def test_content_hash_counts_bytes(spark):
    row = content_hashes(spark.createDataFrame([("é",)], "t string"), "t").first()
    assert (row["sha256"], row["size"]) == (hashlib.sha256("é".encode()).hexdigest(), 2)


def test_custody(spark):
    files = spark.createDataFrame([("p", "h", 1)], "path string, sha256 string, size bigint")
    rows = custody_records(files, files, Run("2025-01-01T00:00:00Z", "me")).collect()
    assert sorted(r["role"] for r in rows) == ["input", "output"]
    assert {(r["operator"], r["app_env"], r["tz"], r["created_at"]) for r in rows} == {
        ("me", "development", "UTC", "2025-01-01T00:00:00Z")}


def test_context_lines_leave_out_nulls_and_use_ecs_names(spark):
    df = spark.sql(
        "select 'a1' alert_id, timestamp'2025-01-01 00:00:00' alert_ts, 'u1' event_uid, "
        "timestamp'2025-01-01 00:00:01.5' event_ts, 'h' host_name, cast(null as string) user_name, 22 destination_port"
    )
    row = context_lines(df).first()
    assert json.loads(row["content"]) == {
        "event_uid": "u1", "@timestamp": "2025-01-01 00:00:01.500000+00:00", "host.name": "h", "destination.port": 22}


def test_bundle_folders_and_manifest(spark, tmp_path):
    files = spark.createDataFrame(
        [("a1", "raw_logs.jsonl", "one"), ("a1", "raw_logs.jsonl", "two"), ("a1", "x.md", "m1\nm2"), ("a2", "x.md", "é")],
        "alert_id string, file_name string, content string",
    )
    write_bundle(files, str(tmp_path / "out"), mode="overwrite")
    text = spark.read.text(str(tmp_path / "out")).groupBy("alert_id", "file_name").agg(F.sort_array(F.collect_list("value")).alias("v"))
    assert {(r["alert_id"], r["file_name"]): r["v"] for r in text.collect()} == {
        ("a1", "raw_logs.jsonl"): ["one", "two"], ("a1", "x.md"): ["m1", "m2"], ("a2", "x.md"): ["é"]}
    manifest = {(r["alert_id"], r["file_name"]): r for r in bundle_manifest(files.repartition(3)).collect()}

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    whole = digest("".join(digest(line) for line in sorted(map(digest, ("one", "two")))))
    row = manifest["a1", "raw_logs.jsonl"]
    assert (row["n_lines"], row["size"], row["sha256"]) == (2, 8, whole)
    assert manifest["a2", "x.md"]["size"] == 3 and manifest["a2", "x.md"]["sha256"] == digest(digest(digest("é")))
