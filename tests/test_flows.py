from pyspark.sql import functions as F

from sentrylake.sources.flows import flow_files, normal_name, read_flows, skipped_files


def test_names():
    assert normal_name(" Src IP ") == "src_ip"
    assert normal_name("Flow Bytes/s") == "flow_bytess"


def test_files_with_different_headers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text(
        " Timestamp,Src IP,Dst IP,Src Port,Dst Port,Protocol,Label,Tot Fwd Bytes,Tot Bwd Bytes\n"
        "03/04/2025 10:00,10.0.0.1,10.0.0.2,4444.0,x,TCP,DDoS,10,?\n"
        "2025-10-01 00:00:01,10.0.0.1,10.0.0.2,1,2,UDP,,1,2\n"
        "never,10.0.0.1,10.0.0.2,1,2,UDP,,1,2\n"
    )
    (tmp_path / "sub" / "b.csv").write_text(
        "username,dport,start_time,hostname,total_fwd_bytes\nalice,22,25/12/2025 7:05:09,h1,5\nbob,22,12/25/2025 7:05:09,h2,5\n"
    )
    (tmp_path / "sub" / "no_time.csv").write_text("a,b\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    rows = read_flows(spark, str(tmp_path)).withColumn("t", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss"))
    rows = {(r["t"], r["user_name"]): r for r in rows.collect()}
    assert set(rows) == {
        ("2025-04-03 10:00:00", None), ("2025-10-01 00:00:01", None), ("2025-12-25 07:05:09", "alice"),
        ("2025-12-25 07:05:09", "bob"),
    }
    first = rows["2025-04-03 10:00:00", None]
    assert (first["source_port"], first["destination_port"], first["network_transport"]) == (4444, None, "tcp")
    assert (first["network_bytes"], first["event_action"], first["event_dataset"]) == (10.0, "DDoS", "custom_csv")
    assert rows["2025-10-01 00:00:01", None]["event_action"] == "flow"
    assert rows["2025-12-25 07:05:09", "alice"]["network_bytes"] is None
    assert read_flows(spark, str(tmp_path), recursive=False).count() == 2


def test_time_column_argument(spark, tmp_path):
    (tmp_path / "a.csv").write_text("seen at,timestamp\n2025-10-01 00:00:01,2020-01-01\n")
    assert read_flows(spark, str(tmp_path), time_col="Seen At").first()["event_ts"].year == 2025
    assert read_flows(spark, str(tmp_path)).first()["event_ts"].year == 2020
    assert read_flows(spark, str(tmp_path / "none")).count() == 0


def test_time_layouts(spark, tmp_path):
    texts = ["2017/07/05 08:55:00", "5/7/17 8:55", "5-JUL-2017 08:55", "05 July 2017 08:55:00", "5/7/2017 8:55:00 AM", "1499244900", "7/25/17 1:00", "5/7/99 1:00"]
    (tmp_path / "a.csv").write_text("time,user\n" + "".join(f"{t},u{i}\n" for i, t in enumerate(texts)))
    stamp = F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("t")
    got = {r["user_name"]: r["t"] for r in read_flows(spark, str(tmp_path), time_unit="s").select("user_name", stamp).collect()}
    assert got == {**{f"u{i}": "2017-07-05 08:55:00" for i in range(6)}, "u6": "2017-07-25 01:00:00", "u7": "1999-07-05 01:00:00"}
    assert read_flows(spark, str(tmp_path)).count() == 7  # without a unit a bare number is no time


def test_skipped_files_and_quoted_newlines(spark, tmp_path):
    (tmp_path / "no time.csv").write_text("a,b\n1,2\n")
    (tmp_path / "q.csv").write_text('time,label\n2025-01-01 00:00:00,"two\nlines"\n2025-01-01 00:00:01,"a,b"\n')
    files = flow_files(spark, str(tmp_path))
    assert [(r["file_path"].rsplit("/", 1)[1], r["status"]) for r in skipped_files(files).collect()] == [("no%20time.csv", "no time column")]
    rows = read_flows(spark, str(tmp_path), quoted_newlines=True, files=files).orderBy("event_ts").collect()
    assert [r["event_action"] for r in rows] == ["two\nlines", "a,b"]
