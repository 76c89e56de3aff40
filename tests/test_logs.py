from pyspark.sql import functions as F

from sentrylake.sources.lines import lines_in_range, lines_of_date, lines_with_keyword, write_lines
from sentrylake.sources.logs import parse_log_lines, read_logs

AUTH = [
    "Jan 15 10:31:00 h1 sshd[77]: Failed password for invalid user bob from 10.0.0.66 port 22",
    "Jan  5 10:31:00 h1 sshd[77]: Accepted publickey for alice from 10.0.0.12",
    "jan  5 10:31:02 h1 su[9]: pam_unix: authentication failure; user=x",
    "Jan  5 10:31:03 h1 cron[1]: session opened",
    "Feb 30 10:31:00 h1 sshd[1]: Accepted password for eve",
    "no match here",
]
CBS = [
    "2016-09-28 04:30:31, Info                  CBS    Failed to reach 10.1.1.1",
    "2016-09-28  04:30:32, Warning DISM ok",
    "2016-09-28 04:30:33, Info CSI 00000001 failed in lower case",
    "2016-13-28 04:30:33, Info CSI bad month",
]


def parsed(spark, lines, **options):
    df = parse_log_lines(spark.createDataFrame([(v,) for v in lines], "value string"), 2025, **options)
    return df.withColumn("time", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss")).orderBy("event_ts").collect()


def test_auth_lines(spark):
    rows = parsed(spark, AUTH)
    got = [(r["time"], r["host_name"], r["process_name"], r["event_outcome"], r["user_name"], r["source_ip"]) for r in rows]
    assert got == [
        ("2025-01-05 10:31:00", "h1", "sshd[77]", "Success", "alice", "10.0.0.12"),
        ("2025-01-05 10:31:02", "h1", "su[9]", "Failure", None, None),
        ("2025-01-05 10:31:03", "h1", "cron[1]", None, None, None),
        ("2025-01-15 10:31:00", "h1", "sshd[77]", "Failure", "bob", "10.0.0.66"),
    ]
    assert {(r["event_module"], r["event_dataset"], r["event_action"]) for r in rows} == {("syslog", "auth", "user_login")}


def test_auth_time_zone(spark):
    assert parsed(spark, AUTH[:1], tz="Europe/Berlin")[0]["time"] == "2025-01-15 09:31:00"


def test_cbs_lines(spark):
    rows = parsed(spark, CBS, host="node1")
    got = [(r["time"], r["process_name"], r["event_action"], r["event_outcome"], r["source_ip"], r["host_name"]) for r in rows]
    assert got == [
        ("2016-09-28 04:30:31", "CBS", "system_update", "Failure", "10.1.1.1", "node1"),
        ("2016-09-28 04:30:32", "DISM", "log_event", "Warning", None, "node1"),
        ("2016-09-28 04:30:33", "CSI", "system_update", "Info", None, "node1"),
    ]


def test_read_logs_is_recursive(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.log").write_text("\n".join(AUTH))
    (tmp_path / "deep" / "b.log").write_text("\n".join(CBS))
    (tmp_path / "c.txt").write_text(AUTH[0])
    rows = read_logs(spark, str(tmp_path), 2025).collect()
    assert len(rows) == 7
    assert {r["log_file_path"].rsplit("/", 1)[1] for r in rows} == {"a.log", "b.log"}


def test_line_filters(spark, tmp_path):
    values = ["2024-01-05 a Error", "2024-01-06 b error", "x 2024-01-05", "2024-01-31", "2024-02-30 bad", "", "  2024-01-07\tc"]
    df = spark.createDataFrame([(v,) for v in values], "value string")

    def got(frame):
        return sorted(r["value"] for r in frame.collect())

    assert got(lines_of_date(df, "2024-01-05")) == ["2024-01-05 a Error"]
    assert got(lines_with_keyword(df, "ERROR")) == ["2024-01-05 a Error", "2024-01-06 b error"]
    assert got(lines_in_range(df, "2024-01-06", "2024-01-31")) == ["  2024-01-07\tc", "2024-01-06 b error", "2024-01-31"]
    path = write_lines(lines_of_date(df, "2024-01-05"), str(tmp_path), "keyword_a b.log")
    assert path.endswith("keyword_a_b.log")
    assert got(spark.read.text(path)) == ["2024-01-05 a Error"]
