import collections
import json
import math

import pytest
from pyspark.sql import functions as F

from sentrylake.operators.features import event_flags, feature_table
from sentrylake.operators.sessions import sessionize
from sentrylake.sources.jsonl import SYSMON, WINDOWS_EVTX, ZEEK_CONN, map_records, parse_json_lines, read_json_source
from sentrylake.sources.store import union_sources, with_event_uid


# Invented records: (second of the day, host, user, code, address, status, command)
LOGONS = [
    (3_600, "ws-7", "nora", 4625, "172.16.4.2", "Failure", "logonui -x"),
    (3_645, "db-2", "omar", 4624, "172.16.9.9", "Success", "ls"),
    (3_661, "ws-7", "nora", 4625, "172.16.4.2", "Failure", "logonui -x"),
    (3_700, "ws-7", "nora", 4688, "172.16.4.2", "-", "rundll32 zz9,Start QWxwaGE="),
    (4_100, "db-2", "nora", 4625, "172.16.4.3", "Failure", ""),
    (4_599, "ws-7", "omar", 4625, "172.16.9.9", "Failure", "logonui -x"),
    (4_600, "ws-7", "nora", 4624, "172.16.4.2", "Success", "notes é.txt"),
]
# (second of the day, id, target, port, state)
FLOWS = [
    (7_200, "f1", "203.0.113.5", 443, "SF"), (7_319, "f2", "203.0.113.5", 443, "SF"), (7_440, "f3", "203.0.113.5", 443, "REJ"),
    (7_200, "f4", "203.0.113.77", 4444, "SF"), (7_321, "f5", "203.0.113.77", 4444, "S0"), (9_000, "f6", "203.0.113.9", 22, "S0"),
]
DAY = "2024-11-20"


def clock(second):
    return f"{DAY}T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z"


def windows(second, host, user, code, address, status, command):
    data = {"TargetUserName": user, "IpAddress": address, "Status": status, "CommandLine": command}
    return json.dumps({"Event": {"System": {"Computer": host, "EventID": code}, "EventData": data}, "@timestamp": clock(second)})


def zeek(second, uid, target, port, state):
    ends = {"id.orig_h": "172.16.4.2", "id.orig_p": 40_001, "id.resp_h": target, "id.resp_p": port}
    return json.dumps({"ts": clock(second), **ends, "proto": "udp", "service": "-", "conn_state": state, "uid": uid, "local_orig": False})


WINDOWS = [windows(*record) for record in LOGONS]
ZEEK = [zeek(*record) for record in FLOWS]


def entropy(text):
    counts = collections.Counter(text)
    return -sum(n / len(text) * math.log2(n / len(text)) for n in counts.values()) if text else 0.0


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def mapped(spark, values, source):
    return map_records(parse_json_lines(lines(spark, values), source), source)


def test_windows_features(spark):
    events = with_event_uid(union_sources({"windows_evtx": mapped(spark, WINDOWS, WINDOWS_EVTX)}))
    rows = feature_table(events).orderBy("event_ts").collect()
    failed = [int(code == 4625 or status == "Failure") for _, _, _, code, _, status, _ in LOGONS]
    assert [r["login_failed"] for r in rows] == failed
    assert [r["process_command_line_entropy"] for r in rows] == pytest.approx([entropy(record[-1]) for record in LOGONS])
    for minutes in (1, 5, 15):
        want = [
            sum(f for f, other in zip(failed, LOGONS) if other[2] == user and second - 60 * minutes < other[0] <= second)
            for second, _, user, *_ in LOGONS
        ]
        assert [r[f"login_failed_count_{minutes}m"] for r in rows] == want


def test_code_is_text_and_constants_are_set(spark):
    row = mapped(spark, WINDOWS, WINDOWS_EVTX).first()
    assert (row["event_code"], row["event_module"], row["event_dataset"]) == ("4625", "windows", "security")


def test_zeek_flags_and_sessions(spark):
    events = event_flags(mapped(spark, ZEEK, ZEEK_CONN).withColumn("dt", F.to_date("event_ts")))
    rows = {r["event_id"]: r for r in sessionize(events).collect()}
    assert {uid: r["conn_suspicious"] for uid, r in rows.items()} == {
        uid: int(port == 4444 or state == "S0") for _, uid, _, port, state in FLOWS
    }
    sessions = {}  # by target: a gap over 120 s opens the next
    for second, uid, target, *_ in sorted(FLOWS, key=lambda f: f[0]):
        number, last = sessions.get(target, (0, -1_000))
        sessions[target] = (number + (second - last > 120), second)
        assert rows[uid]["session_ordinal"] == sessions[target][0]
    assert (rows["f1"]["source_port"], rows["f1"]["network_direction"]) == (40_001, "false")


def test_nested_and_literal_keys(spark):
    nested = json.dumps({"ts": "2025-10-01T10:00:00Z", "id": {"orig_h": "1.1.1.1", "resp_p": "4444.0"}})
    both = json.dumps({"ts": "2025-10-01T10:00:01Z", "id": {"orig_h": "1.1.1.1"}, "id.orig_h": "2.2.2.2"})
    rows = mapped(spark, [nested, both], ZEEK_CONN).orderBy("event_ts").collect()
    assert [r["source_ip"] for r in rows] == ["1.1.1.1", "2.2.2.2"]
    assert rows[0]["destination_port"] == 4444


def test_time_precedence(spark):
    values = [
        '{"@timestamp":"2025-10-01T01:00:00Z","UtcTime":"2025-10-01T02:00:00Z","Computer":"a"}',
        '{"UtcTime":"2025-10-01 02:00:00.5","Computer":"b"}',
        '{"UtcTime":"","Computer":"c"}',
        '{"UtcTime":"soon","Computer":"d"}',
        '{"UtcTime":"2025-10-01T02:00:00+02:00","Computer":"e"}',
    ]
    rows = {r["host_name"]: str(r["event_ts"]) for r in mapped(spark, values, SYSMON).select(
        "host_name", F.date_format("event_ts", "HH:mm:ss.S").alias("event_ts")).collect()}
    assert rows == {"a": "01:00:00.0", "b": "02:00:00.5", "e": "00:00:00.0"}


def test_malformed_lines_are_dropped(spark):
    good = WINDOWS[0]
    values = ["", "   ", good[:40], good.replace('"', "'"), good + " x", good + good, good + ',"x":5', good + ',"record":' + good,
              good + ',"end":"~end-of-record~"', good + ',"y":{},"end":"~end-of-record~"', good + "] x", "5", "null", '"text"', "[1]", f"  {good} ",
              '{"@timestamp":null}', '{"@timestamp":"2025-10-01T00:00:00Z","@timestamp":"2025-10-02T00:00:00Z"}']
    rows = mapped(spark, values, WINDOWS_EVTX).orderBy("event_ts").collect()
    assert [r["event_ts"].date().isoformat() for r in rows] == [DAY, "2025-10-02"]


def test_field_of_other_shape_is_null(spark):
    values = ['{"@timestamp":"2025-10-01T00:00:00Z","Event":5}',
              '{"@timestamp":"2025-10-01T00:00:01Z","Event":{"System":[1],"EventData":{"Status":"Failure","LogonType":2}}}',
              '{"@timestamp":"2025-10-01T00:00:02Z","x":NaN,"Event":{"System":{"EventID":null,"Computer":"h"}}}']
    rows = mapped(spark, values, WINDOWS_EVTX).orderBy("event_ts").collect()
    assert [(r["event_outcome"], r["event_action"], r["host_name"]) for r in rows] == [
        (None, None, None), ("Failure", "2", None), (None, None, "h")]


def test_missing_file_is_empty(spark, tmp_path):
    assert read_json_source(spark, str(tmp_path / "none.jsonl"), SYSMON).count() == 0
    (tmp_path / "zeek_conn.jsonl").write_text("\n".join(ZEEK) + "\n")
    assert read_json_source(spark, str(tmp_path / "zeek_conn.jsonl"), ZEEK_CONN).count() == len(ZEEK)


def test_times_of_other_layouts(spark):
    """Zeek counts seconds since 1970 by default; other layouts of the same time are read alike."""
    times = ['1732096800.25', '"1732096800.25"', '"2024/11/20 10:00:00.25"', '"20241120T100000.25Z"', '"2024-11-20T11:00:00.25+01:00"']
    rows = mapped(spark, [f'{{"ts":{t},"uid":"u{i}"}}' for i, t in enumerate(times)], ZEEK_CONN).collect()
    assert len(rows) == len(times) and {r["event_ts"].timestamp() for r in rows} == {1732096800.25}
    assert mapped(spark, ['{"UtcTime":1732096800}'], SYSMON).count() == 0  # no unit stated: not guessed
