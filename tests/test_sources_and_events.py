"""Readers, normalisation and window features on hand-made edge rows."""

import gzip
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from auditmill import schema
from auditmill.operators import features as ft, normalize as nz
from auditmill.sources import events as src, tables as tab


def write_gz(path, doc):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") as f:
        f.write(doc if isinstance(doc, str) else json.dumps(doc))


def record(i, **kw):
    base = {"eventID": f"e{i}", "eventTime": "2026-02-23T14:00:00Z", "eventSource": "s3.amazonaws.com", "eventName": "GetObject"}
    return base | kw


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    base = tmp_path_factory.mktemp("logs")
    ident = {"type": "IAMUser", "userName": "eve", "principalId": "AIDA"}
    rows = [
        record(1, userIdentity=ident, sourceIPAddress="10.1.2.3", userAgent="aws-cli/2.1 botocore/2",
               requestParameters={"bucketName": "", "bucket": "b2", "key": "", "objectKey": "k"}, readOnly=None),
        record(2, userIdentity={"type": "AssumedRole", "principalId": "AROAX:job-session", "sessionContext": None},
               sourceIPAddress="172.99.0.1", userAgent="Boto3/1.3", requestParameters=None, eventSource="sts.amazonaws.com"),
        record(3, eventTime="yesterday", sourceIPAddress="8.8.8.8", userAgent="Mozilla/5.0", eventSource="monitoring.amazonaws.com"),
        record(4, userIdentity={"type": "Root", "principalId": "root-id", "sessionContext": {"attributes": {"mfaAuthenticated": "true"}}},
               errorCode="AccessDenied", additionalEventData={"byteTransferredOut": 7}, readOnly=False, userAgent="signin.amazonaws.com"),
    ]
    write_gz(base / "2026/02/23/a.json.gz", {"Records": rows})
    write_gz(base / "2026/02/24/b.json.gz", {"Records": [record(5, eventTime="2026-02-24T01:00:00Z")]})
    write_gz(base / "2026/02/24/c.json.gz", {"Other": 1})
    (base / "2026/02/24/d.json.gz").write_bytes(b"not gzip at all")
    write_gz(base / "2026/02/24/e.json.gz", '{"Records": [')
    return str(base)


def test_reader_skips_what_it_cannot_read(spark, logs):
    assert sorted(r.eventID for r in src.read_audit_json(spark, logs).collect()) == ["e1", "e2", "e3", "e4", "e5"]


def test_reader_limits_files_and_days(spark, logs):
    assert src.read_audit_json(spark, logs, max_files=1).count() == 4
    assert [r.eventID for r in src.read_audit_json_range(spark, logs, "2026-02-24", "2026-03-02").collect()] == ["e5"]
    assert src.read_audit_json_range(spark, logs, "2020-01-01", "2020-01-02").count() == 0


def test_flatten(spark, logs):
    rows = {r.eventID: r for r in nz.flatten_events(src.read_audit_json(spark, logs)).collect()}
    assert len(rows["e1"]) == 36
    assert (rows["e1"].user_name, rows["e1"].request_bucket_name, rows["e1"].request_key) == ("eve", "b2", "k")
    assert (rows["e1"].ua_category, rows["e1"].is_internal_ip, rows["e1"].is_read_only) == ("cli", True, True)
    assert (rows["e2"].user_name, rows["e2"].service, rows["e2"].is_internal_ip, rows["e2"].ua_category) == ("job-session", "iam", True, "sdk")
    assert (rows["e3"].eventTime, rows["e3"].eventTime_str, rows["e3"].user_name, rows["e3"].service) == (None, "yesterday", None, "cloudwatch")
    assert rows["e3"].is_business_hours is False and rows["e3"].is_internal_ip is False
    assert (rows["e4"].user_name, rows["e4"].is_error, rows["e4"].user_mfa_authenticated) == ("root-id", True, True)
    assert (rows["e4"].bytes_transferred_out, rows["e4"].is_read_only, rows["e4"].ua_category) == (7.0, False, "console")
    assert (rows["e4"].event_hour, rows["e4"].event_day_of_week, rows["e4"].event_minute_of_day) == (14, 0, 840)


def test_bucket_writer_splits_large_buckets(spark, tmp_path):
    raw = spark.range(50).select(F.concat(F.lit("e"), F.col("id")).alias("eventID"), F.lit("2026-02-23T14:07:00Z").alias("eventTime"))
    for name, kind in [p.strip().split(" ", 1) for p in ("eventName string", "eventSource string")]:
        raw = raw.withColumn(name, F.lit("x").cast(kind))
    src.write_audit_json_buckets(raw, str(tmp_path / "out"), 15, max_records=10)
    assert len(list((tmp_path / "out").rglob("*.json.gz"))) > 1
    back = src.read_audit_json(spark, str(tmp_path / "out"))
    assert back.select("eventID").distinct().count() == 50


def test_labels_and_duplicates(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"eventID":"a","attack_id":2,"attack_name":"data_exfiltration","is_attack":true}\n\n'
                                      '{"eventID":"a","attack_id":2,"attack_name":"data_exfiltration","is_attack":true}\n')
    labels = tab.read_label_jsonl(spark, str(tmp_path / "l.jsonl"))
    ev = spark.createDataFrame([("a",), ("b",)], "eventID string")
    out = {r.eventID: (r.is_attack, r.attack_id, r.attack_name) for r in nz.label_events(ev, labels).collect()}
    assert out == {"a": (True, 2, "data_exfiltration"), "b": (False, 0, "normal")}
    assert nz.label_events(ev, labels).count() == 2
    assert nz.label_events(ev, None).filter("is_attack").count() == 0


def test_reports(spark, tmp_path):
    (tmp_path / "incident_report_20260301_221257.txt").write_text("a\nb")
    (tmp_path / "other.txt").write_text("x")
    rows = tab.read_reports(spark, str(tmp_path)).collect()
    assert [(r.file, r.content, r.timestamp) for r in rows] == [("incident_report_20260301_221257.txt", "a\nb", "20260301_221257")]


def test_dataset_status(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    rows = {r.dataset: r for r in tab.dataset_status(spark, {"t": str(tmp_path / "t"), "u": str(tmp_path / "u")}).collect()}
    assert rows["t"].rows == 3 and rows["t"].exists and not rows["u"].exists and not rows["t"].ready


def T(day, hour, minute=0, second=0):
    return datetime(2026, 2, day, hour, minute, second, tzinfo=timezone.utc)


def events(spark, rows):
    cols = ["eventID", "user_name", "eventTime", "eventName", "service", "is_read_only", "is_error", "is_business_hours",
            "request_bucket_name", "sourceIPAddress", "bytes_transferred_out", "is_attack", "attack_id", "attack_name"]
    full = [(f"e{i:03d}", u, t, n, "s3", n == "GetObject", False, True, b, "10.0.0.1", 1.0, a > 0, a, "x" if a else "normal")
            for i, (u, t, n, b, a) in enumerate(rows)]
    return spark.createDataFrame(full, "eventID string, user_name string, eventTime timestamp, eventName string, service string, "
                                 "is_read_only boolean, is_error boolean, is_business_hours boolean, request_bucket_name string, "
                                 "sourceIPAddress string, bytes_transferred_out double, is_attack boolean, attack_id int, "
                                 "attack_name string").toDF(*cols)


def test_windows_and_baseline_of_a_single_window(spark):
    ev = events(spark, [("u", T(23, 14, 0), "GetObject", "b", 0), ("u", T(23, 14, 4, 59), "DeleteObject", None, 0),
                        ("u", T(23, 14, 5), "GetObject", "c", 0), (None, T(23, 14), "GetObject", "b", 0), ("v", T(23, 14), "PutObject", "b", 0)])
    rows = {(r.user_name, r.window.minute): r for r in ft.window_table(ev, 5).collect()}
    assert len(rows) == 3 and rows[("u", 0)].total_events == 2 and rows[("u", 0)].s3_delete_events == 1
    assert rows[("u", 0)].unique_resources == 1 and rows[("u", 5)].total_events == 1
    w = ft.window_table(ev, 5)
    z = {r.user_name: r.total_events_zscore for r in ft.baseline_zscores(w, ft.user_baselines(w)).filter("user_name = 'v'").collect()}
    assert z == {"v": 0.0}


def test_distinct_counts_move_the_events_once(spark):
    buckets, names = ["b", None, "c", "b"], ["GetObject", "PutObject", None]
    ev = events(spark, [("u" if i % 3 else "v", T(20, i % 2, i % 50), names[i % 5 % 3], buckets[i % 7 % 4], 0) for i in range(120)])
    out = ft.user_window_counts(ev, 5)
    seen = {}
    for r in ev.collect():
        key = r.user_name, r.eventTime.replace(minute=r.eventTime.minute // 5 * 5)
        for one, c in zip(seen.setdefault(key, (set(), set(), set())), ("request_bucket_name", "sourceIPAddress", "eventName")):
            one |= {r[c]} - {None}
    got = {(r.user_name, r.window): (r.unique_resources, r.unique_ips, r.unique_event_types) for r in out.collect()}
    assert got == {k: tuple(map(len, v)) for k, v in seen.items()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan  # a row for each distinct count


@pytest.mark.parametrize("counts,slopes", [([1, 2, 4], [None, None, 1.5]), ([5, 5, 5], [None, None, 0.0])])
def test_slope(spark, counts, slopes):
    rows = [("u", T(1 + d, 3), "GetObject", "b", 0) for d, c in enumerate(counts) for _ in range(c)]
    trend = ft.daily_trends(ft.daily_get_grid(events(spark, rows))).orderBy("event_date").collect()
    assert [r.s3_get_slope_3d for r in trend] == slopes
    assert trend[1].s3_get_pct_change_1d == (counts[1] - counts[0]) / counts[0]


def test_grid_zero_days_and_absent_users(spark):
    ev = events(spark, [("u", T(1, 3), "GetObject", "b", 0), ("w", T(4, 3), "PutObject", "b", 0), ("u", T(4, 5), "GetObject", "b", 0)])
    trend = ft.daily_trends(ft.daily_get_grid(ev)).orderBy("event_date").collect()
    assert [(r.user_name, r.daily_s3_gets, r.s3_get_pct_change_1d) for r in trend] == [("u", 1, 0.0), ("u", 0, -1.0), ("u", 0, 0.0), ("u", 1, 0.0)]
    assert ft.feature_matrix(ev).filter("user_name = 'w'").first().s3_get_slope_3d == 0.0


def test_window_label_is_the_first_attack(spark):
    ev = events(spark, [("u", T(23, 14, 2), "GetObject", "b", 3), ("u", T(23, 14, 1), "GetObject", "b", 4), ("u", T(23, 15), "GetObject", "b", 0)])
    out = {r.window.hour: (r.is_attack, r.attack_id) for r in ft.feature_matrix(ev).collect()}
    assert out == {14: (True, 4), 15: (False, 0)}


def test_feature_matrix_equals_its_parts(spark):
    """Sums of fine windows give the same context as aggregating the events again."""
    ev = events(spark, [("u" if i % 3 else "v", T(20 + i % 4, (i * 5) % 24, (i * 7) % 60), ["GetObject", "PutObject", "DeleteObject"][i % 3], "b", 0)
                        for i in range(200)])
    got = ft.feature_matrix(ev, with_labels=False)
    w, h = ft.window_table(ev, 5), ft.with_ratios(ft.user_window_counts(ev, 60))
    want = ft.finalize_features(ft.daily_context(ft.hour_context(ft.baseline_zscores(w, ft.user_baselines(w)), h),
                                                 ft.daily_trends(ft.daily_get_grid(ev))))
    a = sorted(map(tuple, got.select(*want.columns).collect()))
    b = sorted(map(tuple, want.collect()))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:3] == y[:3] and x[3:] == pytest.approx(y[3:], abs=1e-9)


def test_raw_schema_reads_nested(spark):
    assert "userIdentity" in spark.createDataFrame([], schema.RAW_EVENT).columns


def test_times_that_cannot_be_read_are_kept(spark, tmp_path):
    from auditmill.functions.scalars import floor_window
    raw = spark.createDataFrame([("a", "2026-02-23T14:07:00Z"), ("b", "yesterday"), ("c", None), ("d", "2026-02-24T00:00:00Z")], "eventID string, eventTime string")
    path = str(tmp_path / "out")
    src.write_audit_json_buckets(raw, path, 15)
    assert {str(p.parent.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.json.gz")} == {"2026/02/23", "2026/02/24", "unparsed"}
    assert {r.eventID for r in src.read_audit_json(spark, path).collect()} == {"a", "b", "c", "d"}
    assert [r.eventID for r in src.read_audit_json_range(spark, path, "2026-02-23", "2026-02-23").collect()] == ["a"]
    times = raw.select(floor_window(F.to_timestamp(F.when(F.col("eventID") == "a", F.col("eventTime"))), 5).alias("w")).collect()
    assert len(times) == 4 and sum(r.w is None for r in times) == 3


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from auditmill.session import shared_dir
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(unset)


def test_skipped_files_are_named(spark, tmp_path):
    record = {"eventID": "a", "eventTime": "2026-02-23T10:00:00Z", "eventName": "GetObject"}
    whole = gzip.compress(json.dumps({"Records": [record] * 500 + [{**record, "eventID": str(i)} for i in range(2000)]}).encode())
    files = {"2026/02/23/good one.json.gz": whole, "2026/02/23/empty.json.gz": gzip.compress(b'{"Records": []}'),
             "2026/02/24/cut.json.gz": whole[:len(whole) // 2], "2026/02/24/none.json.gz": gzip.compress(b'{"Other": 1}'),
             "2026/02/24/junk.json.gz": b"no gzip at all", "2026/02/24/text.json.gz": gzip.compress(b"no json"), "2026/02/24/notes.txt": b"x"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = src.skipped_audit_files(spark, str(tmp_path)).collect()
    assert sorted(r.file.rsplit("/", 1)[1] for r in got) == ["cut.json.gz", "junk.json.gz", "none.json.gz", "text.json.gz"]
    assert {r.file.rsplit("/", 1)[1]: r.bytes for r in got}["junk.json.gz"] == 14
    assert src.read_audit_json(spark, str(tmp_path)).count() == 2500


def test_a_stream_in_slices_of_time_keeps_the_state_of_open_windows_only(spark, tmp_path, monkeypatch):
    from datetime import datetime, timedelta

    from auditmill.operators import features as ft
    from auditmill.streaming import pipeline as st

    start = datetime(2024, 1, 1)
    rows = [(f"e{i}", f"u{i % 7}", start + timedelta(minutes=i * 11), "GetObject" if i % 5 else "PutObject", "s3", True, False, f"b{i % 3}", "ip", 1.0) for i in range(3_000)]
    rows.append(("none", "u0", None, "GetObject", "s3", True, False, "b", "ip", 1.0))
    ddl = ("eventID string, user_name string, eventTime timestamp, eventName string, service string, is_read_only boolean, is_error boolean, "
           "request_bucket_name string, sourceIPAddress string, bytes_transferred_out double")
    df = spark.createDataFrame(rows, ddl)
    monkeypatch.setattr(st, "EVENTS_TOGETHER", 500)
    slices = st.time_slices(df, str(tmp_path / "slices"))
    assert len(slices) == 7 and sum(s.count() for s in slices) == 3_001
    spans = [s.agg(F.min("eventTime"), F.max("eventTime")).first() for s in slices]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    held = []
    made = st.run_to_table

    def run(stream, path, checkpoint):
        made(stream, path, checkpoint)
        told = spark.read.format("statestore").load(checkpoint)
        held.append(told.count())

    monkeypatch.setattr(st, "run_to_table", run)
    counted = lambda s: st.stream_window_counts(s, 720)
    st.replay(slices, str(tmp_path / "in"), counted, str(tmp_path / "out"), str(tmp_path / "cp"))
    pick = ["user_name", "window", "total_events", "s3_get_events", "unique_resources", "unique_ips"]
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*pick).collect()}
    whole = ft.user_window_counts(df.withColumn("is_business_hours", F.lit(True)), 720)
    last = start + timedelta(minutes=2_999 * 11 - 10)
    closed = whole.filter(F.col("window") + F.expr("interval 12 hours") <= F.lit(last))
    assert got == {tuple(r) for r in closed.select(*pick).collect()}
    assert len(held) == 7 and max(held) < 1_000  # of the 3,000 events, each with four values
    empty = st.time_slices(df.limit(0), str(tmp_path / "none"))
    assert len(empty) == 1 and empty[0].count() == 0
