"""Registered queries: sources and sinks, normalisation, window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditmill import schema, vocab
from auditmill.operators import features as ft, normalize as nz
from auditmill.plans import adapter
from auditmill.plans.adapter import CONTEXT_MINUTES, FINE_MINUTES
from auditmill.operators.normalize import parse_event_time
from auditmill.plans.registry import fragment, query
from auditmill.session import scratch_path
from auditmill.sources import events as src, tables as tab

# --- the raw records, flattened in SQL --------------------------------------

fragment("q_flat", """
SELECT *,
  hour(eventTime) AS event_hour, isodow(eventTime) - 1 AS event_day_of_week,
  strftime(eventTime, '%Y-%m-%d') AS event_date,
  hour(eventTime) * 60 + minute(eventTime) AS event_minute_of_day,
  coalesce(isodow(eventTime) >= 6, false) AS is_weekend,
  coalesce(hour(eventTime) >= 9 AND hour(eventTime) < 18 AND isodow(eventTime) < 6, false) AS is_business_hours
FROM (
SELECT CAST(event_id AS VARCHAR) AS eventID,
  CASE WHEN k <> 13 THEN date_trunc('second', ts) END AS eventTime,
  CASE WHEN k <> 13 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE 'not-a-time' END AS eventTime_str,
  CASE event_type WHEN 'view' THEN 'GetObject' WHEN 'click' THEN 'ListUsers' WHEN 'purchase' THEN 'PutObject'
    WHEN 'signup' THEN 'CreateUser' ELSE 'DeleteObject' END AS eventName,
  CASE event_type WHEN 'click' THEN 'sts' WHEN 'signup' THEN 'iam' WHEN 'error' THEN 'monitoring'
    ELSE 's3' END || '.amazonaws.com' AS eventSource,
  'us-east-1' AS awsRegion, 'AwsApiCall' AS eventType,
  CASE k % 4 WHEN 0 THEN '10.1.2.' WHEN 1 THEN '172.99.0.' WHEN 2 THEN '192.168.0.' ELSE '8.8.8.' END || k
    AS sourceIPAddress,
  CASE k % 5 WHEN 0 THEN 'aws-cli/2.1 Botocore/2' WHEN 1 THEN 'Boto3/1.3' WHEN 2 THEN 'Mozilla/5.0'
    WHEN 3 THEN 'AWS-Internal' ELSE '' END AS userAgent,
  CASE k % 5 WHEN 0 THEN 'cli' WHEN 1 THEN 'sdk' WHEN 2 THEN 'console' WHEN 3 THEN 'service' ELSE 'other' END
    AS ua_category,
  k % 4 < 3 AS is_internal_ip,
  CASE user_id % 3 WHEN 0 THEN 'IAMUser' WHEN 1 THEN 'AssumedRole' ELSE 'Root' END AS user_type,
  CASE user_id % 3 WHEN 2 THEN 'AIDA-' ELSE '' END || 'user-' || user_id AS user_name,
  'arn:aws:iam::1:user-' || user_id AS user_arn, '1' AS user_account_id,
  'AKIA' || user_id AS user_access_key_id,
  k % 6 = 0 AS user_mfa_authenticated,
  CASE WHEN k % 3 = 0 THEN 'Role' END AS session_issuer_type,
  CASE WHEN k % 3 = 0 THEN 'deploy' END AS session_issuer_username,
  CASE WHEN event_type NOT IN ('click','signup')
    THEN CASE WHEN k % 3 = 2 THEN 'eu-west-1' ELSE 'bucket-' || (k % 10) END END AS request_bucket_name,
  CASE WHEN event_type NOT IN ('click','signup')
    THEN CASE WHEN k % 2 = 0 THEN 'key-' ELSE 'obj-' END || event_id END AS request_key,
  CASE WHEN event_type NOT IN ('click','signup') AND k % 7 = 0 THEN 'logs/' END AS request_prefix,
  CASE WHEN event_type = 'error' THEN 'AccessDenied' END AS error_code,
  CASE WHEN event_type = 'error' THEN 'denied' END AS error_message,
  event_type = 'error' AS is_error,
  CASE WHEN k % 11 = 0 THEN true ELSE event_type IN ('view','click') END AS is_read_only,
  CASE WHEN k % 11 = 1 THEN false ELSE event_type = 'signup' END AS is_management_event,
  CASE WHEN event_type = 'view' THEN CAST(trunc(value * 100) AS DOUBLE) ELSE 0.0 END AS bytes_transferred_out,
  0.0 AS bytes_transferred_in,
  CASE event_type WHEN 'click' THEN 'iam' WHEN 'signup' THEN 'iam' WHEN 'error' THEN 'cloudwatch'
    ELSE 's3' END AS service
FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events))""")


def flat(spark, sf):
    return nz.flatten_events(adapter.raw_events(spark, sf))


FLAT_COLUMNS = [
    "eventID", "eventTime", "eventTime_str", "eventName", "eventSource", "awsRegion", "eventType",
    "sourceIPAddress", "userAgent", "ua_category", "is_internal_ip", "user_type", "user_name", "user_arn",
    "user_account_id", "user_access_key_id", "user_mfa_authenticated", "session_issuer_type",
    "session_issuer_username", "request_bucket_name", "request_key", "request_prefix", "error_code",
    "error_message", "is_error", "is_read_only", "is_management_event", "bytes_transferred_out",
    "bytes_transferred_in", "event_hour", "event_day_of_week", "event_date", "event_minute_of_day",
    "is_weekend", "is_business_hours", "service",
]


def _flat_query(name, columns):
    @query(name, f"SELECT eventID, {', '.join(columns)} FROM q_flat")
    def run(spark, sf):
        return flat(spark, sf).select("eventID", *columns)


_flat_query("flatten_events", FLAT_COLUMNS[1:])
_flat_query("parse_event_time", ["eventTime", "eventTime_str"])
_flat_query("bucket_name", ["request_bucket_name", "request_key", "request_prefix"])
_flat_query("resolve_user_name", ["user_type", "user_name"])
_flat_query("classify_user_agent", ["userAgent", "ua_category"])
_flat_query("service_name", ["eventSource", "service"])
_flat_query("is_internal_ip", ["sourceIPAddress", "is_internal_ip"])
_flat_query("calendar_fields", ["event_hour", "event_day_of_week", "event_date", "event_minute_of_day",
                                "is_weekend", "is_business_hours"])
_flat_query("default_and_cast", ["bytes_transferred_out", "bytes_transferred_in", "is_read_only",
                                 "is_management_event", "event_hour"])
_flat_query("error_flags", ["error_code", "is_error", "user_mfa_authenticated", "is_management_event"])


@query("sort_by_event_time", "SELECT eventID, eventTime FROM q_flat ORDER BY eventTime NULLS LAST, eventID")
def _(spark, sf):
    return nz.sort_by_event_time(flat(spark, sf).select("eventID", "eventTime"))


@query("label_events", "SELECT eventID, is_attack, attack_id, attack_name FROM q_ev")
def _(spark, sf):
    ev = adapter.events(spark, sf).drop("is_attack", "attack_id", "attack_name")
    return nz.label_events(ev, adapter.labels(spark, sf)).select(
        "eventID", "is_attack", "attack_id", "attack_name")


@query("events_summary", """
SELECT count(*) AS events, min(eventTime) AS first_time, max(eventTime) AS last_time,
  count(DISTINCT user_name) AS users, count(DISTINCT eventName) AS event_names FROM q_ev""")
def _(spark, sf):
    return nz.events_summary(adapter.events(spark, sf))


@query("top_values", """
SELECT * FROM (SELECT 'eventName' AS field, eventName AS value, count(*) AS events FROM q_ev GROUP BY 2
  ORDER BY events DESC, value LIMIT 10)
UNION ALL SELECT 'user_name', user_name, count(*) FROM q_ev GROUP BY 2
UNION ALL SELECT 'eventSource', eventSource, count(*) FROM q_ev GROUP BY 2""")
def _(spark, sf):
    ev = adapter.events(spark, sf)
    top = nz.top_values(ev, "eventName").withColumn("field", F.lit("eventName"))
    for c in ("user_name", "eventSource"):
        top = top.unionByName(nz.value_counts(ev, c).withColumn("field", F.lit(c)))
    return top


@query("merge_event_sets", "SELECT eventID, eventTime, is_attack FROM q_ev ORDER BY eventTime, eventID")
def _(spark, sf):
    ev = adapter.events(spark, sf).select("eventID", "eventTime", "is_attack")
    return nz.merge_event_sets(ev.filter("not is_attack"), ev.filter("is_attack"))


@query("attack_manifest", """
SELECT attack_id, attack_name, count(*) AS events, min(eventTime) AS window_start, max(eventTime) AS window_end
FROM q_ev WHERE is_attack GROUP BY 1, 2""")
def _(spark, sf):
    return nz.attack_manifest(adapter.events(spark, sf))


# --- sources and sinks -------------------------------------------------------

RAW_OUT = ["eventID", "eventTime", "eventName", "eventSource", "sourceIPAddress", "userAgent", "readOnly"]
_raw_sql = """
SELECT eventID, eventTime_str AS eventTime, eventName, eventSource, sourceIPAddress,
  nullif(userAgent, '') AS userAgent,
  CASE WHEN k % 11 <> 0 THEN is_ro END AS readOnly
FROM q_flat JOIN (SELECT CAST(event_id AS VARCHAR) AS id, CAST(json_extract_string(props,'$.k') AS INT) AS k,
  event_type IN ('view','click') AS is_ro FROM events) ON id = eventID"""


def _buckets(spark, sf, minutes=1440):
    path = scratch_path(spark, "audit-json")
    src.write_audit_json_buckets(adapter.raw_events(spark, sf), path, minutes, max_records=50_000)
    return path


@query("read_audit_json", _raw_sql)
def _(spark, sf):
    return src.read_audit_json(spark, _buckets(spark, sf)).select(*RAW_OUT)


@query("skipped_audit_files", """
SELECT 'c_nationkey=' || c_nationkey AS folder, count(DISTINCT c_nationkey) AS files FROM customer WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey""")
def _(spark, sf):
    """Logs of all events, and beside them JSON documents of another kind."""
    path = _buckets(spark, sf)
    other = adapter.table(spark, sf, "customer").select("c_nationkey", F.to_json(F.struct("c_custkey", "c_name")).alias("c")).filter("c_nationkey is not null")
    (other.groupBy("c_nationkey").agg(F.min("c").alias("first_customer")).write.partitionBy("c_nationkey").option("compression", "gzip")
     .mode("append").json(f"{path}/other"))
    skipped = src.skipped_audit_files(spark, path)
    return skipped.groupBy(F.element_at(F.split("file", "/"), -2).alias("folder")).agg(F.count(F.lit(1)).alias("files"))


@query("read_audit_json_range",
       _raw_sql + " WHERE q_flat.eventTime >= TIMESTAMP '2024-01-05' AND q_flat.eventTime < TIMESTAMP '2024-01-13'")
def _(spark, sf):
    return src.read_audit_json_range(spark, _buckets(spark, sf), "2024-01-05", "2024-01-12").select(*RAW_OUT)


@query("events_by_day", "SELECT left(eventTime_str, 10) AS day, count(*) AS events FROM q_flat GROUP BY 1")
def _(spark, sf):
    return src.events_by_day(adapter.raw_events(spark, sf))


EVENT_OUT = ["eventID", "eventTime", "eventName", "user_name", "is_read_only", "event_date"]


def _stored(spark, sf, by_date):
    path = scratch_path(spark, "events")
    src.write_events_parquet(adapter.events(spark, sf).select(*EVENT_OUT), path, by_date)
    return path


@query("write_events_parquet", f"SELECT {', '.join(EVENT_OUT)} FROM q_ev")
def _(spark, sf):
    back = src.read_events_parquet(spark, _stored(spark, sf, True))
    return back.withColumn("event_date", F.date_format(F.col("event_date").cast("date"), "yyyy-MM-dd"))


@query("read_events_parquet", "SELECT eventID, CAST(eventTime_str[:19] AS TIMESTAMP) AS eventTime FROM q_ev")
def _(spark, sf):
    path = scratch_path(spark, "events-text")
    ev = adapter.events(spark, sf)
    src.write_events_parquet(ev.select("eventID", F.col("eventTime_str").alias("eventTime")), path)
    return src.read_events_parquet(spark, path)


@query("read_date_range",
       f"SELECT {', '.join(EVENT_OUT)} FROM q_ev WHERE event_date BETWEEN '2024-01-05' AND '2024-01-12'")
def _(spark, sf):
    return src.read_date_range(spark, _stored(spark, sf, True), "2024-01-05", "2024-01-12").select(*EVENT_OUT)


@query("read_label_jsonl", """
SELECT eventID, eventTime_str AS eventTime, eventName, user_name AS userName, attack_id, attack_name, is_attack
FROM q_ev WHERE is_attack""")
def _(spark, sf):
    path = scratch_path(spark, "labels")
    adapter.labels(spark, sf).write.json(path)
    return tab.read_label_jsonl(spark, path)


@query("write_audit_json_buckets", """
SELECT make_timestamp((epoch_us(eventTime) // 86400000000) * 86400000000) AS bucket, count(*) AS records,
  count(DISTINCT eventID) AS ids FROM q_flat GROUP BY 1""")
def _(spark, sf):
    back = src.read_audit_buckets(spark, _buckets(spark, sf))
    day = F.date_trunc("day", parse_event_time(F.col("eventTime")))
    return back.groupBy(day.alias("bucket")).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("eventID").alias("ids"))


@query("window_labels_csv", "SELECT user_name, w AS \"window\", is_attack, attack_id, attack_name FROM q_feat")
def _(spark, sf):
    path = scratch_path(spark, "window-labels")
    tab.write_window_labels_csv(features(spark, sf), path)
    return tab.read_window_labels_csv(spark, path)


@query("dataset_status", " UNION ALL ".join(
    f"SELECT '{n}' AS dataset, true AS \"exists\", (SELECT count(*) FROM {n}) AS rows, false AS ready"
    for n in ("events", "documents", "embeddings", "orders", "lineitem"))
    + " UNION ALL SELECT 'absent', false, 0, false")
def _(spark, sf):
    names = ["events", "documents", "embeddings", "orders", "lineitem"]
    found = tab.dataset_status(spark, {n: f"{sf}/{n}.parquet" for n in names} | {"absent": f"{sf}/absent.parquet"})
    return found.select("dataset", "exists", "rows", "ready")


# --- window features ---------------------------------------------------------


def features(spark, sf):
    return ft.feature_matrix(adapter.events(spark, sf), FINE_MINUTES, CONTEXT_MINUTES)


def windows(spark, sf):
    return ft.window_table(adapter.events(spark, sf), FINE_MINUTES)


@query("floor_window", f"""
SELECT eventID, make_timestamp((epoch_us(eventTime) // 300000000) * 300000000) AS w5,
  make_timestamp((epoch_us(eventTime) // {FINE_MINUTES * 60}000000) * {FINE_MINUTES * 60}000000) AS wf FROM q_ev""")
def _(spark, sf):
    from auditmill.functions.scalars import floor_window
    ev = adapter.events(spark, sf).select("eventID", "eventTime")
    return (ev.withColumn("w5", floor_window(F.col("eventTime"), 5))
            .withColumn("wf", floor_window(F.col("eventTime"), FINE_MINUTES)).drop("eventTime"))


@query("event_flags", """
SELECT eventID, service = 'iam' AS is_iam_event, service = 's3' AS is_s3_event,
  NOT is_read_only AS is_write_event, service = 's3' AND NOT is_read_only AS is_s3_write,
  contains(eventName, 'Delete') AS is_s3_delete, service = 'iam' AND NOT is_read_only AS is_iam_write,
  starts_with(eventName, 'List') AND service = 'iam' AS is_iam_list, eventName = 'GetObject' AS is_s3_get,
  is_error AS is_error_event, NOT is_business_hours AS is_after_hours FROM q_ev""")
def _(spark, sf):
    return ft.event_flags(adapter.events(spark, sf)).select("eventID", *ft.FLAG_COUNTS.values())


COUNT_OUT = ["total_events", *ft.FLAG_COUNTS, "unique_resources", "unique_ips", "unique_event_types"]


@query("user_window_counts", f"""
SELECT user_name, w AS "window", {', '.join(COUNT_OUT)}, round(bytes_out_total, 4) AS bytes_out_total,
  round(bytes_out_max, 4) AS bytes_out_max FROM q_wf""")
def _(spark, sf):
    out = ft.user_window_counts(adapter.events(spark, sf), FINE_MINUTES)
    return out.withColumns({c: F.round(c, 4) for c in ("bytes_out_total", "bytes_out_max")})


@query("safe_ratios", "SELECT user_name, w AS \"window\", " + ", ".join(
    f"round({r}, 6) AS {r}" for r in vocab.RATIO_COLUMNS) + " FROM q_wf")
def _(spark, sf):
    out = ft.with_ratios(ft.user_window_counts(adapter.events(spark, sf), FINE_MINUTES))
    return out.select("user_name", "window", *[F.round(r, 6).alias(r) for r in vocab.RATIO_COLUMNS])


CAL = ["window_minutes", "window_hour", "window_day_of_week", "window_is_weekend", "window_is_business_hours"]


@query("window_calendar", f"SELECT user_name, w AS \"window\", {', '.join(CAL)} FROM q_wf")
def _(spark, sf):
    return windows(spark, sf).select("user_name", "window", *CAL)


BASE_OUT = [f"{c}_{s}" for c in vocab.BASELINE_COLUMNS for s in ("mean", "std", "p95", "max")]


@query("user_baselines", "SELECT user_name, " + ", ".join(
    f"round(CAST({c} AS DOUBLE), 5) AS {c}" for c in BASE_OUT) + " FROM q_base")
def _(spark, sf):
    out = ft.user_baselines(windows(spark, sf))
    return out.select("user_name", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in BASE_OUT])


@query("daily_get_grid", "SELECT * FROM q_grid")
def _(spark, sf):
    return ft.daily_get_grid(adapter.events(spark, sf))


@query("slope_3d", "SELECT user_name, event_date, s3_get_slope_3d FROM q_trend")
def _(spark, sf):
    trend = ft.daily_trends(ft.daily_get_grid(adapter.events(spark, sf)))
    return trend.select("user_name", "event_date", "s3_get_slope_3d")


@query("pct_change_1d",
       "SELECT user_name, event_date, round(s3_get_pct_change_1d, 6) AS s3_get_pct_change_1d FROM q_trend")
def _(spark, sf):
    trend = ft.daily_trends(ft.daily_get_grid(adapter.events(spark, sf)))
    return trend.select("user_name", "event_date", F.round("s3_get_pct_change_1d", 6).alias("s3_get_pct_change_1d"))


Z_OUT = list(vocab.ZSCORE_COLUMNS.values())


@query("baseline_zscores", "SELECT user_name, w AS \"window\", " + ", ".join(
    f"round({z}, 5) AS {z}" for z in Z_OUT) + " FROM q_z")
def _(spark, sf):
    w = windows(spark, sf)
    out = ft.baseline_zscores(w, ft.user_baselines(w))
    return out.select("user_name", "window", *[F.round(z, 5).alias(z) for z in Z_OUT])


H1_OUT = [f"h1_{c}" for c in vocab.HOUR_COLUMNS]


@query("hour_context", "SELECT user_name, w AS \"window\", " + ", ".join(
    f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in H1_OUT) + " FROM q_h1")
def _(spark, sf):
    ev = adapter.events(spark, sf)
    hours = ft.with_ratios(ft.user_window_counts(ev, CONTEXT_MINUTES))
    out = ft.hour_context(ft.window_table(ev, FINE_MINUTES), hours, CONTEXT_MINUTES)
    return out.select("user_name", "window", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in H1_OUT])


@query("daily_context", """
SELECT f.user_name, f.w AS "window", s3_get_slope_3d, round(s3_get_pct_change_1d, 6) AS s3_get_pct_change_1d
FROM q_wf f LEFT JOIN q_trend t ON t.user_name = f.user_name AND t.event_date = CAST(f.w AS DATE)""")
def _(spark, sf):
    ev = adapter.events(spark, sf)
    out = ft.daily_context(ft.window_table(ev, FINE_MINUTES), ft.daily_trends(ft.daily_get_grid(ev)))
    return out.select("user_name", "window", "s3_get_slope_3d",
                      F.round("s3_get_pct_change_1d", 6).alias("s3_get_pct_change_1d"))


@query("finalize_features", "SELECT user_name, w AS \"window\", strftime(w, '%Y-%m-%d') AS window_date, "
       "CAST(total_events AS DOUBLE) AS total_events, CAST(CAST(window_is_weekend AS INT) AS DOUBLE) "
       "AS window_is_weekend, 0.0 AS s3_get_slope_3d, round(bytes_out_total, 4) AS bytes_out_total FROM q_wf")
def _(spark, sf):
    out = ft.finalize_features(windows(spark, sf))
    return out.select("user_name", "window", "window_date", "total_events", "window_is_weekend",
                      "s3_get_slope_3d", F.round("bytes_out_total", 4).alias("bytes_out_total"))


@query("label_windows", """
SELECT f.user_name, f.w AS "window", l.attack_id IS NOT NULL AS is_attack, coalesce(l.attack_id, 0) AS attack_id,
  coalesce(l.attack_name, 'normal') AS attack_name
FROM q_wf f LEFT JOIN q_label l ON l.user_name = f.user_name AND l.w = f.w""")
def _(spark, sf):
    out = ft.label_windows(windows(spark, sf).select("user_name", "window"), adapter.events(spark, sf), FINE_MINUTES)
    return out


@query("label_distribution", """
SELECT attack_id, attack_name, count(*) AS windows, round(100.0 * avg(CAST(attack_id > 0 AS INT)), 4) AS attack_pct
FROM q_feat GROUP BY attack_id, attack_name
UNION ALL SELECT NULL, NULL, count(*), round(100.0 * avg(CAST(attack_id > 0 AS INT)), 4) FROM q_feat""")
def _(spark, sf):
    return ft.label_distribution(features(spark, sf))


@query("feature_matrix", "SELECT user_name, w AS \"window\", window_date, " + ", ".join(
    f"round({c}, 5) AS {c}" for c in vocab.FEATURE_COLUMNS) + ", is_attack, attack_id, attack_name FROM q_feat")
def _(spark, sf):
    return features(spark, sf).withColumns({c: F.round(c, 5) for c in vocab.FEATURE_COLUMNS})
