"""SQL fragments: the adapter, the window features and the ensemble, for DuckDB."""

from auditmill import vocab
from auditmill.plans.adapter import CONTEXT_MINUTES, FINE_MINUTES
from auditmill.plans.registry import fragment

_names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in vocab.ATTACK_NAMES.items())

fragment("q_ev", f"""
SELECT *, attack_id > 0 AS is_attack, CASE attack_id {_names} END AS attack_name
FROM (
  SELECT CAST(event_id AS VARCHAR) AS eventID, ts AS eventTime,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS eventTime_str,
    CASE event_type WHEN 'view' THEN 'GetObject' WHEN 'click' THEN 'ListUsers'
      WHEN 'purchase' THEN 'PutObject' WHEN 'signup' THEN 'CreateUser'
      WHEN 'error' THEN 'DeleteObject' END AS eventName,
    CASE WHEN event_type IN ('click','signup') THEN 'iam' ELSE 's3' END AS service,
    CASE WHEN event_type IN ('click','signup') THEN 'iam' ELSE 's3' END || '.amazonaws.com' AS eventSource,
    'user-' || user_id AS user_name,
    'IAMUser' AS user_type, 'arn:aws:iam::1:user/' || user_id AS user_arn,
    event_type IN ('view','click') AS is_read_only, event_type = 'error' AS is_error,
    CASE WHEN event_type = 'error' THEN 'AccessDenied' END AS error_code,
    CASE WHEN event_type NOT IN ('click','signup')
      THEN 'bucket-' || (CAST(json_extract_string(props,'$.k') AS INT) % 10) END AS request_bucket_name,
    '10.0.' || (user_id % 4) || '.' || CAST(json_extract_string(props,'$.k') AS INT) AS sourceIPAddress,
    CASE WHEN event_type = 'view' THEN value * 1024 ELSE 0.0 END AS bytes_transferred_out,
    (hour(ts) >= 9 AND hour(ts) < 18 AND isodow(ts) - 1 < 5) AS is_business_hours,
    strftime(ts, '%Y-%m-%d') AS event_date,
    CASE WHEN value > 200 THEN 1 + event_id % 5 ELSE 0 END AS attack_id
  FROM events)""")

_flags = """
    count(eventID) AS total_events,
    count(*) FILTER (service = 'iam') AS iam_events,
    count(*) FILTER (service = 's3') AS s3_events,
    count(*) FILTER (NOT is_read_only) AS write_events,
    count(*) FILTER (service = 's3' AND NOT is_read_only) AS s3_write_events,
    count(*) FILTER (contains(eventName, 'Delete')) AS s3_delete_events,
    count(*) FILTER (service = 'iam' AND NOT is_read_only) AS iam_write_events,
    count(*) FILTER (service = 'iam' AND starts_with(eventName, 'List')) AS iam_list_events,
    count(*) FILTER (eventName = 'GetObject') AS s3_get_events,
    count(*) FILTER (is_error) AS error_events,
    count(*) FILTER (NOT is_business_hours) AS after_hours_events,
    count(DISTINCT request_bucket_name) AS unique_resources,
    count(DISTINCT sourceIPAddress) AS unique_ips,
    count(DISTINCT eventName) AS unique_event_types,
    sum(bytes_transferred_out) AS bytes_out_total,
    max(bytes_transferred_out) AS bytes_out_max"""
_ratios = ", ".join(
    f"CASE WHEN total_events > 0 THEN CAST({n} AS DOUBLE) / total_events ELSE 0.0 END AS {r}"
    for r, n in vocab.RATIO_COLUMNS.items())


def window_sql(minutes: int) -> str:
    return f"""
SELECT *, {_ratios}, {minutes} AS window_minutes, hour(w) AS window_hour,
  isodow(w) - 1 AS window_day_of_week, isodow(w) - 1 >= 5 AS window_is_weekend,
  (hour(w) >= 9 AND hour(w) < 18 AND isodow(w) - 1 < 5) AS window_is_business_hours
FROM (
  SELECT user_name,
    make_timestamp((epoch_us(eventTime) // {minutes * 60_000_000}) * {minutes * 60_000_000}) AS w, {_flags}
  FROM q_ev GROUP BY 1, 2)"""


fragment("q_wf", window_sql(FINE_MINUTES))
fragment("q_wc", window_sql(CONTEXT_MINUTES))

fragment("q_base", "SELECT user_name, " + ", ".join(
    f"avg({c}) AS {c}_mean, stddev_pop({c}) + 1e-8 AS {c}_std, "
    f"quantile_cont({c}, 0.95) AS {c}_p95, max({c}) AS {c}_max" for c in vocab.BASELINE_COLUMNS)
    + " FROM q_wf GROUP BY user_name")

fragment("q_grid", """
SELECT u.user_name, CAST(d.d AS DATE) AS event_date, count(e.eventID) AS daily_s3_gets
FROM (SELECT DISTINCT user_name FROM q_ev WHERE eventName = 'GetObject') u
CROSS JOIN (SELECT unnest(generate_series(min(CAST(eventTime AS DATE)), max(CAST(eventTime AS DATE)),
  INTERVAL 1 DAY)) AS d FROM q_ev) d
LEFT JOIN q_ev e ON e.user_name = u.user_name AND CAST(e.eventTime AS DATE) = CAST(d.d AS DATE)
  AND e.eventName = 'GetObject'
GROUP BY 1, 2""")

fragment("q_trend", """
SELECT *, (daily_s3_gets - lag(daily_s3_gets, 2) OVER w) / 2.0 AS s3_get_slope_3d,
  CASE WHEN lag(daily_s3_gets) OVER w > 0
    THEN CAST(daily_s3_gets - lag(daily_s3_gets) OVER w AS DOUBLE) / lag(daily_s3_gets) OVER w
    ELSE 0.0 END AS s3_get_pct_change_1d
FROM q_grid WINDOW w AS (PARTITION BY user_name ORDER BY event_date)""")

_z = ", ".join(
    f"coalesce(least(greatest((f.{c} - b.{c}_mean) / b.{c}_std, -10.0), 10.0), 0.0) AS {z}"
    for c, z in vocab.ZSCORE_COLUMNS.items())
fragment("q_z", f"SELECT f.*, {_z} FROM q_wf f LEFT JOIN q_base b USING (user_name)")

_h1 = ", ".join(f"c.{c} AS h1_{c}" for c in vocab.HOUR_COLUMNS)
_us = CONTEXT_MINUTES * 60_000_000
fragment("q_h1", f"""
SELECT f.*, {_h1} FROM q_z f
LEFT JOIN q_wc c ON c.user_name = f.user_name
  AND c.w = make_timestamp((epoch_us(f.w) // {_us}) * {_us})""")

fragment("q_label", f"""
SELECT user_name, make_timestamp((epoch_us(eventTime) // {FINE_MINUTES * 60_000_000})
    * {FINE_MINUTES * 60_000_000}) AS w,
  arg_min(attack_id, eventTime) AS attack_id, arg_min(attack_name, eventTime) AS attack_name
FROM q_ev WHERE is_attack GROUP BY 1, 2""")

_feat = ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" if not c.startswith("window_is")
    else f"CAST(CAST({c} AS INT) AS DOUBLE) AS {c}" for c in vocab.FEATURE_COLUMNS)
fragment("q_feat", f"""
SELECT h.user_name, h.w, strftime(h.w, '%Y-%m-%d') AS window_date, {_feat},
  l.attack_id IS NOT NULL AS is_attack, coalesce(l.attack_id, 0) AS attack_id,
  coalesce(l.attack_name, 'normal') AS attack_name
FROM q_h1 h
LEFT JOIN q_trend t ON t.user_name = h.user_name AND t.event_date = CAST(h.w AS DATE)
LEFT JOIN q_label l ON l.user_name = h.user_name AND l.w = h.w""")

# --- ensemble ----------------------------------------------------------------

fragment("q_sc", """
SELECT *, CAST(if_score >= quantile_cont(if_score, CAST(0.9 AS DOUBLE)) OVER () AS INT) AS if_pred,
  CAST(lof_score >= quantile_cont(lof_score, CAST(0.9 AS DOUBLE)) OVER () AS INT) AS lof_pred,
  CAST(ae_score >= quantile_cont(ae_score, CAST(0.9 AS DOUBLE)) OVER () AS INT) AS ae_pred
FROM (SELECT user_name, w, is_attack, attack_id, attack_name, CAST(total_events AS DOUBLE) AS if_score,
  round(bytes_out_total, 2) AS lof_score, CAST(unique_event_types + write_ratio AS DOUBLE) AS ae_score FROM q_feat)""")


def _mm(c):
    return (f"CASE WHEN max({c}) OVER () <> min({c}) OVER () THEN ({c} - min({c}) OVER ()) / "
            f"(max({c}) OVER () - min({c}) OVER ()) ELSE 0.0 END")


fragment("q_fuse", f"""
SELECT *, CAST(0.35 AS DOUBLE) * if_norm + CAST(0.35 AS DOUBLE) * lof_norm + CAST(0.30 AS DOUBLE) * ae_norm AS ensemble_score,
  if_pred + lof_pred + ae_pred AS vote_count, CAST(if_pred + lof_pred + ae_pred >= 2 AS INT) AS majority_vote
FROM (SELECT *, {_mm('if_score')} AS if_norm, {_mm('lof_score')} AS lof_norm, {_mm('ae_score')} AS ae_norm FROM q_sc)""")


def grid_sql(source: str, score: str, percentiles) -> str:
    """F1 per percentile candidate."""
    qs = ", ".join(f"CAST({p / 100} AS DOUBLE)" for p in percentiles)
    ps = ", ".join(str(p) for p in percentiles)
    return f"""
SELECT p AS percentile, threshold, tp, flagged,
  CASE WHEN tp > 0 THEN 2.0 * tp / (flagged + positives) ELSE 0.0 END AS f1
FROM (SELECT c.p, c.threshold, count(*) FILTER (s.{score} >= c.threshold AND s.is_attack) AS tp,
    count(*) FILTER (s.{score} >= c.threshold) AS flagged, count(*) FILTER (s.is_attack) AS positives
  FROM {source} s CROSS JOIN (SELECT unnest([{ps}]) AS p, unnest(quantile_cont({score}, [{qs}])) AS threshold
    FROM {source}) c GROUP BY 1, 2)"""


fragment("q_cut", "SELECT * FROM (" + grid_sql("q_fuse", "ensemble_score", vocab.ENSEMBLE_PERCENTILES)
         + ") ORDER BY f1 DESC, percentile LIMIT 1")
fragment("q_ens", """
SELECT *, CAST(ensemble_score >= (SELECT threshold FROM q_cut) AS INT) AS ensemble_pred FROM q_fuse""")
fragment("q_al", "SELECT * FROM q_ens WHERE ensemble_pred = 1")
fragment("q_long", """
SELECT user_name, w, is_attack, attack_id, attack_name, 'isolation_forest' AS model, if_score AS score, if_pred AS pred FROM q_ens
UNION ALL SELECT user_name, w, is_attack, attack_id, attack_name, 'lof', lof_score, lof_pred FROM q_ens
UNION ALL SELECT user_name, w, is_attack, attack_id, attack_name, 'autoencoder', ae_score, ae_pred FROM q_ens
UNION ALL SELECT user_name, w, is_attack, attack_id, attack_name, 'ensemble', ensemble_score, ensemble_pred FROM q_ens""")
fragment("q_metrics", """
SELECT model, tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives,
  round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END, 4) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END, 4) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END, 4) AS f1,
  round(CASE WHEN fp + tn > 0 THEN fp / CAST(fp + tn AS DOUBLE) ELSE 0.0 END, 4) AS false_positive_rate
FROM (SELECT model, count(*) FILTER (pred = 1 AND is_attack) AS tp, count(*) FILTER (pred = 1 AND NOT is_attack) AS fp,
  count(*) FILTER (pred = 0 AND NOT is_attack) AS tn, count(*) FILTER (pred = 0 AND is_attack) AS fn
  FROM q_long GROUP BY model)""")
fragment("q_auc", """
SELECT model, (sum(r) FILTER (is_attack) - CAST(count(*) FILTER (is_attack) AS DOUBLE) * (count(*) FILTER (is_attack) + 1) / 2)
  / (CAST(count(*) FILTER (is_attack) AS DOUBLE) * count(*) FILTER (NOT is_attack)) AS roc_auc
FROM (SELECT model, is_attack, rank() OVER (PARTITION BY model ORDER BY score)
  + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM q_long) GROUP BY model""")

# --- points

fragment("q_pt", "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label, label = 0 AS is_attack FROM embeddings")

# --- rule base and graph -----------------------------------------------------

from auditmill import knowledge as _kb  # noqa: E402
from auditmill.plans.registry import sql_values  # noqa: E402

fragment("q_pat", sql_values([(p[0], p[1], p[2]) for p in _kb.PATTERNS], ["pattern_id", "name", "severity"]))
fragment("q_names", sql_values([(p[0], e) for p in _kb.PATTERNS for e in p[3]], ["pattern_id", "eventName"]))
fragment("q_ind", sql_values(
    [(p[0], len(p[6]), f, t, d) for p in _kb.PATTERNS for f, (t, d) in p[6].items()],
    ["pattern_id", "total", "feature", "threshold", "direction"]))
fragment("q_kb", sql_values([(*e, e[0].split(":")[1], e[1].split(":")[1]) for e in _kb.edge_rows()],
                            ["src", "dst", "type", "s", "d"]))
fragment("q_tech", sql_values([(t[0], t[1]) for t in _kb.TECHNIQUES], ["technique_id", "name"]))

_key = "user_name || '_' || strftime(w, '%Y-%m-%d %H:%M:%S')"
fragment("q_near", """
SELECT a.user_name, a.w, e.eventID, e.eventName, e.is_error, e.request_bucket_name FROM q_al a
JOIN q_ev e ON e.user_name = a.user_name AND e.eventTime >= a.w - INTERVAL 12 HOUR AND e.eventTime <= a.w + INTERVAL 12 HOUR""")
fragment("q_m1", "SELECT DISTINCT user_name, w, pattern_id FROM q_near JOIN q_names USING (eventName)")


def hits_sql(source: str, features) -> str:
    cols = ", ".join(features)
    return f"""
SELECT user_name, w, pattern_id, any_value(total) AS total, count(*) AS comparable,
  count(*) FILTER (hit) AS hits, array_to_string(list_sort(list(feature) FILTER (hit)), ';') AS matched
FROM (SELECT u.user_name, u.w, i.pattern_id, i.total, i.feature,
    CASE WHEN i.direction = 'below' THEN u.val < i.threshold ELSE u.val > i.threshold END AS hit
  FROM (UNPIVOT (SELECT user_name, w, {cols} FROM {source}) ON {cols} INTO NAME feature VALUE val) u
  JOIN q_ind i ON i.feature = u.feature) GROUP BY 1, 2, 3"""


fragment("q_alf", "SELECT f.* FROM q_feat f SEMI JOIN q_al a ON a.user_name = f.user_name AND a.w = f.w")
fragment("q_h2", hits_sql("q_alf", vocab.KEY_FEATURES))
fragment("q_m2", "SELECT user_name, w, pattern_id, round(CAST(hits AS DOUBLE) / total, 3) AS match_score "
                 "FROM q_h2 WHERE CAST(hits AS DOUBLE) / total > 0.5")
fragment("q_best", """
SELECT *, row_number() OVER (PARTITION BY user_name, w ORDER BY match_score DESC, pattern_id) AS rank FROM (
  SELECT user_name, w, pattern_id, greatest(max(CASE WHEN by_name THEN 0.7 END), max(CASE WHEN NOT by_name THEN match_score END)) AS match_score,
    CASE WHEN coalesce(max(CASE WHEN by_name THEN 0.7 END), 0) >= coalesce(max(CASE WHEN NOT by_name THEN match_score END), 0)
      THEN 'cloudtrail_event_match' ELSE 'behavioral_indicator_match' END AS match_reason
  FROM (SELECT user_name, w, pattern_id, CAST(0.7 AS DOUBLE) AS match_score, true AS by_name FROM q_m1
    UNION ALL SELECT user_name, w, pattern_id, match_score, false FROM q_m2) GROUP BY 1, 2, 3)
QUALIFY rank <= 5""")
fragment("q_h6", hits_sql("q_feat", vocab.WINDOW_NODE_FEATURES))
fragment("q_tri", f"""
SELECT user_name, w, pattern_id, 'Window:' || {_key} AS src, 'DetectionPattern:' || pattern_id AS dst,
  round(CAST(hits AS DOUBLE) / comparable, 3) AS match_score, matched
FROM q_h6 WHERE CAST(hits AS DOUBLE) / comparable >= 0.5 AND hits >= 1""")
fragment("q_links", """
SELECT p.pattern_id,
  coalesce((SELECT string_agg(s, ';' ORDER BY s) FROM q_kb WHERE type = 'DETECTED_BY' AND d = p.pattern_id), '') AS technique_ids,
  coalesce((SELECT string_agg(d, ';' ORDER BY d) FROM q_kb WHERE type = 'TRIGGERS' AND s = p.pattern_id), '') AS playbook_ids,
  (SELECT count(*) FROM q_kb WHERE type = 'DETECTED_BY' AND d = p.pattern_id) AS nt,
  (SELECT count(*) FROM q_kb WHERE type = 'TRIGGERS' AND s = p.pattern_id) AS np FROM q_pat p""")
fragment("q_bridge", """
SELECT t.user_name, t.w, t.pattern_id, t.match_score, t.matched,
  row_number() OVER (PARTITION BY t.user_name, t.w ORDER BY t.match_score DESC, t.pattern_id) AS rank
FROM q_tri t SEMI JOIN q_al a ON a.user_name = t.user_name AND a.w = t.w QUALIFY rank <= 5""")
fragment("q_intel", """
SELECT DISTINCT b.user_name, b.w, 'technique' AS kind, k.s AS key FROM q_best b JOIN q_kb k ON k.type = 'DETECTED_BY' AND k.d = b.pattern_id
UNION SELECT DISTINCT b.user_name, b.w, 'playbook', k.d FROM q_best b JOIN q_kb k ON k.type = 'TRIGGERS' AND k.s = b.pattern_id
UNION SELECT DISTINCT b.user_name, b.w, 'service', v.d FROM q_best b JOIN q_kb k ON k.type = 'DETECTED_BY' AND k.d = b.pattern_id
  JOIN q_kb v ON v.type = 'AFFECTS' AND v.s = k.s""")
fragment("q_chain", """
SELECT *, row_number() OVER (PARTITION BY user_name, w ORDER BY from_tech, to_tech, playbook_id) AS rank FROM (
  SELECT i.user_name, i.w, p.d AS playbook_id, arg_min(e.s, e.s || e.d) AS from_tech, arg_min(e.d, e.s || e.d) AS to_tech,
    arg_min(t.name, e.s || e.d) AS to_name
  FROM q_intel i JOIN q_kb e ON e.type = 'ENABLES' AND e.s = i.key JOIN q_tech t ON t.technique_id = e.d
  JOIN q_kb y ON y.type = 'DETECTED_BY' AND y.s = e.d JOIN q_kb p ON p.type = 'TRIGGERS' AND p.s = y.d
  WHERE i.kind = 'technique' GROUP BY 1, 2, 3) QUALIFY rank <= 3""")
fragment("q_win", f"SELECT f.*, 'Window:' || {_key.replace('user_name', 'f.user_name').replace('(w', '(f.w')} AS id, "
         "coalesce(e.ensemble_score, 0.0) AS ensemble_score, coalesce(e.ensemble_pred, 0) AS ensemble_pred "
         "FROM q_feat f LEFT JOIN q_ens e ON e.user_name = f.user_name AND e.w = f.w")
fragment("q_nodes", "SELECT id, 'Window' AS type, substr(id, 8) AS key, substr(id, 8) AS label, '' AS name, attack_name FROM q_win "
         "UNION ALL SELECT DISTINCT 'User:' || user_name, 'User', user_name, user_name, user_name, '' FROM q_win UNION ALL "
         "SELECT id, type, key, label, name, '' FROM (" + sql_values(_kb.node_rows(), ["id", "type", "key", "label", "name"]) + ")")
fragment("q_edges", """
SELECT 'User:' || user_name AS src, id AS dst, 'HAD_WINDOW' AS type FROM q_win
UNION ALL SELECT src, dst, 'TRIGGERS_INDICATOR' FROM q_tri
UNION ALL SELECT id, 'User:' || user_name, 'ANOMALOUS_FOR' FROM q_win WHERE ensemble_pred = 1
UNION ALL SELECT src, dst, type FROM q_kb""")
fragment("q_kbn", """
SELECT 'MITRETechnique' AS type, 'T' || (1000 + n_nationkey) AS key, n_name AS name, 'Seen in ' || r_name AS description
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'AWSService', CASE WHEN r_regionkey % 2 = 1 THEN 'Z' || r_regionkey ELSE upper(replace('Zone ' || r_name, ' ', '_')) END,
  'Zone ' || r_name, '' FROM region
UNION ALL SELECT 'DetectionPattern', 'IOC-SUP-' || s_suppkey, s_name, 'Balance ' || CAST(s_acctbal AS VARCHAR) FROM supplier
UNION ALL SELECT 'Playbook', 'IR-PART-' || p_partkey, p_name, '' FROM part""")
fragment("q_kbe", """
SELECT 'MITRETechnique:T' || (1000 + n_nationkey) AS src, 'DetectionPattern:IOC-SUP-' || s_suppkey AS dst, 'DETECTED_BY' AS type,
  CAST(0.5 AS DOUBLE) AS confidence FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'DetectionPattern:IOC-SUP-' || l_suppkey, 'Playbook:IR-PART-' || l_partkey, 'TRIGGERS', CAST(max(l_discount) AS DOUBLE)
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, l_partkey
UNION ALL SELECT 'MITRETechnique:T' || (1000 + n_nationkey), 'AWSService:' || CASE WHEN r_regionkey % 2 = 1 THEN 'Z' || r_regionkey
  ELSE upper(replace('Zone ' || r_name, ' ', '_')) END, 'AFFECTS', CAST(0.8 AS DOUBLE) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'MITRETechnique:T' || (1000 + a.n_nationkey), 'MITRETechnique:T' || (1000 + b.n_nationkey), 'OFTEN_ENABLES', CAST(0.7 AS DOUBLE)
  FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 5""")
