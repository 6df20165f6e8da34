"""Registered queries: alert enrichment and the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditmill import knowledge as kb, vocab
from auditmill.operators import enrich as en, graph as gr
from auditmill.plans import adapter
from auditmill.plans.adapter import FINE_MINUTES
from auditmill.functions.scalars import fixed
from auditmill.plans.registry import FRAGMENTS, fragment, query

W = 'w AS "window"'
AROUND = {"before": FINE_MINUTES, "after": FINE_MINUTES, "window_minutes": FINE_MINUTES}


def base(spark, sf):
    return adapter.alerts(spark, sf), adapter.features(spark, sf), adapter.events(spark, sf)


def name_counts(spark, sf):
    al, _f, ev = base(spark, sf)
    return en.event_name_counts(al, ev, **AROUND)


def matches(spark, sf):
    al, ft, _e = base(spark, sf)
    pats = kb.patterns(spark)
    return en.best_pattern_match(en.match_by_event_name(name_counts(spark, sf), pats),
                                 en.match_by_indicator(en.alert_features(al, ft), pats))


# --- enrichment --------------------------------------------------------------


@query("alert_features", f"SELECT user_name, {W}, " + ", ".join(
    f"round({c}, 5) AS {c}" for c in vocab.KEY_FEATURES) + " FROM q_alf")
def _(spark, sf):
    al, ft, _e = base(spark, sf)
    return en.alert_features(al, ft).withColumns({c: F.round(c, 5) for c in vocab.KEY_FEATURES})


@query("event_context", f"""
SELECT a.user_name, a.{W}, count(n.eventID) AS event_count,
  coalesce(round(avg(CAST(n.is_error AS INT)), 3), 0.0) AS error_rate, count(DISTINCT n.request_bucket_name) AS unique_resources
FROM q_al a LEFT JOIN q_near n ON n.user_name = a.user_name AND n.w = a.w GROUP BY 1, 2""")
def _(spark, sf):
    al, _f, ev = base(spark, sf)
    return en.event_context(al, ev, **AROUND)


@query("event_counts", f"""
SELECT user_name, {W}, string_agg(eventName || '=' || n, ';' ORDER BY n DESC, eventName) AS event_counts
FROM (SELECT user_name, w, eventName, count(*) AS n FROM q_near GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(spark, sf):
    out = en.event_counts(name_counts(spark, sf))
    return out.withColumn("event_counts", F.array_join(F.transform(
        "event_counts", lambda r: F.concat(r["name"], F.lit("="), r["count"].cast("string"))), ";"))


@query("match_by_event_name", f"SELECT user_name, {W}, pattern_id, CAST(0.7 AS DOUBLE) AS match_score FROM q_m1")
def _(spark, sf):
    return en.match_by_event_name(name_counts(spark, sf), kb.patterns(spark)).drop("match_reason")


@query("match_by_indicator", f"SELECT user_name, {W}, pattern_id, match_score FROM q_m2")
def _(spark, sf):
    al, ft, _e = base(spark, sf)
    return en.match_by_indicator(en.alert_features(al, ft), kb.patterns(spark)).drop("match_reason")


@query("best_pattern_match", f"SELECT user_name, {W}, pattern_id, match_score, match_reason, rank FROM q_best")
def _(spark, sf):
    return matches(spark, sf)


def vectors(spark, sf):
    """Stored vectors by number: the alert of user-n takes vector n, pattern i takes vector i.

    Numbers beyond the last vector begin again, so that no alert is left without one.
    """
    pts = adapter.points(spark, sf).select("id", "vector")
    number = F.pmod(F.expr("cast(substr(user_name, 6) as bigint)"), pts.agg(F.count(F.lit(1))).scalar())
    al = adapter.alerts(spark, sf)
    alert_vectors = al.select("user_name", "window", number.alias("id")).join(pts, "id").drop("id")
    ids = spark.createDataFrame([(p[0], i) for i, p in enumerate(kb.PATTERNS)], "pattern_id string, id long")
    return al, pts, alert_vectors, ids.join(pts, "id")


_ids = ", ".join(f"('{p[0]}', {i})" for i, p in enumerate(kb.PATTERNS))
fragment("q_cos", f"""
SELECT b.*, (list_cosine_similarity(x.v, y.v) + 1.0) / 2.0 AS s FROM q_best b
JOIN q_pt x ON x.id = CAST(substr(b.user_name, 6) AS BIGINT) % (SELECT count(*) FROM q_pt)
JOIN (VALUES {_ids}) p(pattern_id, id) ON p.pattern_id = b.pattern_id JOIN q_pt y ON y.id = p.id""")


@query("rerank_patterns", f"""
SELECT user_name, {W}, pattern_id, round(match_score, 3) AS base_match_score, round(s, 3) AS semantic_similarity,
  round(0.7 * match_score + (1.0 - 0.7) * s, 3) AS retrieval_score FROM q_cos""")
def _(spark, sf):
    _al, _p, av, pv = vectors(spark, sf)
    out = en.rerank_patterns(matches(spark, sf).drop("rank"), av, pv)
    return out.select("user_name", "window", "pattern_id", "base_match_score", "semantic_similarity", "retrieval_score")


def bridge(spark, sf):
    _w, indicator, _n, _e = adapter.graph(spark, sf)
    return en.match_via_bridge(adapter.alerts(spark, sf), indicator, kb.edges(spark))


def joined(*cols):
    return {c: F.array_join(c, ";") for c in cols}


@query("match_via_bridge", f"""
SELECT b.user_name, b.{W}, b.pattern_id, b.match_score, b.matched AS matched_features, l.technique_ids, l.playbook_ids, b.rank
FROM q_bridge b JOIN q_links l USING (pattern_id)""")
def _(spark, sf):
    return bridge(spark, sf).drop("match_reason").withColumns(joined("matched_features", "technique_ids", "playbook_ids"))


_fallback = """
SELECT *, row_number() OVER (PARTITION BY user_name, w ORDER BY event_hits DESC, pattern_id) AS rank FROM (
  SELECT e.user_name, a.w, n.pattern_id, count(*) * greatest(any_value(l.nt), 1) * greatest(any_value(l.np), 1) AS event_hits
  FROM {alerts} a JOIN q_ev e ON e.user_name = a.user_name AND e.eventTime >= a.w AND e.eventTime < a.w + INTERVAL 12 HOUR
  JOIN q_names n ON n.eventName = e.eventName JOIN q_links l ON l.pattern_id = n.pattern_id GROUP BY 1, 2, 3) QUALIFY rank <= 5"""


@query("match_via_event_hits", f"""
SELECT 'alerts' AS source, user_name, {W}, pattern_id, event_hits, round(least(0.95, 0.5 + 0.05 * event_hits), 3) AS match_score, rank
FROM ({_fallback.format(alerts="(SELECT * FROM q_al ANTI JOIN q_bridge USING (user_name, w))")})
UNION ALL SELECT 'all_windows', user_name, w, pattern_id, event_hits, round(least(0.95, 0.5 + 0.05 * event_hits), 3), rank
FROM ({_fallback.format(alerts="(SELECT * FROM q_ens ANTI JOIN q_tri USING (user_name, w))")})""")
def _(spark, sf):
    _w, indicator, _n, _e = adapter.graph(spark, sf)
    pats, edges, ev = kb.patterns(spark), kb.edges(spark), adapter.events(spark, sf)
    out = None
    for name, rows in (("alerts", adapter.alerts(spark, sf)), ("all_windows", adapter.ensemble(spark, sf))):
        found = en.match_via_bridge(rows, indicator, edges)
        one = en.match_via_event_hits(rows, found, ev, pats, edges, FINE_MINUTES).select(
            F.lit(name).alias("source"), "user_name", "window", "pattern_id", "event_hits", "match_score", "rank")
        out = one if out is None else out.unionByName(one)
    return out


@query("graph_intel", f"SELECT user_name, {W}, kind, key FROM q_intel")
def _(spark, sf):
    return en.graph_intel(matches(spark, sf), kb.edges(spark))


@query("chain_playbooks", f"""
SELECT user_name, {W}, playbook_id, from_tech || ' commonly enables ' || to_tech || ' (' || to_name || ')' AS chain_reason, rank
FROM q_chain""")
def _(spark, sf):
    return en.chain_playbooks(en.graph_intel(matches(spark, sf), kb.edges(spark)), kb.edges(spark), kb.techniques(spark))


def similar(spark, sf):
    al, pts, _av, _pv = vectors(spark, sf)
    number = F.expr("cast(substr(user_name, 6) as bigint)")
    total = pts.agg(F.count(F.lit(1))).scalar()
    views = al.select("user_name", "window", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("view"), number.alias("u"))
    views = views.withColumn("n", total).withColumn("id", F.pmod(F.col("u") + F.col("view"), F.col("n")))
    return en.similar_incidents(views.join(pts, "id").select("user_name", "window", "view", "vector"), pts)


def incidents(spark, sf):
    """What the stored points stand for as past incidents; the text is the document of the same number."""
    total = F.lit(adapter.table(spark, sf, "documents").count())
    docs = adapter.table(spark, sf, "documents").select(F.col("doc_id").alias("number"), F.col("text").alias("summary"))
    attack = F.when(F.col("is_attack"), 1 + F.col("id") % 5).otherwise(F.lit(0))
    return adapter.points(spark, sf).select("id", adapter.attack_name(attack).alias("attack_name"), F.pmod("id", total).alias("number")).join(
        docs, "number", "left").select("id", "attack_name", "summary")


fragment("q_view", """
SELECT a.user_name, a.w, v.view, (CAST(substr(a.user_name, 6) AS BIGINT) + v.view) % (SELECT count(*) FROM q_pt) AS id
FROM q_al a CROSS JOIN (VALUES (0), (1), (2)) v(view)""")
fragment("q_vid", "SELECT DISTINCT id FROM q_view")
fragment("q_near4", """
SELECT q.id, p.id AS incident_id, 1.0 - list_cosine_similarity(x.v, p.v) AS distance,
  row_number() OVER (PARTITION BY q.id ORDER BY 1.0 - list_cosine_similarity(x.v, p.v), p.id) AS rank
FROM q_vid q JOIN q_pt x ON x.id = q.id CROSS JOIN q_pt p QUALIFY rank <= 4""")


@query("similar_incidents", f"""
SELECT user_name, {W}, incident_id, similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_name, w ORDER BY similarity DESC, incident_id) AS rank FROM (
    SELECT v.user_name, v.w, n.incident_id, round(1.0 - min(n.distance), 3) AS similarity
    FROM q_view v JOIN q_near4 n ON n.id = v.id GROUP BY 1, 2, 3)) WHERE rank <= 3""")
def _(spark, sf):
    return similar(spark, sf)


fragment("q_docv", "SELECT d.doc_id AS id, d.text, p.v FROM documents d JOIN q_pt p ON p.id = d.doc_id % (SELECT count(*) FROM q_pt)")
fragment("q_uid", "SELECT DISTINCT CAST(substr(user_name, 6) AS BIGINT) % (SELECT count(*) FROM q_pt) AS id FROM q_al")
fragment("q_ti", """
SELECT q.id, p.id AS document_id, list_cosine_similarity(x.v, p.v) AS sim, substr(p.text, 1, 300) AS content,
  row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(x.v, p.v) DESC, p.id) AS rank
FROM q_uid q JOIN q_pt x ON x.id = q.id CROSS JOIN q_docv p QUALIFY rank <= 4""")


@query("threat_intel_search", f"""
SELECT a.user_name, a.{W}, t.document_id, t.rank, t.content, round(t.sim, 3) AS similarity
FROM q_al a JOIN q_ti t ON t.id = CAST(substr(a.user_name, 6) AS BIGINT) % (SELECT count(*) FROM q_pt)""")
def _(spark, sf):
    return threat_intel(spark, sf)


def threat_intel(spark, sf):
    _al, pts, av, _pv = vectors(spark, sf)
    # every document has a vector, those beyond the last one begin again
    number = F.pmod(F.col("doc_id"), pts.agg(F.count(F.lit(1))).scalar()).alias("number")
    docs = adapter.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"), number)
    docs = docs.join(pts.withColumnRenamed("id", "number"), "number").drop("number")
    return en.threat_intel_search(av, docs)


@query("models_fired", f"""
SELECT user_name, {W}, array_to_string(list_filter([
  CASE WHEN if_norm > 0.5 THEN 'IsolationForest(' || printf('%.3f', if_norm) || ')' END,
  CASE WHEN lof_norm > 0.5 THEN 'LOF(' || printf('%.3f', lof_norm) || ')' END,
  CASE WHEN ae_norm > 0.5 THEN 'Autoencoder(' || printf('%.3f', ae_norm) || ')' END], lambda x: x IS NOT NULL), ';') AS models_fired
FROM q_ens""")
def _(spark, sf):
    return adapter.ensemble(spark, sf).select("user_name", "window", F.array_join(en.models_fired(), ";").alias("models_fired"))


_sev = """CASE WHEN ensemble_score > 0.85 OR (vote_count = 3 AND critical) THEN 'CRITICAL'
  WHEN ensemble_score > 0.70 OR vote_count >= 2 THEN 'HIGH' WHEN ensemble_score > 0.50 THEN 'MEDIUM' ELSE 'LOW' END"""
fragment("q_sev", f"""
SELECT *, {_sev} AS severity FROM (SELECT a.*, EXISTS (SELECT 1 FROM q_best b JOIN q_pat p USING (pattern_id)
  WHERE b.user_name = a.user_name AND b.w = a.w AND p.severity = 'Critical') AS critical FROM q_al a)""")


@query("alert_severity", f"SELECT user_name, {W}, severity FROM q_sev")
def _(spark, sf):
    crit = matches(spark, sf).join(kb.patterns(spark).filter("severity = 'Critical'"), "pattern_id").select(
        "user_name", "window").distinct().withColumn("c", F.lit(True))
    rows = adapter.alerts(spark, sf).join(crit, en.KEYS, "left").withColumn("c", F.coalesce("c", F.lit(False)))
    return rows.select("user_name", "window", en.alert_severity(F.col("c")).alias("severity"))


def _signal_sql(after, slope, slope_name, n):
    parts = []
    for c in vocab.KEY_FEATURES:
        if "zscore" in c:
            parts.append(f"CASE WHEN abs({c}) > 2.0 THEN '{c}=' || printf('%.1f', {c}) END")
        elif c == "after_hours_ratio":
            parts.append(f"CASE WHEN {c} > {after} THEN 'after_hours=' || printf('%.2f', {c}) END")
        elif c == "s3_get_slope_3d":
            parts.append(f"CASE WHEN abs({c}) > {slope} THEN '{slope_name}=' || printf('%.1f', {c}) END")
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)[:{n}], ', ')"


fragment("q_sig", f"SELECT user_name, w, {_signal_sql(0.5, 5, 's3_slope', 4)} AS signals FROM q_feat")


@query("notable_signals", f"SELECT user_name, {W}, signals FROM q_sig")
def _(spark, sf):
    return adapter.features(spark, sf).select("user_name", "window", en.notable_signals().alias("signals"))


fragment("q_fired5", """
SELECT user_name, w, array_to_string(list_filter([
  CASE WHEN if_norm > 0.5 THEN 'IsolationForest(' || printf('%.3f', if_norm) || ')' END,
  CASE WHEN lof_norm > 0.5 THEN 'LOF(' || printf('%.3f', lof_norm) || ')' END,
  CASE WHEN ae_norm > 0.5 THEN 'Autoencoder(' || printf('%.3f', ae_norm) || ')' END], lambda x: x IS NOT NULL), ', ') AS fired FROM q_al""")
fragment("q_text", """
SELECT a.user_name, a.w, 'User ' || a.user_name || ' flagged by ' || f.fired || '. Patterns matched: '
  || coalesce((SELECT string_agg(p.name, ', ' ORDER BY b.rank) FROM q_best b JOIN q_pat p USING (pattern_id)
    WHERE b.user_name = a.user_name AND b.w = a.w AND b.rank <= 2), '')
  || '. Techniques: ' || coalesce((SELECT string_agg(name, ', ' ORDER BY key) FROM (SELECT t.name, i.key FROM q_intel i
    JOIN q_tech t ON t.technique_id = i.key WHERE i.kind = 'technique' AND i.user_name = a.user_name AND i.w = a.w ORDER BY i.key LIMIT 2)), '')
  || '. Key signals: ' || s.signals || '. Determine attack type, severity, and immediate response.' AS rag_query
FROM q_al a JOIN q_fired5 f ON f.user_name = a.user_name AND f.w = a.w JOIN q_sig s ON s.user_name = a.user_name AND s.w = a.w""")


def enriched(spark, sf, graph=False):
    """The stored documents: by event names and indicators, as the SQL of the text queries has it, or by
    the stored graph with re-ranked patterns."""
    def build():
        al, ft, ev = base(spark, sf)
        more = {}
        if graph:
            _al, _p, av, pv = vectors(spark, sf)
            more = {"indicator_edges": adapter.graph(spark, sf)[1], "alert_vectors": av, "pattern_vectors": pv}
        near = adapter.stage(spark, sf, "similar", lambda: similar(spark, sf))
        intel = adapter.stage(spark, sf, "threat-intel", lambda: threat_intel(spark, sf))
        return en.enriched_alerts(al, ft, ev, kb.patterns(spark), kb.edges(spark), kb.techniques(spark),
                                  kb.playbooks(spark), near, incidents(spark, sf), intel, **more, **AROUND)
    return adapter.stage(spark, sf, "enriched-graph" if graph else "enriched", build)


@query("alert_query_text", f"SELECT user_name, {W}, rag_query FROM q_text")
def _(spark, sf):
    return enriched(spark, sf).select("user_name", "window", "rag_query")


@query("enriched_alerts", f"""
SELECT a.user_name, a.{W}, round(a.ensemble_score, 4) AS ensemble_score, a.severity, a.vote_count,
  (SELECT count(*) FROM q_near n WHERE n.user_name = a.user_name AND n.w = a.w) AS event_count,
  coalesce((SELECT string_agg(b.pattern_id, ';' ORDER BY b.rank) FROM q_best b WHERE b.user_name = a.user_name AND b.w = a.w), '') AS patterns,
  coalesce((SELECT string_agg(i.key, ';' ORDER BY i.key) FROM q_intel i WHERE i.kind = 'technique' AND i.user_name = a.user_name AND i.w = a.w), '') AS techniques,
  coalesce((SELECT string_agg(i.key, ';' ORDER BY i.key) FROM q_intel i WHERE i.kind = 'playbook' AND i.user_name = a.user_name AND i.w = a.w), '') AS playbooks,
  coalesce((SELECT string_agg(c.playbook_id, ';' ORDER BY c.rank) FROM q_chain c WHERE c.user_name = a.user_name AND c.w = a.w), '') AS chain
FROM q_sev a""")
def _(spark, sf):
    ids = lambda c, f: F.array_join(F.transform(c, lambda r: r[f]), ";")
    return enriched(spark, sf).select(
        "user_name", "window", "alert.ensemble_score", "alert.severity", "alert.vote_count",
        "behavioral_context.event_context.event_count", ids("detection.matched_patterns", "pattern_id").alias("patterns"),
        ids("detection.techniques", "technique_id").alias("techniques"),
        ids("detection.primary_playbooks", "playbook_id").alias("playbooks"),
        ids("detection.chain_playbooks", "playbook_id").alias("chain"))


fragment("q_brm", f"""
SELECT user_name, w, pattern_id, match_score, 'graph_bridge_triggers_indicator' AS match_reason, matched FROM q_bridge
UNION ALL SELECT user_name, w, pattern_id, round(least(0.95, 0.5 + 0.05 * event_hits), 3), 'graph_bridge_event_match', ''
FROM ({_fallback.format(alerts="(SELECT * FROM q_al ANTI JOIN q_bridge USING (user_name, w))")})""")
fragment("q_brr", f"""
SELECT *, row_number() OVER (PARTITION BY user_name, w ORDER BY retrieval_score DESC, pattern_id) AS rank FROM (
  SELECT b.*, round(0.7 * match_score + (1.0 - 0.7) * (list_cosine_similarity(x.v, y.v) + 1.0) / 2.0, 3) AS retrieval_score FROM q_brm b
  JOIN q_pt x ON x.id = CAST(substr(b.user_name, 6) AS BIGINT) % (SELECT count(*) FROM q_pt)
  JOIN (VALUES {_ids}) p(pattern_id, id) ON p.pattern_id = b.pattern_id JOIN q_pt y ON y.id = p.id)""")
fragment("q_brintel", FRAGMENTS["q_intel"].replace("q_best", "q_brr"))
fragment("q_brchain", FRAGMENTS["q_chain"].replace("q_intel", "q_brintel"))
fragment("q_brsim", """
SELECT *, row_number() OVER (PARTITION BY user_name, w ORDER BY similarity DESC, incident_id) AS rank FROM (
  SELECT v.user_name, v.w, n.incident_id, round(1.0 - min(n.distance), 3) AS similarity
  FROM q_view v JOIN q_near4 n ON n.id = v.id GROUP BY 1, 2, 3) QUALIFY rank <= 3""")
_listed = lambda item, order, rows: f"coalesce((SELECT string_agg({item}, ';' ORDER BY {order}) FROM {rows} AND r.user_name = a.user_name AND r.w = a.w), '')"


@query("enriched_alerts_graph", f"""
SELECT user_name, {W}, {_sev} AS severity, patterns, techniques, playbooks, chain, past, threat_intel FROM (SELECT a.*,
  EXISTS (SELECT 1 FROM q_brr b JOIN q_pat p USING (pattern_id) WHERE b.user_name = a.user_name AND b.w = a.w AND p.severity = 'Critical') AS critical,
  {_listed("r.pattern_id || '=' || printf('%.3f', r.retrieval_score) || '=' || r.match_reason || '=' || r.matched", "r.rank", "q_brr r WHERE true")} AS patterns,
  {_listed("r.key", "r.key", "q_brintel r WHERE r.kind = 'technique'")} AS techniques,
  {_listed("r.key", "r.key", "q_brintel r WHERE r.kind = 'playbook'")} AS playbooks,
  {_listed("r.playbook_id", "r.rank", "q_brchain r WHERE true")} AS chain,
  {_listed("r.incident_id", "r.rank", "q_brsim r WHERE true")} AS past,
  (SELECT string_agg(t.document_id || '=' || md5(t.content), ';' ORDER BY t.rank) FROM q_ti t
    WHERE t.id = CAST(substr(a.user_name, 6) AS BIGINT) % (SELECT count(*) FROM q_pt)) AS threat_intel
  FROM q_al a)""")
def _(spark, sf):
    joined_by = lambda c, f: F.array_join(F.transform(c, f), ";")
    return enriched(spark, sf, graph=True).select(
        "user_name", "window", "alert.severity",
        joined_by("detection.matched_patterns", lambda p: F.concat_ws(
            "=", p["pattern_id"], fixed(p["retrieval_score"], 3), p["match_reason"], F.array_join(p["matched_features"], ";"))).alias("patterns"),
        joined_by("detection.techniques", lambda r: r["technique_id"]).alias("techniques"),
        joined_by("detection.primary_playbooks", lambda r: r["playbook_id"]).alias("playbooks"),
        joined_by("detection.chain_playbooks", lambda r: r["playbook_id"]).alias("chain"),
        joined_by("rag_retrieval.similar_past_incidents", lambda r: r["incident_id"].cast("string")).alias("past"),
        joined_by("rag_retrieval.threat_intel_docs", lambda r: F.concat_ws(
            "=", r["document_id"].cast("string"), F.md5(r["content"]))).alias("threat_intel"))


@query("analyst_prompt", f"""
SELECT a.user_name, a.{W}, '  Severity: ' || a.severity AS severity_line,
  '  Key anomalies: ' || coalesce(nullif({_signal_sql(0.3, 3, 's3_3day_slope', 5)}, ''), 'No extreme signals') AS signal_line,
  '  Vote Count: ' || a.vote_count || '/3' AS vote_line
FROM q_sev a JOIN q_feat f ON f.user_name = a.user_name AND f.w = a.w""")
def _(spark, sf):
    p = en.analyst_prompt(enriched(spark, sf))
    line = lambda n, a: F.regexp_extract("prompt", rf"(?m)^(  {n}: .*)$", 1).alias(a)
    return p.select("user_name", "window", line("Severity", "severity_line"), line("Key anomalies", "signal_line"),
                    line("Vote Count", "vote_line"))


@query("incident_report_text", f"""
SELECT user_name, {W}, row_number() OVER (PARTITION BY user_name ORDER BY round(ensemble_score, 4) DESC, w) AS incident_no,
  'INCIDENT #' || row_number() OVER (PARTITION BY user_name ORDER BY round(ensemble_score, 4) DESC, w) || ' | ' || severity
  || ' | User: ' || user_name || ' | Score: ' || printf('%.4f', round(ensemble_score, 4)) AS head FROM q_sev""")
def _(spark, sf):
    out = en.incident_report_text(enriched(spark, sf))
    return out.select("user_name", "window", "incident_no", F.regexp_extract("text", r"(?m)^(INCIDENT #.*)$", 1).alias("head"))


@query("basic_enrichment", f"""
SELECT a.user_name, a.{W}, 'User ' || a.user_name || ' at ' || strftime(a.w, '%Y-%m-%d %H:%M:%S') || ' with score '
  || printf('%.2f', a.ensemble_score) AS query, n.incident_id, n.rank, round(1.0 / (1.0 + n.distance), 3) AS similarity
FROM q_al a JOIN q_view v ON v.user_name = a.user_name AND v.w = a.w AND v.view = 0 JOIN q_near4 n ON n.id = v.id WHERE n.rank <= 3""")
def _(spark, sf):
    al, pts, av, _pv = vectors(spark, sf)
    out = en.basic_enrichment(al, av, pts)
    return out.select("user_name", "window", "query", F.explode("similar_past_incidents").alias("s")).select(
        "user_name", "window", "query", F.col("s.id").alias("incident_id"), "s.rank", "s.similarity")


# --- graph -------------------------------------------------------------------


@query("event_graph", """
SELECT 'node' AS part, 'User:' || user_name AS a, 'User' AS b, arg_max(user_arn, eventTime) AS c FROM q_ev GROUP BY user_name
UNION ALL SELECT 'node', 'Event:' || eventID, 'Event', eventName FROM q_ev
UNION ALL SELECT DISTINCT 'node', 'Resource:' || request_bucket_name, 'Resource', 's3_bucket' FROM q_ev WHERE request_bucket_name IS NOT NULL
UNION ALL SELECT 'edge', 'User:' || user_name, 'Event:' || eventID, 'PERFORMED' FROM q_ev
UNION ALL SELECT 'edge', 'Event:' || eventID, 'Resource:' || request_bucket_name, 'ON' FROM q_ev WHERE request_bucket_name IS NOT NULL""")
def _(spark, sf):
    nodes, edges = gr.event_graph(adapter.events(spark, sf))
    p = F.col("props")
    return nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("type").alias("b"),
                        F.coalesce(p["arn"], p["eventName"], p["type"]).alias("c")).unionByName(
        edges.select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("type").alias("c")))


def kb_nodes(spark, sf):
    t = adapter.kb_tables(spark, sf)
    return gr.knowledge_nodes(t["techniques"], t["services"], t["patterns"], t["playbooks"])


@query("knowledge_nodes", """
SELECT type || ':' || key AS id, type, key, name, description, CASE WHEN type IN ('DetectionPattern', 'AWSService') THEN name ELSE key END AS label
FROM q_kbn""")
def _(spark, sf):
    return kb_nodes(spark, sf)


def kb_edges(spark, sf):
    return gr.knowledge_edges(adapter.kb_tables(spark, sf)["relations"], kb_nodes(spark, sf))


@query("knowledge_edges", "SELECT src, dst, type, round(confidence, 6) AS confidence FROM q_kbe")
def _(spark, sf):
    return kb_edges(spark, sf).withColumn("confidence", F.round("confidence", 6))


@query("window_nodes", """
SELECT id, user_name, round(ensemble_score, 6) AS ensemble_score, ensemble_pred, is_attack, attack_name,
  round(error_rate, 5) AS error_rate, 'User:' || user_name AS had_window_src FROM q_win""")
def _(spark, sf):
    rows, had = gr.window_nodes(adapter.features(spark, sf), adapter.ensemble(spark, sf))
    return rows.join(had.select(F.col("dst").alias("id"), F.col("src").alias("had_window_src")), "id").select(
        "id", "user_name", F.round("ensemble_score", 6).alias("ensemble_score"), "ensemble_pred", "is_attack", "attack_name",
        F.round("error_rate", 5).alias("error_rate"), "had_window_src")


@query("matches_pattern_edges", """
SELECT 'Event:' || eventID AS src, 'DetectionPattern:' || pattern_id AS dst, 'MATCHES_PATTERN' AS type, CAST(0.9 AS DOUBLE) AS confidence
FROM q_ev JOIN q_names USING (eventName)""")
def _(spark, sf):
    return gr.matches_pattern_edges(adapter.events(spark, sf), kb.patterns(spark))


@query("triggers_indicator_edges", "SELECT src, dst, match_score, matched AS matched_features FROM q_tri")
def _(spark, sf):
    windows = adapter.graph(spark, sf)[0]
    out = gr.triggers_indicator_edges(windows, kb.patterns(spark))
    return out.select("src", "dst", "match_score", F.array_join("matched_features", ";").alias("matched_features"))


@query("anomalous_for_edges", "SELECT id AS src, 'User:' || user_name AS dst, 'ANOMALOUS_FOR' AS type FROM q_win WHERE ensemble_pred = 1")
def _(spark, sf):
    return gr.anomalous_for_edges(adapter.graph(spark, sf)[0])


@query("graph_counts", """
SELECT 'node' AS kind, type, count(*) AS count FROM q_kbn GROUP BY type UNION ALL SELECT 'node', NULL, count(*) FROM q_kbn
UNION ALL SELECT 'edge', type, count(*) FROM q_kbe GROUP BY type UNION ALL SELECT 'edge', NULL, count(*) FROM q_kbe""")
def _(spark, sf):
    return gr.graph_counts(kb_nodes(spark, sf), kb_edges(spark, sf))


_pct = lambda n, c: (f"count(*) FILTER ({c}) AS {n}, count(*) FILTER ({c} AND m) AS {n}_matched, "  # noqa: E731
                     f"round(CASE WHEN count(*) FILTER ({c}) > 0 THEN 100.0 * count(*) FILTER ({c} AND m) / count(*) FILTER ({c}) ELSE 0.0 END, 1) AS {n}_pct")


@query("bridge_coverage", f"""
SELECT {_pct('windows', 'true')}, {_pct('attack_windows', 'is_attack')}, {_pct('anomalies', 'ensemble_pred = 1')}
FROM (SELECT *, id IN (SELECT src FROM q_tri) AS m FROM q_win)""")
def _(spark, sf):
    windows, indicator, _n, _e = adapter.graph(spark, sf)
    return gr.bridge_coverage(windows, indicator)


@query("top_patterns", "SELECT dst AS pattern, count(DISTINCT src) AS windows FROM q_tri GROUP BY 1 ORDER BY windows DESC, pattern LIMIT 3")
def _(spark, sf):
    return gr.top_patterns(adapter.graph(spark, sf)[1])


@query("attack_chains", """
SELECT w.user_name, w.id AS window_id, t.dst AS pattern, t.match_score, d.src AS technique, p.dst AS playbook
FROM q_win w JOIN q_tri t ON t.src = w.id LEFT JOIN q_kb d ON d.type = 'DETECTED_BY' AND d.dst = t.dst
LEFT JOIN q_kb p ON p.type = 'TRIGGERS' AND p.src = t.dst WHERE w.ensemble_pred = 1""")
def _(spark, sf):
    windows, indicator, _n, _e = adapter.graph(spark, sf)
    return gr.attack_chains(windows, indicator, kb.edges(spark))


fragment("q_top", "SELECT id FROM q_win WHERE attack_name = 'data_exfiltration' ORDER BY ensemble_score DESC, id LIMIT 30")
fragment("q_first", """
SELECT * FROM q_edges WHERE type IN ('HAD_WINDOW', 'TRIGGERS_INDICATOR', 'ANOMALOUS_FOR')
  AND (src IN (SELECT id FROM q_top) OR dst IN (SELECT id FROM q_top))""")


@query("subgraph", """
SELECT src, dst, type FROM q_first UNION SELECT src, dst, type FROM q_edges WHERE type IN ('DETECTED_BY', 'TRIGGERS')
  AND (src IN (SELECT dst FROM q_first WHERE type = 'TRIGGERS_INDICATOR') OR dst IN (SELECT dst FROM q_first WHERE type = 'TRIGGERS_INDICATOR'))""")
def _(spark, sf):
    windows, _i, _n, edges = adapter.graph(spark, sf)
    return gr.subgraph(windows, edges, "data_exfiltration")


@query("expand_node", """
SELECT src AS node, dst AS neighbour, type, 'out' AS direction FROM q_kbe
UNION SELECT dst, src, type, 'in' FROM q_kbe""")
def _(spark, sf):
    return gr.expand_all(kb_edges(spark, sf))


QUESTION = "mass deletion playbook"
fragment("q_search", f"""
SELECT id, type, key, label, CASE WHEN contains(text, '{QUESTION}') THEN 1000 + bonus
    ELSE bonus + 60 * (CAST(contains(text, 'mass') AS INT) + CAST(contains(text, 'deletion') AS INT) + CAST(contains(text, 'playbook') AS INT)) END AS score
FROM (SELECT *, lower(key || ' ' || label || ' ' || name || ' ' || attack_name) AS text,
  CASE type WHEN 'MITRETechnique' THEN 500 WHEN 'DetectionPattern' THEN 400 WHEN 'Playbook' THEN 300 WHEN 'Window' THEN 200 WHEN 'User' THEN 100 ELSE 0 END AS bonus
  FROM q_nodes WHERE type <> 'AWSService')
WHERE contains(lower(key), '{QUESTION}') OR contains(lower(label), '{QUESTION}') OR contains(lower(name), '{QUESTION}') OR contains(lower(attack_name), '{QUESTION}') OR contains(lower(name), 'mass') OR contains(lower(name), 'deletion') OR contains(lower(name), 'playbook')
  OR contains(lower(name), 'response') OR contains(lower(name), 'procedure') OR contains(lower(name), 'runbook')""")


@query("keyword_search", "SELECT * FROM q_search")
def _(spark, sf):
    return gr.keyword_search(adapter.graph(spark, sf)[2], QUESTION)


@query("search_summary", """
SELECT 'type' AS part, type AS item, n AS value FROM (SELECT type, count(*) AS n FROM q_search GROUP BY 1 ORDER BY n DESC, type LIMIT 3)
UNION ALL SELECT 'match', id, score FROM (SELECT id, score FROM q_search ORDER BY score DESC, id LIMIT 12)
UNION ALL SELECT 'focus', f.id, (SELECT count(*) FROM q_edges e WHERE e.src = f.id OR e.dst = f.id)
FROM (SELECT id FROM q_search ORDER BY score DESC, id LIMIT 1) f""")
def _(spark, sf):
    _w, _i, nodes, edges = adapter.graph(spark, sf)
    return gr.search_summary(gr.keyword_search(nodes, QUESTION), edges)


fragment("q_und", "SELECT src AS a, dst AS b, min(type) AS type FROM (SELECT src, dst, type FROM q_edges UNION ALL SELECT dst, src, type FROM q_edges) GROUP BY 1, 2")
_reach = """WITH RECURSIVE reach(target, node, hops) USING KEY (target, node) AS (
  SELECT id, id, 0 FROM q_nodes WHERE type IN ('Playbook', 'MITRETechnique', 'DetectionPattern')
  UNION SELECT r.target, u.b, r.hops + 1 FROM reach r JOIN q_und u ON u.a = r.node
  WHERE NOT EXISTS (SELECT 1 FROM recurring.reach k WHERE k.target = r.target AND k.node = u.b)),
dist AS MATERIALIZED (SELECT target, node, hops FROM reach),
best AS MATERIALIZED (SELECT node, target, hops FROM dist WHERE target <> node QUALIFY row_number() OVER (PARTITION BY node ORDER BY hops, target) = 1)"""


@query("trace_path", f"""{_reach}
SELECT b.node, b.hops, b.target, min(u.b) AS via FROM best b JOIN q_und u ON u.a = b.node
JOIN dist d ON d.node = u.b AND d.target = b.target AND d.hops = b.hops - 1 GROUP BY 1, 2, 3""")
def _(spark, sf):
    _w, _i, nodes, edges = adapter.graph(spark, sf)
    return gr.trace_paths(nodes, edges)


@query("trace_path_rows", f"""{_reach},
onward AS MATERIALIZED (SELECT d.target, d.node, min(u.b) AS next FROM dist d JOIN q_und u ON u.a = d.node JOIN dist e ON e.target = d.target AND e.node = u.b AND e.hops = d.hops - 1 GROUP BY 1, 2),
path(start, target, step, node, hops) AS (SELECT node, target, 0, node, hops FROM best
  UNION ALL SELECT p.start, p.target, p.step + 1, o.next, p.hops - 1 FROM path p JOIN onward o ON o.target = p.target AND o.node = p.node WHERE p.hops > 0)
SELECT p.start, p.step, p.node, n.type AS node_type, u.type AS edge_type, CASE WHEN p.hops > 0 THEN o.next END AS next FROM path p JOIN q_nodes n ON n.id = p.node
LEFT JOIN onward o ON o.target = p.target AND o.node = p.node AND p.hops > 0 LEFT JOIN q_und u ON u.a = p.node AND u.b = o.next""")
def _(spark, sf):
    """All paths as rows of nodes with the edge that leads on."""
    _w, _i, nodes, edges = adapter.graph(spark, sf)
    return gr.trace_rows(nodes, edges)


@query("shared_resource_users", """
SELECT 'User:' || user_name AS "user", 'Resource:' || request_bucket_name AS resource, count(*) AS events,
  (SELECT count(DISTINCT x.user_name) FROM q_ev x WHERE x.request_bucket_name = e.request_bucket_name) - 1 AS other_users
FROM q_ev e WHERE request_bucket_name IS NOT NULL GROUP BY user_name, request_bucket_name""")
def _(spark, sf):
    _n, edges = gr.event_graph(adapter.events(spark, sf))
    return gr.shared_resource_users(edges)


