"""Registered queries: texts, vectors, knowledge lookups, evaluation and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditmill import vocab
from auditmill.functions.vectors import squared_norm
from auditmill.operators import evaluate as ev, features as ft, text as tx
from auditmill.operators.embedding import TextModel
from auditmill.operators.knn import MetricIndex, knn_join
from auditmill.plans import adapter
from auditmill.plans.registry import fragment, query, sql_list, sql_values
from auditmill.session import scratch_path
from auditmill.sources import events as src, tables as tab
from auditmill.streaming import pipeline as st

W = 'w AS "window"'

# --- texts -------------------------------------------------------------------

_i = lambda c: f"CAST(CAST({c} AS BIGINT) AS VARCHAR)"
_sum = f"""'User ' || user_name || ' at ' || strftime(w, '%Y-%m-%d %H:%M:%S') || ' performed ' || {_i('total_events')}
 || ' total events in 12 hours. S3 GetObject: ' || {_i('s3_get_events')} || ' (z-score=' || printf('%.1f', s3_get_events_zscore)
 || '). IAM writes: ' || {_i('iam_write_events')} || '. IAM list ops: ' || {_i('iam_list_events')} || '. S3 deletes: ' || {_i('s3_delete_events')}
 || '. Errors: ' || {_i('error_events')} || '. Bytes transferred out: ' || printf('%.0f', bytes_out_total) || '. Overall volume z-score: '
 || printf('%.1f', total_events_zscore) || '. 3-day S3 GET slope: ' || printf('%.2f', s3_get_slope_3d) || '. Time context: '
 || CASE WHEN window_is_business_hours = 1 THEN 'business hours' ELSE 'off hours' END || ', '
 || CASE WHEN window_is_weekend = 1 THEN 'weekend' ELSE 'weekday' END || '. Label: ' || attack_name || '.'"""


@query("window_summary_text", f"SELECT user_name, {W}, {_sum} AS summary FROM q_feat")
def _(spark, sf):
    return adapter.features(spark, sf).select("user_name", "window", tx.window_summary_text("12 hours").alias("summary"))


@query("incident_documents", f"""
SELECT left(replace(replace('inc_' || user_name || '_' || strftime(w, '%Y-%m-%d %H:%M:%S'), ' ', '_'), ':', '-'), 128) AS id, attack_id,
  lower({_sum} || chr(10) || chr(10) || 'Anomaly Signals:' || chr(10) || '* total_events_zscore = ' || printf('%.2f', total_events_zscore)
  || chr(10) || '* s3_get_slope_3d = ' || printf('%.2f', s3_get_slope_3d) || chr(10) || '* after_hours_ratio = ' || printf('%.2f', after_hours_ratio)
  || chr(10) || '* iam_write_events = ' || {_i('iam_write_events')} || chr(10) || '* iam_list_events = ' || {_i('iam_list_events')}
  || chr(10) || '* s3_get_events = ' || {_i('s3_get_events')} || chr(10) || '* s3_delete_events = ' || {_i('s3_delete_events')}
  || chr(10) || 'Attack label: ' || attack_name) AS document FROM q_feat WHERE is_attack""")
def _(spark, sf):
    return tx.incident_documents(adapter.features(spark, sf), "12 hours").select("id", "metadata.attack_id", "document")


def kb_full(spark, sf):
    """The dimension tables with all fields of the rule base."""
    t = adapter.kb_tables(spark, sf)
    n = F.expr("cast(substr(technique_id, 2) as int)")
    code = F.regexp_extract("pattern_id", r"(\d+)$", 1)
    part = F.regexp_extract("playbook_id", r"(\d+)$", 1)
    techniques = t["techniques"].withColumns({
        "enables": F.array(F.concat(F.lit("T"), (n + 5).cast("string"))),
        "aws_indicators": F.struct(F.transform(F.sequence(F.lit(1), n % 8 + 1), lambda i: F.concat(F.lit("Call"), i.cast("string"))).alias("cloudtrail_events"))})
    patterns = t["patterns"].withColumns({
        "embedding_description": F.when(code.cast("int") % 2 == 0, F.concat(F.lit("More on "), "name")).otherwise(F.lit("")),
        "techniques_detected": F.array(F.lit("T1"), F.concat(F.lit("T"), code)), "triggers_playbook": F.array(F.concat(F.lit("IR-"), code)),
        "behavioral_indicators": F.create_map(
            F.lit("error_rate"), F.struct(F.lit(0.5).alias("threshold"), F.lit("above").alias("direction")),
            F.lit("iam_ratio"), F.struct(F.lit(0.25).alias("threshold"), F.lit("below").alias("direction"))),
        "user_context": F.struct(F.concat(F.lit("persona "), code).alias("persona_note"))})
    playbooks = t["playbooks"].withColumns({
        "incident_types": F.array(F.lit("A"), F.lit("B")), "techniques_addressed": F.array(F.concat(F.lit("T"), part)),
        "triage_questions": F.transform(F.sequence(F.lit(1), part.cast("int") % 5 + 1), lambda i: F.concat(F.lit("Q"), i.cast("string"), F.lit("?"))),
        "response_phases": F.struct(
            F.transform(F.sequence(F.lit(1), part.cast("int") % 3 + 1), lambda i: F.struct(i.cast("string").alias("action"), F.lit("x").alias("cli"))).alias("containment"),
            F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(F.concat(F.lit("step"), i.cast("string")).alias("step"))).alias("investigate"))})
    services = t["services"].withColumns({
        "sensitive_operations": F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.concat(F.lit("Op"), i.cast("string"))),
        "detection_focus": F.array(F.lit("f1"), F.lit("f2"), F.lit("f3"), F.lit("f4")), "related_techniques": F.array(F.col("service_name"))})
    return techniques, patterns, playbooks, services




@query("knowledge_documents", f"""
SELECT 'mitre_' || id AS id, 'technique' AS type, lower('MITRE ' || id || ': ' || n_name || '. Tactics: ' || lower(r_name) || ', tactic-' || (k % 3)
  || '. Platforms: ' || CASE WHEN k % 2 = 0 THEN 'AWS' ELSE 'Linux' END || ', IaaS. Seen in ' || r_name || ' CloudTrail events: '
  || array_to_string(list_transform(generate_series(1, least((1000 + k) % 8 + 1, 5)), lambda i: 'Call' || i), ', ') || '. Enables: T' || (1005 + k) || '.') AS document
FROM (SELECT n_nationkey AS k, 'T' || (1000 + n_nationkey) AS id, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
UNION ALL SELECT 'dp_IOC-SUP-' || k, 'detection_pattern', lower('Detection Pattern: ' || s_name || N || 'Severity: '
  || CASE WHEN s_acctbal > 8000 THEN 'Critical' WHEN s_acctbal > 4000 THEN 'High' ELSE 'Low' END || N || 'Description:' || chr(10)
  || CASE WHEN k % 2 = 0 THEN 'More on ' || s_name ELSE 'Balance ' || CAST(s_acctbal AS VARCHAR) END || N || 'Behavioral Indicators:' || chr(10)
  || 'error_rate>0.50 iam_ratio<0.25' || N || 'MITRE Techniques:' || chr(10) || 'T1, T' || k || N || 'Playbooks Triggered:' || chr(10) || 'IR-' || k
  || N || 'User Context: persona ' || k) FROM (SELECT s_suppkey AS k, chr(10) || chr(10) AS N, * FROM supplier)
UNION ALL SELECT 'pb_IR-PART-' || k, 'playbook', lower('Playbook: ' || p_name || N || 'Playbook ID: IR-PART-' || k || N || 'Incident Types: A, B' || N
  || 'MITRE Techniques Addressed: T' || k || N || 'Triage Questions: '
  || array_to_string(list_transform(generate_series(1, least(k % 5 + 1, 3)), lambda i: 'Q' || i || '?'), ' ') || N
  || 'Investigation Steps: step1 step2' || N || 'Containment Actions: ' || (k % 3 + 1) || ' available.')
FROM (SELECT p_partkey AS k, chr(10) || chr(10) AS N, * FROM part)
UNION ALL SELECT 'svc_Zone ' || r_name, 'aws_service', lower('AWS Service: Zone ' || r_name || N || 'Security Sensitivity: High' || N || 'Description:' || chr(10)
  || N || 'Sensitive Operations:' || chr(10) || 'Op1, Op2, Op3, Op4, Op5, Op6' || N || 'Detection Focus:' || chr(10) || 'f1 f2 f3' || N
  || 'Related MITRE Techniques:' || chr(10) || 'Zone ' || r_name) FROM (SELECT chr(10) || chr(10) AS N, * FROM region)""")
def _(spark, sf):
    t, p, b, s = kb_full(spark, sf)
    return tx.knowledge_documents(t, p, b, s)


_word = "regexp_matches({}, '[\\p{{L}}\\p{{N}}]')"


@query("embed_text", f"""
SELECT doc_id, 64 AS dimensions, CASE WHEN text IS NOT NULL AND {_word.format('text')} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS length FROM documents""")
def _(spark, sf):
    """Every document by the model that was fitted on all of them."""
    docs = adapter.table(spark, sf, "documents").select("doc_id", "text")
    out = tx.embed_text(docs, "text", encoder=document_model(spark, sf))
    return out.select("doc_id", F.size("vector").alias("dimensions"), F.round(F.sqrt(squared_norm(F.col("vector"))), 3).alias("length"))


@query("embed_text_hashed", """
SELECT doc_id, 256 AS dimensions, CASE WHEN text IS NOT NULL AND regexp_matches(text, '\\S') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS length FROM documents""")
def _(spark, sf):
    out = tx.embed_text(adapter.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")
    return out.select("doc_id", F.size("vector").alias("dimensions"), F.round(F.sqrt(squared_norm(F.col("vector"))), 3).alias("length"))


_MODELS: dict = {}


def document_model(spark, sf):
    """The model of all documents, fitted once per session and stored as a table."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = scratch_path(spark, "text-model")
        TextModel.fit(adapter.table(spark, sf, "documents"), "text").save(_MODELS[key])
    return TextModel.load(spark, _MODELS[key])


@query("upsert_collection", """
SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'labelled' ELSE 'stored' END AS state, md5(text) AS document FROM documents""")
def _(spark, sf):
    docs = adapter.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("document"))
    labelled = adapter.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    new = docs.join(labelled, "id", "left_semi").withColumn("state", F.lit("labelled"))
    return tx.upsert_collection(docs.withColumn("state", F.lit("stored")), new)


# --- vectors -----------------------------------------------------------------


def collections(spark, sf):
    pts = adapter.points(spark, sf)
    return pts, {"behavioral_incidents": pts.filter("id % 2 = 0"), "threat_intelligence": pts.filter("id % 2 = 1")}


def searched(spark, sf):
    def build():
        pts, cols = collections(spark, sf)
        return tx.semantic_search(pts, cols, 5)
    return adapter.stage(spark, sf, "semantic-search", build)


fragment("q_coll", """
SELECT q.id AS query_id, CASE WHEN b.id % 2 = 0 THEN 'behavioral_incidents' ELSE 'threat_intelligence' END AS collection, b.id AS document_id,
  round(1.0 / (1.0 + (1.0 - list_cosine_similarity(q.v, b.v))), 3) AS similarity, 1.0 - list_cosine_similarity(q.v, b.v) AS distance
FROM q_pt q CROSS JOIN q_pt b
QUALIFY row_number() OVER (PARTITION BY q.id, b.id % 2 ORDER BY 1.0 - list_cosine_similarity(q.v, b.v), b.id) <= 5""")
fragment("q_found", """
SELECT query_id, collection, document_id, similarity,
  row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, collection, document_id) AS rank FROM q_coll QUALIFY rank <= 5""")


@query("semantic_search", "SELECT * FROM q_found")
def _(spark, sf):
    pts, cols = collections(spark, sf)
    return tx.semantic_search(pts, cols, 5)


@query("semantic_search_texts", f"""
SELECT question_id, 5 AS results, TRUE AS ordered, TRUE AS in_range FROM (
  SELECT doc_id AS question_id FROM documents WHERE text IS NOT NULL AND {_word.format('text')})""")
def _(spark, sf):
    """Every document as a question to the incident documents and the rule base, by vectors of the texts."""
    model = document_model(spark, sf)
    embedded = lambda df, c: tx.embed_text(df, c, encoder=model).select("id", "vector")
    incidents = tx.incident_documents(adapter.features(spark, sf), "12 hours").select("id", "document")
    knowledge = tx.knowledge_documents(*kb_full(spark, sf)).select("id", "document")
    found_in = {n: MetricIndex.fit(embedded(d, "document"), metric="cosine", most=5) for n, d in (("behavioral_incidents", incidents), ("threat_intelligence", knowledge))}
    asked = adapter.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = embedded(asked, "text").filter(F.exists("vector", lambda v: v != 0))
    found = tx.semantic_search(asked, found_in, 5)
    listed = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "similarity"))).alias("f"))
    falls = F.forall(F.sequence(F.lit(1), F.size("f") - 1), lambda i: F.get("f", i)["similarity"] <= F.get("f", i - 1)["similarity"])
    return listed.select(F.col("query_id").alias("question_id"), F.size("f").alias("results"), falls.alias("ordered"),
                         F.forall("f", lambda r: r["similarity"].between(0.333, 1.0)).alias("in_range"))


@query("collection_counts", "SELECT 'src' || (doc_id % 3) AS collection, count(*) AS documents FROM documents GROUP BY 1")
def _(spark, sf):
    docs = adapter.table(spark, sf, "documents")
    return tx.collection_counts(docs.select(F.concat(F.lit("src"), (F.col("doc_id") % 3).cast("string")).alias("collection")))


def search_documents(spark, sf):
    docs = adapter.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("document"), "source",
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("T"), (1000 + F.col("doc_id")).cast("string"))).alias("technique_id"))
    kind = F.when(F.col("id") % 2 == 0, "behavioral_incidents").otherwise("threat_intelligence")
    return docs.withColumn("collection", kind)


@query("search_summary_json", """
SELECT f.query_id, count(*) AS result_count, string_agg(md5(d.text), ';' ORDER BY f.rank) AS contents, max(f.similarity) AS best
FROM q_found f JOIN documents d ON d.doc_id = f.document_id GROUP BY 1""")
def _(spark, sf):
    out = tx.search_summary_json(searched(spark, sf), search_documents(spark, sf))
    shape = "struct<query:long,collection:string,result_count:long,results:array<struct<content:string,similarity:double>>>"
    j = F.from_json("json", shape)
    return out.select("query_id", j.alias("j")).select(
        "query_id", "j.result_count", F.array_join(F.transform("j.results", lambda r: F.md5(r["content"])), ";").alias("contents"),
        F.array_max(F.transform("j.results", lambda r: r["similarity"])).alias("best"))


@query("grounding_context", """
SELECT f.query_id, md5(string_agg('[Source ' || f.rank || ': ' || d.source || CASE WHEN d.doc_id % 2 = 0 THEN ' | T' || (1000 + d.doc_id) ELSE '' END
  || ']' || chr(10) || substr(d.text, 1, 600), chr(10) || chr(10) ORDER BY f.rank)
  || chr(10) || chr(10) || any_value(e.t) || chr(10) || chr(10) || any_value(e.r)) AS context
FROM q_found f JOIN documents d ON d.doc_id = f.document_id
JOIN (SELECT query_id, string_agg('  - [' || collection || '] ' || document_id || ': s', chr(10) ORDER BY rank) AS t,
  string_agg('  - ' || collection || ' --[HOLDS]--> ' || document_id, chr(10) ORDER BY rank) AS r FROM q_found GROUP BY 1) e
  ON e.query_id = f.query_id GROUP BY 1""")
def _(spark, sf):
    found = searched(spark, sf)
    nodes = found.select("query_id", "rank", F.col("collection").alias("type"), F.col("document_id").cast("string").alias("name"),
                         F.lit("s").alias("description"))
    edges = found.select("query_id", "rank", F.col("collection").alias("src"), F.lit("HOLDS").alias("type"), F.col("document_id").cast("string").alias("dst"))
    out = tx.grounding_context(found, search_documents(spark, sf), nodes, edges)
    return out.select("query_id", F.md5("context").alias("context"))


# --- questions ---------------------------------------------------------------

_q = "'Why is t' || (1000 + doc_id % 9000) || '.001 linked to ir-s3-00' || (doc_id % 7) || ' and IOC-IAM-01? ' || text"


def questions(spark, sf):
    d = F.col("doc_id")
    text = F.concat(F.lit("Why is t"), (1000 + d % 9000).cast("string"), F.lit(".001 linked to ir-s3-00"), (d % 7).cast("string"),
                    F.lit(" and IOC-IAM-01? "), "text")
    return adapter.table(spark, sf, "documents").select("doc_id", text.alias("question"))


@query("extract_entities", f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(q, '\\bT\\d{{4}}(?:\\.\\d{{3}})?\\b'),
    regexp_extract_all(q, '\\bIR-[A-Z0-9]+-\\d+\\b')), regexp_extract_all(q, '\\bIOC-[A-Z0-9]+-\\d+\\b')))), ';') AS entities,
  len(list_filter(regexp_split_to_array(replace(lower(t), '-', ' '), '\\s+'), lambda w: length(w) > 3 AND NOT list_contains({sql_list(vocab.QUESTION_STOP_WORDS)}, w))) AS keywords
FROM (SELECT doc_id, {_q} AS t, upper({_q}) AS q FROM documents)""")
def _(spark, sf):
    q = questions(spark, sf)
    return q.select("doc_id", F.array_join(tx.extract_entities(F.col("question")), ";").alias("entities"),
                    F.size(tx.question_keywords(F.col("question"))).alias("keywords"))


fragment("q_fnode", "SELECT type || ':' || key AS id, type, lower(key || ' ' || name) AS text FROM q_kbn WHERE type <> 'AWSService'")
fragment("q_fterm", """
SELECT c_custkey AS question_id, unnest([0, 1, 2, 3, 4]) AS pos,
  unnest(['t' || (1000 + c_nationkey), 'supplier', 't' || (1000 + c_nationkey), 'near', 'nation_' || c_nationkey]) AS term FROM customer""")
fragment("q_fhit", """
SELECT t.term, n.id, n.type FROM (SELECT DISTINCT term FROM q_fterm) t JOIN q_fnode n ON contains(n.text, t.term)
""")


@query("entity_focus", """
SELECT question_id, count(*) AS candidates, arg_max(type, p) AS focus_type FROM (
  SELECT t.question_id, h.id, h.type, any_value(CASE h.type WHEN 'MITRETechnique' THEN 5 WHEN 'DetectionPattern' THEN 4 WHEN 'Playbook' THEN 3 ELSE 0 END) AS p
  FROM q_fterm t JOIN q_fhit h ON h.term = t.term GROUP BY 1, 2, 3) GROUP BY 1""")
def _(spark, sf):
    from auditmill.plans.queries_graph import kb_nodes
    c = adapter.table(spark, sf, "customer")
    nation = F.col("c_nationkey")
    text = F.concat(F.lit("find supplier T"), (1000 + nation).cast("string"), F.lit(" near nation_"), nation.cast("string"))
    nodes = kb_nodes(spark, sf).filter("type <> 'AWSService'").select("id", "type", F.lower(F.concat_ws(" ", "key", "name")).alias("text"))
    return tx.entity_focus(c.select(F.col("c_custkey").alias("question_id"), text.alias("text")), nodes)


_route = " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in vocab.QUERY_TYPE_WORDS.items())


@query("classify_query", f"""
SELECT 'documents' AS source, doc_id AS id, CASE {_route} ELSE 'general_soc' END AS query_type FROM (SELECT doc_id, lower(text) AS t FROM documents)
UNION ALL SELECT 'conversations', conv_id * 1000 + turn, CASE {_route} ELSE 'general_soc' END FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)""")
def _(spark, sf):
    kind = tx.classify_query(F.col("text")).alias("query_type")
    docs = adapter.table(spark, sf, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), kind)
    conv = adapter.table(spark, sf, "conversations").select(
        F.lit("conversations").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), kind)
    return docs.unionByName(conv)


@query("technique_lookup", """
SELECT 'tactic' AS lookup, 'T' || (1000 + n_nationkey) AS id, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) = 'asia'
UNION ALL SELECT 'technique', 'T' || (1000 + n_nationkey), n_name FROM nation WHERE n_nationkey = 7
UNION ALL SELECT 'playbook', 'IR-PART-' || p_partkey, p_name FROM part WHERE p_partkey = 11""")
def _(spark, sf):
    t = adapter.kb_tables(spark, sf)
    row = lambda df, n, c: df.select(F.lit(n).alias("lookup"), F.col(c).alias("id"), "name")
    return (row(tx.techniques_by_tactic(t["techniques"], "ASIA"), "tactic", "technique_id")
            .unionByName(row(tx.technique_by_id(t["techniques"], "T1007"), "technique", "technique_id"))
            .unionByName(row(tx.playbook_by_id(t["playbooks"], "IR-PART-11"), "playbook", "playbook_id")))


# --- attack bundle -----------------------------------------------------------


def attack_objects(spark, sf):
    """Parts as attack objects, with revoked ones, other kinds and repeated platforms."""
    k = F.col("p_partkey")
    tid = F.when(k % 5 == 0, "T1098").when(k % 5 == 1, "T1530").otherwise(F.concat(F.lit("T"), (2000 + k).cast("string")))
    return adapter.table(spark, sf, "part").select(
        F.when(k % 11 == 0, "malware").otherwise("attack-pattern").alias("type"), F.col("p_name").alias("name"),
        F.repeat(F.concat("p_type", F.lit(" "), "p_brand", F.lit(" ")), (k % 90).cast("int")).alias("description"),
        F.when(k % 7 == 0, True).alias("revoked"), (k % 13 == 0).alias("x_mitre_deprecated"),
        F.array(F.when(k % 3 == 0, "AWS").when(k % 3 == 1, "Windows").otherwise("SaaS"), F.when(k % 2 == 0, "IaaS").otherwise("Linux")).alias("x_mitre_platforms"),
        F.lit("Watch calls").alias("x_mitre_detection"), (k % 4 == 0).alias("x_mitre_is_subtechnique"),
        F.array(F.struct(F.lit("mitre-attack").alias("kill_chain_name"), F.concat(F.lit("tactic-"), (k % 6).cast("string")).alias("phase_name")),
                F.struct(F.lit("other").alias("kill_chain_name"), F.lit("x").alias("phase_name"))).alias("kill_chain_phases"),
        F.array(F.struct(F.lit("capec").alias("source_name"), F.lit("C1").alias("external_id"), F.lit("c").alias("url")),
                F.struct(F.lit("mitre-attack").alias("source_name"), tid.alias("external_id"), F.concat(F.lit("u/"), tid).alias("url"))).alias("external_references"))


def write_documents(rows, path, field=None, per_file=5000):
    """JSON array documents of bounded size; with ``field`` each is an object that holds the array."""
    n = F.lit(per_file)
    part = F.pmod(F.xxhash64(F.to_json(F.struct(*rows.columns))), F.greatest(F.ceil(rows.agg(F.count(F.lit(1))).scalar() / n), F.lit(1)))
    items = F.collect_list(F.struct(*rows.columns))
    doc = F.to_json(F.struct(items.alias(field)) if field else items)
    rows.groupBy(part.alias("p")).agg(doc.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)


def techniques_parsed(spark, sf):
    path = scratch_path(spark, "bundle")
    write_documents(attack_objects(spark, sf), path, "objects")
    return tx.parse_attack_bundle(tx.read_attack_bundle(spark, path))


_events = " ".join(f"WHEN '{t}' THEN '{';'.join(e)}'" for t, e in vocab.TECHNIQUE_EVENTS.items())
fragment("q_stix", f"""
SELECT id AS technique_id, p_name AS name, CASE WHEN length(d) > 1000 THEN left(d, 1000) || '...' ELSE d END AS description,
  'tactic-' || (k % 6) AS tactics, array_to_string(list_sort([a, b]), ';') AS platforms, 'u/' || id AS url, k % 4 = 0 AS is_subtechnique,
  coalesce(CASE id {_events} END, '') AS aws_indicators
FROM (SELECT *, p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'T1098' WHEN 1 THEN 'T1530' ELSE 'T' || (2000 + p_partkey) END AS id,
  repeat(p_type || ' ' || p_brand || ' ', p_partkey % 90) AS d, CASE p_partkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'windows' ELSE 'saas' END AS a,
  CASE p_partkey % 2 WHEN 0 THEN 'iaas' ELSE 'linux' END AS b FROM part)
WHERE k % 11 <> 0 AND k % 7 <> 0 AND k % 13 <> 0 AND (a <> 'windows' OR b = 'iaas')""")


@query("parse_attack_bundle", "SELECT * FROM q_stix")
def _(spark, sf):
    out = techniques_parsed(spark, sf).drop("detection")
    return out.withColumns({c: F.array_join(c, ";") for c in ("tactics", "platforms", "aws_indicators")})


@query("tactic_summary", """
SELECT 'total' AS kind, 'total' AS item, count(*) AS techniques FROM q_stix
UNION ALL SELECT 'total', 'aws', count(*) FILTER (contains(platforms, 'aws')) FROM q_stix
UNION ALL SELECT 'total', 'iaas', count(*) FILTER (contains(platforms, 'iaas')) FROM q_stix
UNION ALL SELECT 'total', 'with_events', count(*) FILTER (aws_indicators <> '') FROM q_stix
UNION ALL SELECT * FROM (SELECT 'tactic', tactics, count(*) AS n FROM q_stix GROUP BY 2 ORDER BY n DESC, tactics LIMIT 5)""")
def _(spark, sf):
    return tx.tactic_summary(techniques_parsed(spark, sf))


@query("read_knowledge_base", """
SELECT 'pattern' AS kind, 'IOC-SUP-' || s_suppkey AS id, s_name AS name FROM supplier
UNION ALL SELECT 'playbook', 'IR-PART-' || p_partkey, p_name FROM part
UNION ALL SELECT 'technique', 'T' || (1000 + n_nationkey), n_name FROM nation
UNION ALL SELECT 'service', 'Zone ' || r_name, 'High' FROM region
UNION ALL SELECT 'detected-by', 'T' || (1000 + n_nationkey), 'IOC-SUP-' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT DISTINCT 'triggers', 'IOC-SUP-' || l_suppkey, 'IR-PART-' || l_partkey FROM lineitem
UNION ALL SELECT 'Affects', 'T' || (1000 + n_nationkey), 'Zone ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'often enables', 'T' || (1000 + n_nationkey), 'T' || (1005 + n_nationkey) FROM nation
UNION ALL SELECT 'buys', 'IOC-SUP-' || c_custkey, 'IR-PART-' || c_custkey FROM customer""")
def _(spark, sf):
    t = adapter.kb_tables(spark, sf)
    blank = t["patterns"].withColumn("pattern_id", F.lit(""))  # rows without an id are dropped on reading
    out = None
    for kind, key, rows in (("pattern", "pattern_id", t["patterns"].unionByName(blank)), ("playbook", "playbook_id", t["playbooks"]),
                            ("technique", "technique_id", t["techniques"]), ("service", "service_name", t["services"])):
        path = scratch_path(spark, f"kb-{kind}")
        write_documents(rows, path)
        one = tab.read_knowledge_base(spark, path, kind).select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col("security_sensitivity" if kind == "service" else "name").alias("name"))
        out = one if out is None else out.unionByName(one)
    path = scratch_path(spark, "kb-relations")
    write_documents(t["relations"], path, "relationships")
    rel = tab.read_relations(spark, path)
    return out.unionByName(rel.select(F.col("relationship").alias("kind"), F.col("source_entity").alias("id"), F.col("target_entity").alias("name")))


# --- evaluation: ranking -----------------------------------------------------


def ranking(spark, sf):
    """The ten nearest other points of every point; relevant = same class."""
    def build():
        pts = adapter.points(spark, sf)
        near = knn_join(pts, pts, 10, metric="cosine", exclude_self=True)
        label = lambda c: pts.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
        rows = near.join(label("query_id"), "query_id").join(label("neighbor_id"), "neighbor_id")
        hit = F.col("query_id_label") == F.col("neighbor_id_label")
        return rows.select("query_id", "rank", F.col("neighbor_id").alias("item_id"), hit.alias("is_relevant"),
                           F.when(hit, F.round(1.0 - F.col("distance"), 4)).otherwise(F.lit(0.0)).alias("relevance"))
    return adapter.stage(spark, sf, "ranking", build)


def totals(spark, sf):
    pts = adapter.points(spark, sf)
    sizes = pts.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    return pts.join(sizes, "label").select(F.col("id").alias("query_id"), "n_relevant")


fragment("q_rank", """
SELECT q.id AS query_id, b.id AS item_id, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.v, b.v) DESC, b.id) AS rank,
  q.label = b.label AS is_relevant, CASE WHEN q.label = b.label THEN round(list_cosine_similarity(q.v, b.v), 4) ELSE 0.0 END AS relevance
FROM q_pt q CROSS JOIN q_pt b WHERE q.id <> b.id QUALIFY rank <= 10""")


@query("precision_at_k", "SELECT query_id, count(*) FILTER (is_relevant AND rank <= 5) / 5.0 AS precision FROM q_rank GROUP BY 1")
def _(spark, sf):
    return ev.precision_at_k(ranking(spark, sf))


@query("recall_at_k", """
SELECT query_id, round(CASE WHEN any_value(t.n) > 0 THEN count(*) FILTER (is_relevant AND rank <= 5) / CAST(any_value(t.n) AS DOUBLE) ELSE 0.0 END, 6) AS recall
FROM q_rank r JOIN (SELECT id, count(*) OVER (PARTITION BY label) - 1 AS n FROM q_pt) t ON t.id = r.query_id GROUP BY 1""")
def _(spark, sf):
    out = ev.recall_at_k(ranking(spark, sf), totals(spark, sf))
    return out.withColumn("recall", F.round("recall", 6))


@query("mrr", """
SELECT query_id, round(coalesce(1.0 / min(rank) FILTER (is_relevant), 0.0), 6) AS reciprocal_rank FROM q_rank GROUP BY 1""")
def _(spark, sf):
    return ev.mrr(ranking(spark, sf)).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@query("ndcg_at_k", """
SELECT query_id, round(CASE WHEN idcg > 0 THEN least(greatest(dcg / idcg, 0.0), 1.0) ELSE 0.0 END, 5) AS ndcg FROM (
  SELECT query_id, sum(CASE WHEN rank <= 5 THEN relevance / log2(rank + 1) ELSE 0.0 END) AS dcg,
    sum(CASE WHEN best <= 5 THEN relevance / log2(best + 1) ELSE 0.0 END) AS idcg
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS best FROM q_rank) GROUP BY 1)""")
def _(spark, sf):
    return ev.ndcg_at_k(ranking(spark, sf)).withColumn("ndcg", F.round("ndcg", 5))


@query("context_precision_recall", """
SELECT conv_id, turn, round(CASE WHEN len(p) > 0 THEN len(list_intersect(t, p)) / CAST(len(p) AS DOUBLE) ELSE 0.0 END, 6) AS context_precision,
  round(CASE WHEN len(t) = 0 THEN 1.0 ELSE len(list_intersect(t, p)) / CAST(len(t) AS DOUBLE) END, 6) AS context_recall
FROM (SELECT conv_id, turn, list_distinct(list_filter(string_split(text, ' '), lambda x: x <> '')) AS t,
  list_distinct(list_filter(string_split(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), ' '), lambda x: x <> '')) AS p FROM conversations)""")
def _(spark, sf):
    from pyspark.sql import Window
    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = adapter.table(spark, sf, "conversations").withColumn("before", F.coalesce(before, F.lit("")))
    rel, got = words("text"), words("before")
    return rows.select("conv_id", "turn", F.round(ev.context_precision(rel, got), 6).alias("context_precision"),
                       F.round(ev.context_recall(rel, got), 6).alias("context_recall"))


@query("alert_rank_quality", """
WITH top AS (SELECT row_number() OVER (ORDER BY ensemble_score DESC, user_name, w) AS rank, ensemble_score / max(ensemble_score) OVER () AS rel
  FROM (SELECT * FROM q_al ORDER BY ensemble_score DESC, user_name, w LIMIT 10))
SELECT round(count(*) FILTER (rel > 0.5 AND rank <= 5) / CAST(least(5, count(*) FILTER (rank <= 5)) AS DOUBLE), 6) AS precision,
  round(coalesce(count(*) FILTER (rel > 0.5 AND rank <= 5) / nullif(CAST(count(*) FILTER (rel > 0.5) AS DOUBLE), 0), 0.0), 6) AS recall,
  round(coalesce(1.0 / min(rank) FILTER (rel > 0.5), 0.0), 6) AS reciprocal_rank, round(least(sum(CASE WHEN rank <= 5 THEN rel / log2(rank + 1) END)
  / sum(CASE WHEN rank <= 5 THEN rel / log2(rank + 1) END), 1.0), 6) AS ndcg FROM top""")
def _(spark, sf):
    out = ev.alert_rank_quality(adapter.alerts(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


# --- evaluation: grounding ---------------------------------------------------


def contexts(spark, sf):
    """Answer of query i = point i + 1 (cyclic); contexts = its five nearest points."""
    pts = adapter.points(spark, sf).select("id", "vector")
    n = pts.agg(F.count(F.lit(1))).scalar()
    answer = pts.select("id", F.col("vector").alias("query_vector")).withColumn("n", n).withColumn("a", F.pmod(F.col("id") + 1, F.col("n"))).join(
        pts.select(F.col("id").alias("a"), F.col("vector").alias("answer_vector")), "a").select(
        F.col("id").alias("query_id"), "query_vector", "answer_vector")
    found = ranking(spark, sf).filter("rank <= 5").join(
        pts.select(F.col("id").alias("item_id"), F.col("vector").alias("context_vector")), "item_id")
    return answer, ev.context_similarity(found.join(answer.drop("query_vector"), "query_id"))


fragment("q_ans", "SELECT q.id AS query_id, q.v AS qv, a.v AS av FROM q_pt q JOIN q_pt a ON a.id = (q.id + 1) % (SELECT count(*) FROM q_pt)")
fragment("q_ctx", """
SELECT r.query_id, list_cosine_similarity(a.av, c.v) AS s FROM q_rank r JOIN q_ans a ON a.query_id = r.query_id JOIN q_pt c ON c.id = r.item_id WHERE r.rank <= 5""")
_faith = "CASE WHEN max(s) >= 0.5 THEN least(max(s), 1.0) ELSE max(s) * 0.5 END"
_used = "avg(CAST(s > 0.3 AS INT))"


def _grounding(name, column, sql, build):
    @query(name, f"SELECT query_id, round({sql}, 5) AS {column} FROM q_ctx GROUP BY 1")
    def run(spark, sf):
        return build(contexts(spark, sf)[1]).withColumn(column, F.round(column, 5))


_grounding("faithfulness", "faithfulness", _faith, ev.faithfulness)
_grounding("context_utilization", "context_utilization", _used, ev.context_utilization)
_grounding("grounded_precision", "grounded_precision", f"0.6 * {_faith} + 0.4 * {_used}", ev.grounded_precision)


@query("answer_relevance", """
SELECT query_id, round(least(greatest(list_cosine_similarity(qv, av), 0.0), 1.0), 5) AS answer_relevance FROM q_ans""")
def _(spark, sf):
    return ev.answer_relevance(contexts(spark, sf)[0]).withColumn("answer_relevance", F.round("answer_relevance", 5))


# --- evaluation: reports -----------------------------------------------------

CLASS_LINES = ["privesc", "exfiltration", "insider", "recon", "backdoor", "unknown", "reconnaissance"]


def reports(spark, sf):
    """Conversation turns as incident blocks, twenty to a report."""
    c, t = F.col("conv_id"), F.col("turn")
    s = lambda x: x.cast("string")
    pick = lambda items, n: F.element_at(F.array(*[F.lit(i) for i in items]), (n % len(items) + 1).cast("int"))
    header = F.concat(
        F.lit("INCIDENT #"), s(t), F.lit(" | "), pick(["HIGH", "LOW", "Notice"], t), F.lit(" | User: user-"), s(c), F.lit(" | Score: 0."), s(t + 1),
        F.lit("\nMITRE TECHNIQUES:\n  T1098: one\n  T"), s(1085 + t), F.lit(": two\nPLAYBOOKS TRIGGERED:\n  IR-S3-001: a\n  IR-IAM-00"), s(t % 3 + 1),
        F.lit(": b\nDETECTION PATTERNS: "), "text", F.lit("\n"))
    body = F.when(F.col("role") == "assistant", F.concat(
        F.lit("LLM ANALYSIS:\n"), F.when(t % 2 == 1, F.concat(F.lit("ATTACK CLASSIFICATION: "), pick(CLASS_LINES, c + t), F.lit("\n"))).otherwise(F.lit("")),
        "text", F.lit("\nDisable the access key of the suspicious user, see T"), s(1085 + t), F.lit(" and IR-S3-001\n")))
    body = body.when(F.col("role") == "user", F.lit("LLM ANALYSIS:\n(LLM unavailable - start it)\n")).otherwise(F.lit(""))
    rows = adapter.table(spark, sf, "conversations").select(
        c, t, F.concat(header, body).alias("block"), (F.floor(t / 20)).alias("part"))
    return rows.groupBy(F.concat(c.cast("string"), F.lit("-"), F.col("part").cast("string")).alias("report")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "block"))).alias("b")).select(
        "report", F.concat(F.lit("=====\n"), F.array_join(F.transform("b", lambda x: x["block"]), "")).alias("content"))


def incidents(spark, sf):
    return ev.parse_incidents(reports(spark, sf)).withColumn("key", F.concat_ws(
        "#", "user", F.regexp_extract("full", r"INCIDENT #(\d+)", 1)))


_pick = lambda items, n: f"list_extract({sql_list(items)}, CAST(({n}) % {len(items)} + 1 AS BIGINT))"
fragment("q_inc", f"""
SELECT *, header || CASE role WHEN 'assistant' THEN 'LLM ANALYSIS:' || chr(10) || raw || chr(10)
  WHEN 'user' THEN 'LLM ANALYSIS:' || chr(10) || '(LLM unavailable - start it)' || chr(10) ELSE '' END AS "full",
  CASE WHEN role = 'assistant' AND NOT contains(lower(raw), 'ollama') THEN regexp_replace(regexp_replace(raw, '^\\s+', ''), '\\s+$', '') ELSE '' END AS llm
FROM (SELECT conv_id, turn, role, 'user-' || conv_id AS "user", '0.' || (turn + 1) AS score, 'user-' || conv_id || '#' || turn AS key,
  'INCIDENT #' || turn || ' | ' || {_pick(['HIGH', 'LOW', 'Notice'], 'turn')} || ' | User: user-' || conv_id || ' | Score: 0.' || (turn + 1) || chr(10)
  || 'MITRE TECHNIQUES:' || chr(10) || '  T1098: one' || chr(10) || '  T' || (1085 + turn) || ': two' || chr(10) || 'PLAYBOOKS TRIGGERED:' || chr(10)
  || '  IR-S3-001: a' || chr(10) || '  IR-IAM-00' || (turn % 3 + 1) || ': b' || chr(10) || 'DETECTION PATTERNS: ' || text || chr(10) AS header,
  CASE WHEN turn % 2 = 1 THEN 'ATTACK CLASSIFICATION: ' || {_pick(CLASS_LINES, 'conv_id + turn')} || chr(10) ELSE '' END || text || chr(10)
  || 'Disable the access key of the suspicious user, see T' || (1085 + turn) || ' and IR-S3-001' AS raw FROM conversations)""")


@query("read_reports", """
SELECT md5(content) AS content, length(content) AS chars, CAST(NULL AS VARCHAR) AS timestamp FROM (SELECT conv_id, turn // 20 AS part, '=====' || chr(10) || string_agg("full", '' ORDER BY turn) || chr(10) AS content
  FROM q_inc GROUP BY 1, 2)""")
def _(spark, sf):
    path = scratch_path(spark, "reports")
    reports(spark, sf).select(F.concat(F.lit("incident_report_"), "report").alias("name"), "content").write.partitionBy("name").option(
        "maxRecordsPerFile", 1).text(path)
    back = tab.read_reports(spark, path, glob="part-*.txt")
    return back.select(F.md5("content").alias("content"), F.length("content").alias("chars"), "timestamp")


@query("parse_incidents", 'SELECT key, "user", score, md5(header) AS header, md5(llm) AS llm, md5("full") AS "full" FROM q_inc')
def _(spark, sf):
    return incidents(spark, sf).select("key", "user", "score", *[F.md5(c).alias(c) for c in ("header", "llm", "full")])


_ids_sql = lambda c, p: f"list_sort(list_distinct(regexp_extract_all({c}, '{p}')))"
T4, PB = "\\bT\\d{4}\\b", "\\bIR-[A-Z0-9]+-\\d+\\b"
_acts = " OR ".join(f"contains(lower(x), '{w}')" for w in vocab.ACTION_WORDS)


@query("extract_report_ids", f"""
SELECT key, array_to_string({_ids_sql('"full"', PB)}, ';') AS playbooks, array_to_string({_ids_sql('"full"', T4)}, ';') AS techniques,
  CASE {' '.join(f"WHEN contains(upper({chr(34)}full{chr(34)}), '{w}') THEN '{w}'" for w in vocab.SEVERITY_WORDS)} END AS severity,
  len(list_filter(string_split("full", chr(10)), lambda x: ({_acts}) AND trim(x) <> '' AND length(x) > 10)) AS actions FROM q_inc""")
def _(spark, sf):
    out = ev.extract_report_ids(incidents(spark, sf), "full")
    return out.select("key", F.array_join("playbooks", ";").alias("playbooks"), F.array_join("techniques", ";").alias("techniques"),
                      "severity", F.size("actions").alias("actions"))


_share = lambda c, ws: "(" + " + ".join(f"CAST(contains(lower({c}), '{w}') AS INT)" for w in ws) + ")"
fragment("q_cite", f"""
SELECT key, CASE WHEN NOT has THEN 0.0 WHEN len(ht) > 0 THEN len(list_intersect(ht, lt)) / CAST(len(ht) AS DOUBLE)
    ELSE {_share('llm', vocab.GROUNDING_WORDS)} / {float(len(vocab.GROUNDING_WORDS))} END AS faithfulness,
  CASE WHEN has THEN {_share('llm', vocab.ANSWER_WORDS)} / {float(len(vocab.ANSWER_WORDS))} ELSE 0.0 END AS answer_relevance,
  CASE WHEN NOT has THEN 0.0 WHEN len(list_intersect(ht, lt)) + len(list_intersect(hb, lb)) = 0
    THEN least({_share('llm', vocab.USAGE_WORDS)} / {len(vocab.USAGE_WORDS) * 0.6}, 0.6)
    ELSE least((len(list_intersect(ht, lt)) + len(list_intersect(hb, lb))) / CAST(greatest(len(ht) + len(hb), 1) AS DOUBLE), 1.0) END AS context_utilization
FROM (SELECT *, length(trim(llm)) > 50 AS has, {_ids_sql('header', T4)} AS ht, {_ids_sql('llm', T4)} AS lt, {_ids_sql('header', PB)} AS hb, {_ids_sql('llm', PB)} AS lb FROM q_inc)""")


@query("citation_metrics", """
SELECT key, round(faithfulness, 6) AS faithfulness, round(answer_relevance, 6) AS answer_relevance, round(context_utilization, 6) AS context_utilization FROM q_cite""")
def _(spark, sf):
    out = ev.citation_metrics(incidents(spark, sf))
    return out.select("key", *[F.round(c, 6).alias(c) for c in ("faithfulness", "answer_relevance", "context_utilization")])


@query("citation_metrics_mean", """
SELECT count(*) AS incidents, round(avg(faithfulness), 6) AS faithfulness, round(avg(answer_relevance), 6) AS answer_relevance,
  round(avg(context_utilization), 6) AS context_utilization FROM q_cite""")
def _(spark, sf):
    names = ["faithfulness", "answer_relevance", "context_utilization"]
    out = ev.mean_metrics(ev.citation_metrics(incidents(spark, sf)), names)
    return out.select("incidents", *[F.round(c, 6).alias(c) for c in names])


fragment("q_truth", 'SELECT user_name AS "user", arg_max(attack_name, (ensemble_score, -epoch_us(w))) AS truth FROM q_al GROUP BY 1')
fragment("q_terms", sql_values([(a, t) for a, ts in vocab.EXPECTED_TERMS.items() for t in ts], ["attack", "term"]))


@query("expected_term_coverage", """
SELECT i.key, t.truth, round(avg(CAST(contains(lower(i.header), e.term) AS INT)), 6) AS context_precision,
  round(avg(CAST(contains(lower(i."full"), e.term) AS INT)), 6) AS context_recall
FROM q_inc i JOIN q_truth t ON t."user" = i."user" JOIN q_terms e ON e.attack = t.truth GROUP BY 1, 2""")
def _(spark, sf):
    out = ev.expected_term_coverage(incidents(spark, sf), ev.user_truth(adapter.alerts(spark, sf)))
    return out.select("key", "truth", F.round("context_precision", 6).alias("context_precision"), F.round("context_recall", 6).alias("context_recall"))


@query("expected_term_coverage_mean", """
SELECT count(*) AS incidents, round(avg(p), 6) AS context_precision, round(avg(r), 6) AS context_recall FROM (
  SELECT i.key, avg(CAST(contains(lower(i.header), e.term) AS INT)) AS p, avg(CAST(contains(lower(i."full"), e.term) AS INT)) AS r
  FROM q_inc i JOIN q_truth t ON t."user" = i."user" JOIN q_terms e ON e.attack = t.truth GROUP BY 1)""")
def _(spark, sf):
    names = ["context_precision", "context_recall"]
    out = ev.mean_metrics(ev.expected_term_coverage(incidents(spark, sf), ev.user_truth(adapter.alerts(spark, sf))), names)
    return out.select("incidents", *[F.round(c, 6).alias(c) for c in names])


def _class_sql(c):
    scan = " ".join("WHEN " + " OR ".join(f"regexp_matches(lower({c}), '{p}')" for p in ps) + f" THEN '{k}'" for k, ps in vocab.CLASS_PATTERNS.items())
    stated = f"lower(regexp_extract({c}, '(?i)ATTACK CLASSIFICATION[:\\s]+(\\w+)', 1))"
    named = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in vocab.CLASS_ALIASES.items())
    return f"CASE WHEN {stated} IN {tuple([*vocab.CLASS_ALIASES, 'unknown'])} THEN CASE {stated} {named} END ELSE CASE {scan} END END"


fragment("q_cls", f"""
SELECT i.*, coalesce(CASE WHEN llm <> '' THEN {_class_sql('llm')} END, {_class_sql('"full"')}, 'unknown') AS predicted, coalesce(t.truth, 'normal') AS truth
FROM q_inc i LEFT JOIN q_truth t ON t."user" = i."user" """)


def classified(spark, sf):
    return ev.with_truth(ev.classify_incident(incidents(spark, sf)), ev.user_truth(adapter.alerts(spark, sf)))


@query("classify_incident", "SELECT key, predicted, truth FROM q_cls")
def _(spark, sf):
    return classified(spark, sf).select("key", "predicted", "truth")


@query("classification_accuracy", "SELECT count(*) AS incidents, round(avg(CAST(predicted = truth AS INT)), 6) AS accuracy FROM q_cls")
def _(spark, sf):
    return ev.classification_accuracy(classified(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


def with_playbooks(spark, sf):
    rows = classified(spark, sf)
    return rows.select("user", "truth", ev.playbook_ids(F.col("header")).alias("predicted_playbooks"),
                       ev.expected_playbooks(F.col("truth")).alias("truth_playbooks"))


_pbs = " ".join(f"WHEN '{a}' THEN {sql_list(p)}" for a, p in vocab.ATTACK_PLAYBOOKS.items())
fragment("q_pbs", f"""
SELECT truth, {_ids_sql('header', PB)} AS p, coalesce(CASE truth {_pbs} END, CAST([] AS VARCHAR[])) AS t FROM q_cls""")


@query("playbook_accuracy", "SELECT round(avg(CAST(len(list_intersect(p, t)) > 0 AS INT)), 6) AS accuracy FROM q_pbs")
def _(spark, sf):
    return ev.playbook_accuracy(with_playbooks(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@query("playbook_jaccard", """
SELECT round(avg(CASE WHEN len(t) > 0 THEN len(list_intersect(p, t)) / CAST(len(list_distinct(list_concat(p, t))) AS DOUBLE) END), 6) AS jaccard FROM q_pbs""")
def _(spark, sf):
    return ev.playbook_jaccard(with_playbooks(spark, sf)).withColumn("jaccard", F.round("jaccard", 6))


# --- evaluation: operations --------------------------------------------------

SUITE = ["precision", "recall", "f1_score", "accuracy", "fpr", "specificity"]


def suite_sql(source, pred, truth, keys=""):
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    div = lambda a, b: f"round(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END, 6)"
    return f"""
SELECT {k}tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives, {div('tp', 'tp + fp')} AS precision,
  {div('tp', 'tp + fn')} AS recall, {div('2 * tp', '2 * tp + fp + fn')} AS f1_score, {div('tp + tn', 'tp + fp + tn + fn')} AS accuracy,
  {div('fp', 'fp + tn')} AS fpr, {div('tn', 'tn + fp')} AS specificity
FROM (SELECT {k}count(*) FILTER ({pred} AND {truth}) AS tp, count(*) FILTER ({pred} AND NOT {truth}) AS fp,
  count(*) FILTER (NOT {pred} AND NOT {truth}) AS tn, count(*) FILTER (NOT {pred} AND {truth}) AS fn FROM {source} {g})"""


@query("confusion_suite", suite_sql("labels", "(1 - quality = 1)", "(toxic = 1)"))
def _(spark, sf):
    out = ev.confusion_suite(adapter.table(spark, sf, "labels"), F.col("quality") == 0, F.col("toxic") == 1)
    return out.withColumns({c: F.round(c, 6) for c in SUITE})


def incident_table(spark, sf):
    """Orders as incidents: month, analyst, minutes and outcome."""
    o = adapter.table(spark, sf, "orders")
    return o.select(
        F.date_format("o_orderdate", "yyyy-MM").alias("period"), (F.col("o_custkey") % 25).alias("analyst"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 45).cast("double").alias("detect_minutes"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 120).cast("double").alias("contain_minutes"),
        (15 + F.col("o_orderkey") % 10).cast("double").alias("manual_minutes"), (2 + F.col("o_custkey") % 5).cast("double").alias("automated_minutes"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("flagged"), (F.col("o_orderstatus") == "F").alias("is_attack"))


fragment("q_ops", """
SELECT strftime(o_orderdate, '%Y-%m') AS period, o_custkey % 25 AS analyst, CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 45 END AS detect,
  CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 120 END AS contain, 15 + o_orderkey % 10 AS manual, 2 + o_custkey % 5 AS automated,
  o_orderpriority IN ('1-URGENT', '2-HIGH') AS flagged, o_orderstatus = 'F' AS is_attack FROM orders""")


@query("response_times", """
SELECT period, round(coalesce(avg(detect), 'Infinity'::DOUBLE), 6) AS mttd, round(coalesce(avg(contain), 'Infinity'::DOUBLE), 6) AS mttc FROM q_ops GROUP BY 1""")
def _(spark, sf):
    out = ev.response_times(incident_table(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("mttd", "mttc")})


@query("operations_kpis", f"""
SELECT b.period, round(saved, 6) AS time_reduction, round(per, 6) AS incidents_per_analyst,
  round(least(greatest(0.25 * s.precision + 0.35 * s.recall + 0.20 * saved + 0.20 * (1.0 - least(mttd / 30.0, 1.0)), 0.0), 1.0), 4) AS efficiency
FROM (SELECT period, least(greatest((avg(manual) - avg(automated)) / avg(manual), 0.0), 1.0) AS saved, count(*) / CAST(count(DISTINCT analyst) AS DOUBLE) AS per,
  avg(detect) AS mttd FROM q_ops GROUP BY 1) b JOIN ({suite_sql('q_ops', 'flagged', 'is_attack', 'period')}) s ON s.period = b.period""")
def _(spark, sf):
    out = ev.operations_kpis(incident_table(spark, sf))
    return out.select("period", F.round("time_reduction", 6).alias("time_reduction"),
                      F.round("incidents_per_analyst", 6).alias("incidents_per_analyst"), F.round("efficiency", 4).alias("efficiency"))


_fam = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(vocab.METRIC_FAMILY_WEIGHTS))
_avg = lambda f: f"coalesce(avg(value) FILTER (family = '{f}'), 0.0)"


@query("overall_score", "SELECT run, " + ", ".join(f"round({_avg(f)}, 6) AS avg_{f}_score" for f in vocab.METRIC_FAMILY_WEIGHTS)
       + ", round(" + " + ".join(f"{w} * {_avg(f)}" for f, w in vocab.METRIC_FAMILY_WEIGHTS.items()) + f""", 6) AS overall_system_score
FROM (SELECT o_orderpriority AS run, CASE o_orderkey % 4 {_fam} END AS family, (o_custkey % 100) / 100.0 AS value FROM orders) GROUP BY 1""")
def _(spark, sf):
    k = F.col("o_orderkey") % 4
    family = F
    for i, f in enumerate(vocab.METRIC_FAMILY_WEIGHTS):
        family = family.when(k == i, f)
    rows = adapter.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("run"), family.alias("family"), ((F.col("o_custkey") % 100) / 100.0).alias("value"))
    out = ev.overall_score(rows)
    return out.select("run", *[F.round(c, 6).alias(c) for c in out.columns if c != "run"])


# --- streaming ---------------------------------------------------------------


def _log_folder(spark, sf):
    path = scratch_path(spark, "stream-json")
    src.write_audit_json_buckets(adapter.raw_events(spark, sf), path, 1440, 50_000)
    return path


@query("stream_ingest", "SELECT eventID, eventTime, eventName, user_name, is_error FROM q_flat")
def _(spark, sf):
    out = scratch_path(spark, "stream-events")
    st.run_to_table(st.read_audit_stream(spark, _log_folder(spark, sf), 10), out, scratch_path(spark, "checkpoint"))
    return spark.read.parquet(out).select("eventID", "eventTime", "eventName", "user_name", "is_error")


def _event_files(spark, sf):
    path = scratch_path(spark, "event-files")
    # time-ordered files, so that no event is later than the watermark allows
    adapter.events(spark, sf).repartitionByRange(8, "eventTime").sortWithinPartitions("eventTime").write.parquet(path)
    return path


def _events_stream(spark, sf, path):
    return spark.readStream.schema(adapter.events(spark, sf).schema).parquet(path)


STREAM_COUNTS = ["total_events", *ft.FLAG_COUNTS, *st.DISTINCT_COUNTS]


@query("stream_window_counts", f"""
SELECT user_name, {W}, {', '.join(STREAM_COUNTS)}, round(write_ratio, 6) AS write_ratio, round(bytes_out_total, 4) AS bytes_out_total FROM q_wf
WHERE w + INTERVAL {adapter.FINE_MINUTES} MINUTE <= (SELECT date_trunc('milliseconds', max(eventTime)) - INTERVAL 10 MINUTE FROM q_ev)""")
def _(spark, sf):
    events = adapter.events(spark, sf)
    out, source = scratch_path(spark, "stream-windows"), scratch_path(spark, "event-files")
    slices = st.time_slices(events, scratch_path(spark, "event-slices"))
    counted = lambda stream: st.stream_window_counts(stream, adapter.FINE_MINUTES, "10 minutes")
    st.replay(slices, source, counted, out, scratch_path(spark, "checkpoint"))
    return spark.read.schema(counted(_events_stream(spark, sf, source)).schema).parquet(out).select(
        "user_name", "window", *STREAM_COUNTS, F.round("write_ratio", 6).alias("write_ratio"),
        F.round("bytes_out_total", 4).alias("bytes_out_total"))


@query("stream_dedup", "SELECT eventID, eventName FROM q_ev")
def _(spark, sf):
    path, out = _event_files(spark, sf), scratch_path(spark, "stream-dedup")
    spark.read.schema(adapter.events(spark, sf).schema).parquet(path).write.mode("append").parquet(path)  # every event twice
    st.run_to_table(st.stream_dedup(_events_stream(spark, sf, path), "31 days"), out, scratch_path(spark, "checkpoint"))
    return spark.read.parquet(out).select("eventID", "eventName")


@query("stream_alerts", f"""
SELECT f.user_name, f.{W}, f.total_events, round((f.total_events - b.total_events_mean) / b.total_events_std, 5) AS score
FROM q_wf f JOIN q_base b USING (user_name) WHERE (f.total_events - b.total_events_mean) / b.total_events_std > 2.0""")
def _(spark, sf):
    windows = ft.user_window_counts(adapter.events(spark, sf), adapter.FINE_MINUTES)
    path, out = scratch_path(spark, "closed-windows"), scratch_path(spark, "alerts")
    windows.write.parquet(path)
    stream = spark.readStream.schema(windows.schema).option("maxFilesPerTrigger", 4).parquet(path)
    baselines = ft.user_baselines(spark.read.schema(windows.schema).parquet(path))
    st.stream_alerts(stream, baselines, 2.0, out, scratch_path(spark, "checkpoint"))
    return st.read_alerts(spark, out).select("user_name", "window", "total_events", F.round("score", 5).alias("score"))


@query("stream_model_alerts", f"""
SELECT user_name, {W}, total_events, round(score, 5) AS score FROM (
  SELECT *, CASE WHEN s > 0 THEN (total_events - m) / s ELSE 0.0 END AS score FROM (
    SELECT user_name, w, total_events, count(*) OVER b AS n, avg(total_events) OVER b AS m, stddev_pop(total_events) OVER b AS s
    FROM q_wf WINDOW b AS (PARTITION BY user_name ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
WHERE score > 2.0 AND n >= 2""")
def _(spark, sf):
    """Baselines kept as state: the later half of the windows comes after a restart."""
    windows = ft.user_window_counts(adapter.events(spark, sf), adapter.FINE_MINUTES).withColumn("total_events", F.col("total_events").cast("long"))
    path, out, checkpoint = (scratch_path(spark, n) for n in ("closed-windows", "alerts", "checkpoint"))
    all_windows = scratch_path(spark, "all-windows")
    windows.write.parquet(all_windows)
    stored = spark.read.schema(windows.schema).parquet(all_windows)
    middle = stored.select(F.timestamp_seconds(F.avg(F.unix_timestamp("window"))).alias("t")).scalar()
    for part in (stored.filter(F.col("window") <= middle), stored.filter(F.col("window") > middle)):
        part.write.mode("append").parquet(path)
        stream = spark.readStream.schema(windows.schema).parquet(path)
        st.stream_model_alerts(stream, out, checkpoint, threshold=2.0)
    return st.read_alerts(spark, out).select("user_name", "window", "total_events", F.round("score", 5).alias("score"))
