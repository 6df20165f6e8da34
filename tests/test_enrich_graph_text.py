"""Enrichment, graph, texts, evaluation and streaming on small fixtures."""

from collections import deque
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from auditmill import knowledge as kb, vocab
from auditmill.operators import alerts as al, enrich as en, evaluate as ev, features as ft, graph as gr, text as tx
from auditmill.streaming import pipeline as st

W0 = datetime(2026, 2, 23, 14, 0, tzinfo=timezone.utc)


def small_events(spark, offsets):
    rows = [(f"e{i}", "u", W0 + timedelta(seconds=s), "GetObject" if i % 2 else "PutObject", i % 2 == 0, f"b{i % 3}")
            for i, s in enumerate(offsets)]
    return spark.createDataFrame(rows, "eventID string, user_name string, eventTime timestamp, eventName string, is_error boolean, "
                                 "request_bucket_name string")


def one_alert(spark, **kw):
    base = {"user_name": "u", "window": W0, "ensemble_score": 0.9, "if_norm": 0.9, "lof_norm": 0.2, "ae_norm": 0.6, "vote_count": 1,
            "attack_name": "normal", "is_attack": False} | kw
    return spark.createDataFrame([tuple(base.values())], "user_name string, window timestamp, ensemble_score double, if_norm double, "
                                 "lof_norm double, ae_norm double, vote_count int, attack_name string, is_attack boolean")


def test_event_context_edges_are_inclusive(spark):
    ev_ = small_events(spark, [-1801, -1800, -5, 0, 299, 300, 301])
    out = en.event_context(one_alert(spark), ev_).first()
    assert (out.event_count, out.error_rate) == (5, pytest.approx(0.4)) and out.unique_resources == 3
    none = en.event_context(one_alert(spark, user_name="x"), ev_).first()
    assert (none.event_count, none.error_rate, none.unique_resources) == (0, 0.0, 0)


def test_event_hits_exclude_the_end(spark):
    ev_ = small_events(spark, [0, 299, 300])
    empty = spark.createDataFrame([], "user_name string, window timestamp, pattern_id string")
    out = en.match_via_event_hits(one_alert(spark), empty, ev_, kb.patterns(spark), kb.edges(spark)).collect()
    assert {(r.pattern_id, r.event_hits, r.match_score) for r in out} == {("IOC-S3-001", 1, 0.55), ("IOC-S3-002", 1, 0.55)}


def test_two_denominators(spark):
    pats = spark.createDataFrame([("P", {"a": {"threshold": 1.0, "direction": "above"}, "b": {"threshold": 1.0, "direction": "below"},
                                         "unknown": {"threshold": 0.0, "direction": "above"}})],
                                 "pattern_id string, indicators map<string,struct<threshold:double,direction:string>>")
    rows = spark.createDataFrame([(1, 2.0, 1.0)], "id int, a double, b double")
    hit = gr.indicator_hits(rows, ["id"], ["a", "b"], pats).first()
    assert (hit.hits, hit.comparable, hit.total, hit.matched_features) == (1, 2, 3, ["a"])


def test_rules_without_limit_or_direction(spark):
    pats = spark.createDataFrame([("P", {"a": {"threshold": 1.0, "direction": None}, "b": {"threshold": None, "direction": "below"}}),
                                  ("Q", {"a": {"threshold": 9.0, "direction": "below"}}), ("N", None)],
                                 "pattern_id string, indicators map<string,struct<threshold:double,direction:string>>")
    rows = spark.createDataFrame([(1, 2.0, 1.0), (2, None, 1.0)], "id int, a double, b double")
    out = gr.indicator_hits(rows, ["id"], ["a", "b"], pats)
    assert sorted(map(tuple, out.collect())) == [(1, "P", 2, 2, 1, ["a"]), (1, "Q", 1, 1, 1, ["a"])]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert " map(" not in plan and "map_keys" not in plan  # rows look values up by place


def test_severity_scales(spark):
    rows = spark.createDataFrame([(0.86, 0, False), (0.2, 3, True), (0.2, 3, False), (0.71, 0, False), (0.6, 1, False), (0.5, 1, False)],
                                 "ensemble_score double, vote_count int, c boolean")
    got = [r[0] for r in rows.select(en.alert_severity(F.col("c"))).collect()]
    assert got == ["CRITICAL", "CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW"]
    assert [r[0] for r in spark.createDataFrame([(0.7,), (0.3,), (0.29,)], "s double").select(al.severity(F.col("s"))).collect()] == ["high", "medium", "low"]


def test_user_filter_is_a_pattern(spark):
    assert al.filter_alerts(one_alert(spark, user_name="Eve-Analyst"), "eve.*LYST").count() == 1
    assert al.alert_lookup(one_alert(spark), "u", W0).count() == 1


def reference_bfs(nodes, edges, start):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    targets = {n for n, t in nodes if t in gr.TRACE_TARGETS and n != start}
    seen, todo = {start: 0}, deque([start])
    while todo:
        c = todo.popleft()
        for x in near.get(c, ()):
            if x not in seen:
                seen[x] = seen[c] + 1
                todo.append(x)
    found = sorted((seen[t], t) for t in targets if t in seen)
    return found[0] if found else None


def test_trace_matches_breadth_first_search(spark):
    import random
    rnd = random.Random(5)
    kinds = ["User", "Window", "Window", "Window", "Playbook", "MITRETechnique"]
    nodes = [(f"n{i:02d}", kinds[i % 6] if rnd.random() < 0.4 else "Window") for i in range(60)]
    edges = [(f"n{rnd.randrange(60):02d}", f"n{rnd.randrange(60):02d}") for _ in range(62)]
    nd = spark.createDataFrame([(i, t, i, i) for i, t in nodes], "id string, type string, key string, label string")
    ed = spark.createDataFrame([(a, b, "E") for a, b in edges if a != b], "src string, dst string, type string")
    traces = gr.trace_paths(nd, ed)
    got = {r.node: (r.hops, r.target) for r in traces.collect()}
    want = {n: reference_bfs(nodes, [e for e in edges if e[0] != e[1]], n) for n, _ in nodes}
    assert got == {n: v for n, v in want.items() if v}
    far = max(got, key=lambda n: got[n][0])
    path = gr.trace_path(traces, far)
    assert len(path) == got[far][0] + 1 and path[-1] == got[far][1]
    assert gr.trace_path(traces, "nowhere") == []


def test_neighbours_and_search(spark):
    nodes, edges = kb.nodes(spark), kb.edges(spark)
    around = {r.id for r in gr.expand_node(nodes, edges, "DetectionPattern:IOC-S3-001").collect()}
    assert around == {"MITRETechnique:T1530", "Playbook:IR-S3-001"}
    assert gr.keyword_search(nodes, "mass deletion").first().id == "DetectionPattern:IOC-DESTRUCT-001"
    win = spark.createDataFrame([("Window:a", 0.5, "x")], "id string, ensemble_score double, attack_name string")
    assert gr.subgraph(win, edges, attack_type="none").count() == edges.count()


def test_users_sharing_a_resource(spark):
    edges = spark.createDataFrame([("User:a", "Event:1", "PERFORMED"), ("User:b", "Event:2", "PERFORMED"), ("User:c", "Event:3", "PERFORMED"),
                                   ("Event:1", "Resource:x", "ON"), ("Event:2", "Resource:x", "ON"), ("Event:3", "Resource:y", "ON")],
                                  "src string, dst string, type string")
    assert [r.user for r in gr.users_sharing_with(edges, "User:a").collect()] == ["User:b"]
    assert {(r.user, r.resource): r.other_users for r in gr.shared_resource_users(edges).collect()}[("User:c", "Resource:y")] == 0


def test_report_round_trip(spark):
    text = ("head\nINCIDENT #1 | HIGH | User: eve | Score: 0.91\nMITRE TECHNIQUES:\n  T1078: x\n  T1078.004: y\nPLAYBOOKS TRIGGERED:\n"
            "  IR-S3-001: a\n  IR-IAM-001: b\nLLM ANALYSIS:\n  Attack classification: Recon\nplease revoke the session now \n"
            "INCIDENT #2 | LOW | User: bob | Score: 0.4\nLLM ANALYSIS:\n(LLM unavailable - run it)\nINCIDENT #3 | x\nnothing")
    inc = ev.parse_incidents(spark.createDataFrame([("r", text)], "report string, content string"))
    rows = ev.classify_incident(ev.extract_report_ids(inc, "full")).orderBy("block_no").collect()
    assert [(r.user, r.score) for r in rows] == [("eve", "0.91"), ("bob", "0.4"), ("", "0")]
    assert rows[0].playbooks == ["IR-IAM-001", "IR-S3-001"] and rows[0].techniques == ["T1078"]
    assert rows[0].severity == "HIGH" and rows[0].actions == ["please revoke the session now"]
    assert rows[0].predicted == "reconnaissance" and rows[1].llm == "" and rows[2].predicted == "unknown"
    strict = inc.select(ev.playbook_ids(F.col("full"), strict=True).alias("p")).first().p
    assert strict == ["IR-IAM-001"]


def test_entities_and_keywords(spark):
    row = spark.createDataFrame([("Show ir-s3-001 and t1078.004 for the privileged-user account",)], "q string").select(
        tx.extract_entities(F.col("q")).alias("e"), tx.question_keywords(F.col("q")).alias("k")).first()
    assert row.e == ["IR-S3-001", "T1078.004"] and row.k == ["t1078.004", "privileged", "user", "account"]


def test_embedding_has_unit_length_and_takes_an_encoder(spark):
    df = spark.createDataFrame([("alpha beta alpha",), ("",)], "text string")
    out = tx.embed_text(df, "text", 32).collect()
    assert [round(sum(v * v for v in r.vector), 6) for r in out] == [1.0, 0.0]
    assert tx.embed_text(df, "text", encoder=lambda c: F.array(F.length(c).cast("double"))).first().vector == [16.0]


def test_upsert_replaces(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, document string")
    new = spark.createDataFrame([("b", "2"), ("c", "2")], "id string, document string")
    assert {tuple(r) for r in tx.upsert_collection(old, new).collect()} == {("a", "1"), ("b", "2"), ("c", "2")}


def test_ranking_metrics(spark):
    rows = [(1, 1, 10, 0.2, False), (1, 2, 11, 1.0, True), (1, 3, 12, 0.5, True), (2, 1, 10, 0.0, False)]
    rk = spark.createDataFrame(rows, "query_id int, rank int, item_id int, relevance double, is_relevant boolean")
    totals = spark.createDataFrame([(1, 4)], "query_id int, n_relevant int")
    get = lambda df: {r[0]: r[1] for r in df.collect()}
    assert get(ev.precision_at_k(rk, 5)) == {1: pytest.approx(2 / 3), 2: 0.0}
    assert get(ev.recall_at_k(rk, totals, 5)) == {1: 0.5, 2: 0.0}
    assert get(ev.mrr(rk)) == {1: 0.5, 2: 0.0}
    from math import log2
    dcg, ideal = 0.2 + 1 / log2(3) + 0.5 / 2, 1 + 0.5 / log2(3) + 0.2 / 2
    assert get(ev.ndcg_at_k(rk, 5)) == {1: pytest.approx(dcg / ideal), 2: 0.0}
    marked = ev.mark_relevant(rk.drop("is_relevant"), spark.createDataFrame([(1, 12)], "query_id int, item_id int"))
    assert marked.filter("is_relevant").count() == 1


def test_infinite_response_times(spark):
    df = spark.createDataFrame([("a", None, 5.0)], "period string, detect_minutes double, contain_minutes double")
    r = ev.response_times(df).first()
    assert r.mttd == float("inf") and r.mttc == 5.0


def test_playbook_scores(spark):
    df = spark.createDataFrame([(["IR-A-1"], ["ir-a-1"], "x"), ([], [], "normal")],
                               "predicted_playbooks array<string>, truth_playbooks array<string>, truth string")
    assert ev.playbook_accuracy(df).first().accuracy == 0.5
    assert ev.playbook_jaccard(df.filter("truth = 'normal'")).first().jaccard == 0.0


def test_stream_equals_batch_and_alerts_are_not_repeated(spark, tmp_path):
    rows = [(f"e{i}", f"u{i % 3}", W0 + timedelta(minutes=7 * i), "GetObject" if i % 5 else "PutObject", "s3", True, False,
             None if i % 4 == 0 else f"b{i % 3 + i % 2}", "ip" if i % 2 else None, 1.0) for i in range(120)]
    rows.append(("last", "z", W0 + timedelta(days=9), "GetObject", "s3", True, False, "b", "ip", 1.0))
    ddl = ("eventID string, user_name string, eventTime timestamp, eventName string, service string, is_read_only boolean, is_error boolean, "
           "request_bucket_name string, sourceIPAddress string, bytes_transferred_out double")
    df = spark.createDataFrame(rows, ddl)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = st.stream_window_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 60)
    st.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    pick = ["user_name", "window", "total_events", "s3_get_events", "unique_resources", "unique_ips", "unique_event_types", "bytes_out_total", "bytes_out_max"]
    got = {tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).select(*pick).collect()}
    batch = ft.user_window_counts(df.withColumn("is_business_hours", F.lit(True)), 60).filter("user_name <> 'z'")
    assert got == {tuple(r) for r in batch.select(*pick).collect()}

    windows = spark.createDataFrame([("u", W0, 50), ("u", W0 + timedelta(hours=1), 1)], "user_name string, window timestamp, total_events long")
    base = spark.createDataFrame([("u", 2.0, 1.0)], "user_name string, total_events_mean double, total_events_std double")
    for n in range(2):  # the same window arrives in two runs
        windows.write.mode("append").parquet(str(tmp_path / "w"))
        st.stream_alerts(spark.readStream.schema(windows.schema).parquet(str(tmp_path / "w")), base, 3.0, str(tmp_path / "al"), str(tmp_path / "cpa"))
    assert [(r.user_name, r.total_events, r.batch) for r in st.read_alerts(spark, str(tmp_path / "al")).collect()] == [("u", 50, 0)]


def test_state_survives_a_restart_and_uses_saved_models(spark, tmp_path):
    import numpy as np
    from auditmill.operators import models as md
    columns = ["total_events", "bytes_out_total"]
    rng = np.random.default_rng(4)
    rows = [(f"u{i % 3}", W0 + timedelta(minutes=5 * t), int(rng.integers(3, 8)) if t % 29 else 60, float(rng.random())) for i, t in enumerate(range(90))]
    rows[50] = (*rows[50][:3], 500.0)  # only the model sees this one
    windows = spark.createDataFrame(rows, "user_name string, window timestamp, total_events long, bytes_out_total double")
    train = windows.filter("total_events < 20 and bytes_out_total < 2")
    scaled = md.scale_rows(train, md.scaler(train, columns), columns)
    model = md.autoencoder_fit(scaled, 1)
    saved = str(tmp_path / "model")
    md.save_model(saved, md.scaler(train, columns), model, spark.createDataFrame([(1000.0,)], "threshold double"))

    def run(name, parts):
        for part in parts:
            part.write.mode("append").parquet(str(tmp_path / name))
            stream = spark.readStream.schema(windows.schema).parquet(str(tmp_path / name))
            st.stream_model_alerts(stream, str(tmp_path / f"{name}-alerts"), str(tmp_path / f"{name}-cp"), 3.0, model=saved, columns=columns)
        found = st.read_alerts(spark, str(tmp_path / f"{name}-alerts"))
        return sorted((r.user_name, r.window, r.total_events, round(r.score, 9), round(r.model_score, 6)) for r in found.collect())

    cut = rows[60][1]
    once = run("once", [windows])
    assert once == run("twice", [windows.filter(F.col("window") < cut), windows.filter(F.col("window") >= cut)])
    # batch form of the same
    want, direct = [], {(r.user_name, r.window): r.score for r in md.score_new_rows(spark, windows, saved, columns).collect()}
    for user in ("u0", "u1", "u2"):
        before = []
        for u, w, x, b in rows:
            if u == user:
                sd = np.std(before) if before else 0.0
                w = w.replace(tzinfo=None)
                score = (x - np.mean(before)) / sd if sd > 0 else 0.0
                if (score > 3 and len(before) >= 2) or direct[u, w] >= 1000:
                    want.append((u, w, x, round(float(score), 9), round(direct[u, w], 6)))
                before.append(x)
    assert [r[:3] for r in once] == [r[:3] for r in sorted(want)] and np.allclose([r[3:] for r in once], [r[3:] for r in sorted(want)])
    assert any(r[3] < 3 for r in once) and any(r[3] > 3 for r in once)


def test_trace_follows_chains_of_any_length(spark):
    nodes = [("n00", "Playbook")] + [(f"n{i:02d}", "Window") for i in range(1, 31)]
    nd = spark.createDataFrame([(i, t, i, i) for i, t in nodes], "id string, type string, key string, label string")
    ed = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", "E") for i in range(30)], "src string, dst string, type string")
    got = {r.node: (r.hops, r.target) for r in gr.trace_paths(nd, ed).collect()}
    assert got == {f"n{i:02d}": (i, "n00") for i in range(1, 31)}
    rows = gr.trace_rows(nd, ed)
    steps = sorted((r.start, r.step, r.node, r.node_type, r.edge_type, r.next) for r in rows.collect())
    want = []
    for i in range(1, 31):
        for j in range(i + 1):
            at = i - j
            want.append((f"n{i:02d}", j, f"n{at:02d}", "Window" if at else "Playbook", "E" if at else None, f"n{at - 1:02d}" if at else None))
    assert steps == sorted(want)
    assert gr.path_of(rows, "n03") == ["n03", "n02", "n01", "n00"] and gr.path_of(rows, "n00") == []
    assert gr.trace_rows(nd.limit(0), ed.limit(0)).count() == 0


THREAT = "user_name string, window timestamp, document_id int, rank int, content string, similarity double"


def small_document(spark, similar=None, **more):
    """The nested document of one alert whose user made four events, with all that it takes."""
    ev_ = small_events(spark, [0, 60, 120, 180])
    feats = spark.createDataFrame([("u", W0, *[3.0] * len(vocab.KEY_FEATURES))], "user_name string, window timestamp, " + ", ".join(f"{c} double" for c in vocab.KEY_FEATURES))
    past = spark.createDataFrame([("u", W0, i, 1 - i / 4, i) for i in (1, 2, 3)] if similar is None else similar,
                                 "user_name string, window timestamp, incident_id int, similarity double, rank int")
    known = spark.createDataFrame([(1, "data_exfiltration", "x" * 130), (2, "insider_threat", "short"), (3, "normal", "third")],
                                  "id int, attack_name string, summary string")
    return en.enriched_alerts(one_alert(spark, attack_name=""), feats, ev_, kb.patterns(spark), kb.edges(spark), kb.techniques(spark), kb.playbooks(spark),
                              past, known, spark.createDataFrame([("u", W0, 5, 1, "intel", 0.5)], THREAT), **more)


def test_prompt_is_whole(spark):
    closing = ("\nATTACK CLASSIFICATION: <one of: privilege_escalation | data_exfiltration | insider_threat | reconnaissance | backdoor_creation | unknown>"
               + vocab.PROMPT_CLOSING)
    past = "\n\nSIMILAR PAST INCIDENTS:\n  - data_exfiltration (similarity=0.75): " + "x" * 120 + "\n  - insider_threat (similarity=0.5): short\n\nThe first line"
    doc = small_document(spark)
    text = en.analyst_prompt(doc).first().prompt
    assert text.endswith(closing) and past in text and "third" not in text
    report = en.incident_report_text(doc).first().text
    assert "\nSIMILAR PAST INCIDENTS:\n  [data_exfiltration] similarity=0.75: " + "x" * 100 + "\n  [insider_threat] similarity=0.5: short\n─" in report
    # an incident that is not described, and an alert without any
    text = en.analyst_prompt(small_document(spark, [("u", W0, 9, 0.25, 1)])).first().prompt
    assert "\n  - unknown (similarity=0.25): \n" in text
    text = en.analyst_prompt(small_document(spark, [])).first().prompt
    assert text.endswith(closing) and "SIMILAR" not in text


def test_document_by_the_graph(spark):
    edges = spark.createDataFrame(
        [("Window:u_2026-02-23 14:00:00", f"DetectionPattern:{p}", s, ["f"]) for p, s in (("IOC-IAM-001", 0.65), ("IOC-BEHAV-001", 0.6))],
        "src string, dst string, match_score double, matched_features array<string>")
    av = spark.createDataFrame([("u", W0, [1.0, 0.0])], "user_name string, window timestamp, vector array<double>")
    pv = spark.createDataFrame([("IOC-IAM-001", [-1.0, 0.0]), ("IOC-BEHAV-001", [1.0, 0.0])], "pattern_id string, vector array<double>")

    def found(**more):
        doc = small_document(spark, **more).first()
        assert [(t.document_id, t.content) for t in doc.rag_retrieval.threat_intel_docs] == [(5, "intel")]
        return doc, [(p.pattern_id, p.match_reason, p.retrieval_score, p.matched_features) for p in doc.detection.matched_patterns]

    by = "graph_bridge_triggers_indicator"
    doc, got = found(indicator_edges=edges, alert_vectors=av, pattern_vectors=pv)
    assert got == [("IOC-BEHAV-001", by, 0.72, ["f"]), ("IOC-IAM-001", by, 0.455, ["f"])]
    assert [t.technique_id for t in doc.detection.techniques] == ["T1078", "T1098", "T1136"]
    # without a vector of the alert the matches stay, in the order of their scores
    assert found(indicator_edges=edges, alert_vectors=av.limit(0), pattern_vectors=pv)[1] == [("IOC-IAM-001", by, None, ["f"]), ("IOC-BEHAV-001", by, None, ["f"])]
    # without an edge the window's events tell
    assert found(indicator_edges=edges.limit(0))[1] == [(f"IOC-S3-00{i}", "graph_bridge_event_match", None, []) for i in (1, 2)]


def test_gram_index_finds_every_substring(spark):
    import random
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(0, 30))) for _ in range(150)]
    rows = [(f"n{i}", "Playbook", t) for i, t in enumerate(texts)] + [("none", "Playbook", None), (None, "Playbook", "abca"), ("n1", "Playbook", texts[1])]
    terms = ["".join(rng.choice("abc ") for _ in range(rng.randrange(4, 8))) for _ in range(80)] + ["zzzz", texts[3] + texts[4], "abc"]
    index = tx.GramIndex(spark.createDataFrame(rows, "id string, type string, text string"))
    got = index.find(spark.createDataFrame([(t,) for t in terms] * 2, "term string"))
    assert sorted((r.term, r.id) for r in got.collect()) == sorted({(t, f"n{i}") for t in terms if len(t) >= 4 for i, text in enumerate(texts) if t in text})
    lengths = {r.gram: r.n for r in index.lengths.collect()}
    assert lengths["abca"] == sum("abca" in t for t in texts)


def test_equal_questions_are_answered_once(spark):
    nodes = spark.createDataFrame([("a", "Playbook", "rotate keys quickly"), ("b", "MITRETechnique", "t1098 account keys"), ("c", "Playbook", "nothing")], "id string, type string, text string")
    asked = [(1, "how to rotate keys"), (2, "how to rotate keys"), (3, "what is T1098"), (4, None), (5, ""), (6, "unheardof words")]
    index = tx.GramIndex(nodes)
    for where in (nodes, index):
        got = tx.entity_focus(spark.createDataFrame(asked, "question_id long, text string"), where)
        assert sorted(tuple(r) for r in got.collect()) == [(1, 2, "MITRETechnique"), (2, 2, "MITRETechnique"), (3, 1, "MITRETechnique")]
