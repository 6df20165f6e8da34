"""Registered queries: anomaly models, fusion, metrics, alert dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditmill import vocab
from auditmill.operators import alerts as al, autoencoder as ae, models as md, scoring as sc
from auditmill.operators.knn import knn_join
from auditmill.plans import adapter
from auditmill.plans.fragments import grid_sql
from auditmill.plans.adapter import features
from auditmill.plans.registry import fragment, query
from auditmill.session import materialize, scratch_path
from auditmill.sources import tables as tab

W = 'w AS "window"'

# --- models ------------------------------------------------------------------


@query("normal_only_split", """
SELECT 'train' AS part, count(*) AS windows, count(*) FILTER (is_attack) AS attacks FROM q_feat WHERE NOT is_attack
UNION ALL SELECT 'test', count(*), count(*) FILTER (is_attack) FROM q_feat""")
def _(spark, sf):
    train, test = md.normal_only_split(features(spark, sf))
    size = lambda df, n: df.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("windows"),
                                F.count(F.when(F.col("is_attack"), 1)).alias("attacks"))
    return size(train, "train").unionByName(size(test, "test"))


_scaled = ", ".join(
    f"round((f.{c} - s.m_{c}) / CASE WHEN s.d_{c} > 0 THEN s.d_{c} ELSE 1.0 END, 4) AS {c}"
    for c in vocab.FEATURE_COLUMNS)
_stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in vocab.FEATURE_COLUMNS)


@query("standardize", f"""
SELECT f.user_name, f.{W}, {_scaled} FROM q_feat f
CROSS JOIN (SELECT {_stats} FROM q_feat WHERE NOT is_attack) s""")
def _(spark, sf):
    train, test = md.normal_only_split(features(spark, sf))
    out = md.standardize(test, train)
    return out.select("user_name", "window", *[
        F.round(F.col("vector")[i], 4).alias(c) for i, c in enumerate(vocab.FEATURE_COLUMNS)])


def scaled(spark, sf):
    """Scaled feature rows, written once: every model reads them several times."""
    train, test = md.normal_only_split(features(spark, sf))
    rows = materialize(md.standardize(test, train).select(
        "user_name", "window", "is_attack", "attack_id", "vector",
        F.concat_ws("|", "user_name", F.date_format("window", "yyyyMMddHHmm")).alias("id")), "scaled")
    return rows.filter("not is_attack"), rows


def forest_scores(spark, sf, trees=100):
    train, test = scaled(spark, sf)
    forest = md.isolation_forest_fit(train, ["id"], trees)
    return md.isolation_forest_score(test, forest)


@query("isolation_forest_score")
def _(spark, sf):
    return forest_scores(spark, sf).select("user_name", "window", F.round("score", 6).alias("if_score"))


@query("contamination_threshold", """
SELECT candidate, contamination, threshold, tp, fp, CASE WHEN tp > 0 THEN round(2.0 * tp / (tp + fp + pos), 6) ELSE 0.0 END AS f1
FROM (SELECT c.candidate, c.contamination, c.threshold, count(*) FILTER (s.score > c.threshold AND s.is_attack) AS tp,
  count(*) FILTER (s.score > c.threshold AND NOT s.is_attack) AS fp, count(*) FILTER (s.is_attack) AS pos
  FROM (SELECT if_score AS score, is_attack FROM q_sc) s
  CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS candidate, CAST(unnest([0.01, 0.02, 0.05, 0.08, 0.1]) AS DOUBLE) AS contamination,
    unnest(quantile_cont(if_score, [CAST(0.99 AS DOUBLE), CAST(0.98 AS DOUBLE), CAST(0.95 AS DOUBLE), CAST(0.92 AS DOUBLE), CAST(0.9 AS DOUBLE)]))
      AS threshold FROM q_sc WHERE NOT is_attack) c GROUP BY 1, 2, 3)""")
def _(spark, sf):
    rows = adapter.ensemble(spark, sf).select(F.col("if_score").alias("score"), "is_attack")
    train, test = md.normal_only_split(rows)
    return md.contamination_grid(train, test).select(
        "candidate", "contamination", "threshold", "tp", "fp", F.round("f1", 6).alias("f1"))




@query("knn_exact", """
SELECT id, neighbor_id, rank, round(distance, 5) AS distance FROM (
  SELECT q.id, b.id AS neighbor_id, list_distance(q.v, b.v) AS distance,
    row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, b.v), b.id) AS rank
  FROM q_pt q CROSS JOIN q_pt b WHERE NOT b.is_attack) WHERE rank <= 10""")
def _(spark, sf):
    pts = adapter.points(spark, sf)
    near = knn_join(pts, pts.filter("not is_attack"), 10)
    return near.select(F.col("query_id").alias("id"), "neighbor_id", "rank", F.round("distance", 5).alias("distance"))


fragment("q_nn", """
SELECT * FROM (SELECT q.id, b.id AS nb, list_distance(q.v, b.v) AS distance,
  row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, b.v), b.id) AS rank
  FROM q_pt q CROSS JOIN q_pt b WHERE NOT b.is_attack AND NOT q.is_attack AND q.id <> b.id) WHERE rank <= 10""")
fragment("q_nt", """
SELECT * FROM (SELECT q.id, b.id AS nb, list_distance(q.v, b.v) AS distance,
  row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, b.v), b.id) AS rank
  FROM q_pt q CROSS JOIN q_pt b WHERE NOT b.is_attack) WHERE rank <= 10""")
fragment("q_kd", "SELECT id, max(distance) AS kd FROM q_nn GROUP BY id")
fragment("q_lrd", """
SELECT n.id, 1.0 / (avg(greatest(n.distance, k.kd)) + 1e-10) AS lrd FROM q_nn n JOIN q_kd k ON k.id = n.nb GROUP BY n.id""")
fragment("q_lrt", """
SELECT n.id, 1.0 / (avg(greatest(n.distance, k.kd)) + 1e-10) AS lrd FROM q_nt n JOIN q_kd k ON k.id = n.nb GROUP BY n.id""")


@query("lof_score", """
SELECT n.id, round(avg(l.lrd) / any_value(t.lrd), 5) AS score
FROM q_nt n JOIN q_lrd l ON l.id = n.nb JOIN q_lrt t ON t.id = n.id GROUP BY n.id""")
def _(spark, sf):
    pts = adapter.points(spark, sf)
    out = md.lof_score(pts.filter("not is_attack"), pts, 10)
    return out.select("id", F.round("score", 5).alias("score"))


fragment("q_ks", """
SELECT DISTINCT k FROM (SELECT n, unnest([10, 15, 20, 30, 50, root, root + 10]) AS k
  FROM (SELECT count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS root FROM q_pt WHERE NOT is_attack)) WHERE k > 0 AND k < n""")
_near_at_most = """
SELECT * FROM (SELECT q.id, b.id AS nb, list_distance(q.v, b.v) AS distance,
  row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, b.v), b.id) AS rank
  FROM q_pt q CROSS JOIN q_pt b WHERE NOT b.is_attack{also}) WHERE rank <= (SELECT max(k) FROM q_ks)"""
fragment("q_kn", _near_at_most.format(also=" AND NOT q.is_attack AND q.id <> b.id"))
fragment("q_kt", _near_at_most.format(also=""))
fragment("q_kk", "SELECT n.id, g.k, max(n.distance) AS kd FROM q_kn n JOIN q_ks g ON n.rank <= g.k GROUP BY 1, 2")
for _part in "nt":
    fragment(f"q_kl{_part}", f"""
SELECT n.id, d.k, 1.0 / (avg(greatest(n.distance, d.kd)) + 1e-10) AS lrd FROM q_k{_part} n JOIN q_kk d ON d.id = n.nb AND n.rank <= d.k GROUP BY 1, 2""")


@query("lof_k_grid", """
SELECT n.id, l.k, round(avg(l.lrd) / any_value(t.lrd), 5) AS score FROM q_kt n
JOIN q_kln l ON l.id = n.nb AND n.rank <= l.k JOIN q_klt t ON t.id = n.id AND t.k = l.k GROUP BY 1, 2""")
def _(spark, sf):
    pts = adapter.points(spark, sf)
    return md.lof_k_grid(pts.filter("not is_attack"), pts).withColumn("score", F.round("score", 5))


@query("lof_k_selection")
def _(spark, sf):
    pts = adapter.points(spark, sf)
    grid = md.lof_k_grid(pts.filter("not is_attack"), pts)
    labelled = grid.join(pts.select("id", "is_attack"), "id")
    return sc.best_f1_threshold(labelled, by="k").orderBy(F.desc("f1"), "k")


@query("reconstruction_error")
def _(spark, sf):
    train, test = scaled(spark, sf)
    out = md.reconstruction_error(test, md.autoencoder_fit(train))
    return out.select("user_name", "window", F.round("score", 6).alias("ae_score"))


@query("score_new_rows")
def _(spark, sf):
    feats = features(spark, sf)
    train, _all = md.normal_only_split(feats)
    rows = md.standardize(train, train)
    model = md.autoencoder_fit(rows)
    cut = md.contamination_threshold(md.reconstruction_error(rows, model), 0.05)
    path = scratch_path(spark, "model")
    md.save_model(path, md.scaler(train), model, cut)
    return md.score_new_rows(spark, feats, path).select(
        "user_name", "window", F.round("score", 6).alias("score"), "pred")


_NETWORKS: dict = {}


def networks(spark, sf):
    """Networks for all rates, trained once per session over the normal windows and stored as a table; with their losses."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _NETWORKS:
        train, rows = scaled(spark, sf)
        trained = ae.fit(train, len(vocab.FEATURE_COLUMNS))
        _NETWORKS[key] = materialize(ae.to_table(spark, trained), "networks"), [n.losses for n in trained], rows
    table, losses, rows = _NETWORKS[key]
    return ae.from_table(table), losses, rows


@query("autoencoder_selection", """
SELECT network, rate, windows, CAST(0 AS BIGINT) AS below_zero, true AS learned, true AS flags_known, CAST(1 AS BIGINT) AS n_best
FROM (SELECT unnest([0, 1, 2]) AS network, unnest([0.02, 0.01, 0.005])::DOUBLE AS rate) CROSS JOIN (SELECT count(*) AS windows FROM q_feat)""")
def _(spark, sf):
    """The networks of all rates on all windows, with the properties that hold whatever was learned.

    ``flags_known``: the chosen threshold flags no fewer windows than its percentile leaves above it.
    """
    trained, losses, rows = networks(spark, sf)
    table, scored = ae.selection(rows, trained, vocab.MODEL_PERCENTILES)
    table = materialize(table, "network-grid")
    learned = F.array(*[F.lit(bool(x and x[-1] < x[0])) for x in losses])
    counted = scored.join(F.broadcast(table), "network").groupBy("network", "rate").agg(
        F.count("score").alias("windows"), F.count_if(F.col("score") < 0).alias("below_zero"),
        (F.count_if(F.col("score") >= F.col("threshold")) >= F.floor(F.count("score") * (100 - F.max("percentile")) / 100)).alias("flags_known"))
    n_best = table.agg(F.count_if("best")).scalar()
    return counted.select("network", "rate", "windows", "below_zero", F.element_at(learned, F.col("network") + 1).alias("learned"), "flags_known", n_best.alias("n_best"))


@query("autoencoder_score_new", """
SELECT user_name, w AS "window", true AS same, true AS flagged_right FROM q_feat""")
def _(spark, sf):
    """Scores by the saved scaler, network and threshold beside those of the network in memory."""
    trained, _, rows = networks(spark, sf)
    direct = materialize(ae.score(rows, trained[0]), "network-scores")
    cut = md.contamination_threshold(direct.filter("not is_attack"), 0.05)
    feats, path = features(spark, sf), scratch_path(spark, "network")
    ae.save(path, md.scaler(md.normal_only_split(feats)[0]), trained[0], cut)
    saved = ae.score_new_rows(spark, feats, path).select("user_name", "window", "score", "pred")
    both = saved.join(direct.select("user_name", "window", F.col("score").alias("direct")), ["user_name", "window"])
    limit = spark.read.parquet(f"{path}/threshold").select("threshold").scalar()
    return both.select("user_name", "window", (F.abs(F.col("score") - F.col("direct")) <= 1e-6 * (1 + F.col("direct"))).alias("same"),
                       (F.col("pred") == (F.col("score") >= limit).cast("int")).alias("flagged_right"))


@query("best_f1_threshold", f"""
SELECT 'model' AS grid, percentile, round(threshold, 6) AS threshold, round(f1, 6) AS f1
FROM (SELECT * FROM ({grid_sql('q_sc', 'lof_score', vocab.MODEL_PERCENTILES)}) ORDER BY f1 DESC, percentile LIMIT 1)
UNION ALL SELECT 'ensemble', percentile, round(threshold, 6), round(f1, 6) FROM q_cut""")
def _(spark, sf):
    ens = adapter.ensemble(spark, sf)
    one = sc.best_f1_threshold(ens, vocab.MODEL_PERCENTILES, "lof_score").withColumn("grid", F.lit("model"))
    two = sc.best_f1_threshold(ens, vocab.ENSEMBLE_PERCENTILES, "ensemble_score").withColumn("grid", F.lit("ensemble"))
    return one.unionByName(two).select("grid", "percentile", F.round("threshold", 6).alias("threshold"),
                                       F.round("f1", 6).alias("f1"))


# --- fusion ------------------------------------------------------------------

NORMS = ["if_norm", "lof_norm", "ae_norm"]
R6 = lambda cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("score_table_io", f"SELECT user_name, {W}, if_score, if_pred FROM q_sc")
def _(spark, sf):
    path = scratch_path(spark, "if-scores")
    tab.write_scores_csv(adapter.scores(spark, sf)["if"], path)
    return tab.read_scores_csv(spark, path, "if")


@query("minmax_normalize", f"SELECT user_name, {W}, {R6(NORMS)} FROM q_fuse")
def _(spark, sf):
    s = adapter.scores(spark, sf)
    joined = s["if"].join(s["lof"], sc.KEYS).join(s["ae"], sc.KEYS)
    out = sc.minmax(joined, {f"{m}_score": f"{m}_norm" for m in ("if", "lof", "ae")})
    return rounded(out.select("user_name", "window", *NORMS), NORMS)


@query("fuse_scores", f"SELECT user_name, {W}, round(ensemble_score, 6) AS ensemble_score FROM q_fuse")
def _(spark, sf):
    s = adapter.scores(spark, sf)
    out = sc.fuse_scores(s["if"], s["lof"], s["ae"])
    return out.select("user_name", "window", F.round("ensemble_score", 6).alias("ensemble_score"))


@query("majority_vote", f"SELECT user_name, {W}, vote_count, majority_vote FROM q_fuse")
def _(spark, sf):
    return adapter.ensemble(spark, sf).select("user_name", "window", "vote_count", "majority_vote")


@query("ensemble_scores", f"""
SELECT user_name, {W}, if_score, lof_score, round(ae_score, 6) AS ae_score, {R6(NORMS)},
  round(ensemble_score, 6) AS ensemble_score, if_pred, lof_pred, ae_pred, vote_count, majority_vote, ensemble_pred,
  is_attack, attack_id, attack_name,
  CAST(ensemble_score >= quantile_cont(ensemble_score, CAST(0.9 AS DOUBLE)) OVER () AS INT) AS unlabeled_pred FROM q_ens""")
def _(spark, sf):
    feats = features(spark, sf)
    s = adapter.scores(spark, sf)
    plain = sc.ensemble_scores(s["if"], s["lof"], s["ae"]).select(
        *sc.KEYS, F.col("ensemble_pred").alias("unlabeled_pred"))
    out = sc.ensemble_scores(s["if"], s["lof"], s["ae"], feats).join(plain, sc.KEYS)
    return rounded(out, ["ae_score", *NORMS, "ensemble_score"])


@query("forest_selection")
def _(spark, sf):
    """Five contaminations times two tree counts over the scaled features."""
    train, rows = scaled(spark, sf)
    table, _scored = md.forest_selection(train, rows)
    return table.select("trees", "contamination", F.round("threshold", 6).alias("threshold"), "tp", "fp", F.round("f1", 6).alias("f1"), "best")


@query("scored_pipeline")
def _(spark, sf):
    """All windows by forest, neighbour density and reconstruction over the feature matrix, fused.

    The best (trees, contamination) is applied to the forest; the other models take their best
    percentile and a fixed contamination.
    """
    train, rows = scaled(spark, sf)
    table, scored = md.forest_selection(train, rows)
    best = table.filter("best").select("trees", "threshold").first()
    forest = scored[best.trees].select(*sc.KEYS, F.col("score").alias("if_score"), (F.col("score") > best.threshold).cast("int").alias("if_pred"))
    density = materialize(md.lof_score(train, rows, 20).join(rows.select("id", *sc.KEYS, "is_attack"), "id"), "lof")
    cut = sc.best_f1_threshold(density, vocab.MODEL_PERCENTILES, "score").select("threshold").scalar()
    density = density.select(*sc.KEYS, F.col("score").alias("lof_score"), (F.col("score") >= cut).cast("int").alias("lof_pred"))
    rebuilt = materialize(md.reconstruction_error(rows, md.autoencoder_fit(train)), "rebuilt")
    limit = md.contamination_threshold(rebuilt.filter("not is_attack"), 0.05)
    rebuilt = md.apply_threshold(rebuilt, limit).select(*sc.KEYS, F.col("score").alias("ae_score"), F.col("pred").alias("ae_pred"))
    out = sc.ensemble_scores(forest, density, rebuilt, features(spark, sf))
    return rounded(out.select(*sc.KEYS, "if_pred", "lof_pred", "ae_pred", *NORMS, "ensemble_score", "vote_count", "majority_vote", "ensemble_pred", "is_attack"),
                   [*NORMS, "ensemble_score"])


ALERT_OUT = f"""SELECT user_name, {W}, round(ensemble_score, 6) AS ensemble_score, {R6(NORMS)}, vote_count,
  attack_name, is_attack FROM q_al"""


def alert_rows(df):
    return rounded(df, ["ensemble_score", *NORMS])


@query("alert_table", ALERT_OUT)
def _(spark, sf):
    return alert_rows(adapter.alerts(spark, sf))


fragment("q_pay", """
SELECT *, list_filter([
  CASE WHEN if_pred <> 0 THEN 'IsolationForest(score=' || printf('%.3f', if_norm) || ')' END,
  CASE WHEN lof_pred <> 0 THEN 'LOF(score=' || printf('%.3f', lof_norm) || ')' END,
  CASE WHEN ae_pred <> 0 THEN 'Autoencoder(score=' || printf('%.3f', ae_norm) || ')' END], lambda x: x IS NOT NULL) AS fired
FROM q_ens""")


@query("alert_payload", """
SELECT user_name || '_' || strftime(w, '%Y-%m-%d %H:%M:%S') AS alert_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS timestamp,
  user_name AS "user", round(ensemble_score, 6) AS ensemble_score, vote_count, array_to_string(fired, ';') AS models_fired,
  CASE WHEN ensemble_score > 0.85 THEN 'critical' WHEN ensemble_score > 0.70 THEN 'high' ELSE 'medium' END AS severity,
  'User ' || user_name || ' anomalous behavior: ensemble score ' || printf('%.3f', ensemble_score) || ', models: '
  || CASE WHEN len(fired) > 0 THEN array_to_string(fired, ', ') ELSE 'none' END || '. IF=' || printf('%.3f', if_norm)
  || ' LOF=' || printf('%.3f', lof_norm) || ' AE=' || printf('%.3f', ae_norm) || '.' AS rag_query FROM q_pay""")
def _(spark, sf):
    out = sc.alert_payload(adapter.ensemble(spark, sf))
    return out.withColumn("models_fired", F.array_join("models_fired", ";")).withColumn(
        "ensemble_score", F.round("ensemble_score", 6))


# --- metrics -----------------------------------------------------------------

METRIC_OUT = ["true_positives", "false_positives", "true_negatives", "false_negatives", "precision", "recall",
              "f1", "false_positive_rate"]


@query("binary_metrics", f"SELECT {', '.join(METRIC_OUT)} FROM q_metrics WHERE model = 'ensemble'")
def _(spark, sf):
    return sc.binary_metrics(adapter.ensemble(spark, sf), F.col("ensemble_pred") == 1, F.col("is_attack"))


@query("roc_auc", "SELECT round(roc_auc, 6) AS roc_auc FROM q_auc WHERE model = 'ensemble'")
def _(spark, sf):
    out = sc.roc_auc(adapter.ensemble(spark, sf), "ensemble_score", F.col("is_attack"))
    return out.select(F.round("roc_auc", 6).alias("roc_auc"))


@query("per_attack_detection", """
SELECT attack_id, attack_name, count(*) AS total_windows, sum(ensemble_pred) AS detected,
  round(avg(ensemble_pred), 6) AS detection_rate FROM q_ens WHERE attack_id > 0 GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(sc.per_attack_detection(adapter.ensemble(spark, sf), "ensemble_pred"), ["detection_rate"])


@query("compare_models", f"""
SELECT model, {', '.join(METRIC_OUT)}, round(roc_auc, 4) AS roc_auc FROM q_metrics JOIN q_auc USING (model)""")
def _(spark, sf):
    return sc.compare_models(adapter.ensemble(spark, sf))


@query("model_coverage", """
SELECT attack_id, attack_name, count(*) AS total, sum(if_pred) AS if_detected, sum(lof_pred) AS lof_detected,
  sum(ae_pred) AS ae_detected, sum(ensemble_pred) AS ensemble_detected FROM q_ens WHERE attack_id > 0 GROUP BY 1, 2""")
def _(spark, sf):
    return sc.model_coverage(adapter.ensemble(spark, sf))


def _metrics_documents(spark, sf):
    path = scratch_path(spark, "metrics")
    ens = materialize(adapter.ensemble(spark, sf), "ensemble")
    tab.write_metrics_json(sc.compare_models(ens), sc.per_attack_detection(sc.by_model(ens), "pred", ["model"]), path)
    return path


@query("write_metrics_json", """
SELECT m.model, m.precision, m.f1, d.attack_name, d.total_windows, d.detected, round(d.rate, 6) AS detection_rate
FROM q_metrics m JOIN (SELECT model, attack_name, count(*) AS total_windows, sum(pred) AS detected, avg(pred) AS rate
  FROM q_long WHERE attack_id > 0 GROUP BY 1, 2) d USING (model)""")
def _(spark, sf):
    docs = spark.read.schema(al.MODEL_RESULTS).json(_metrics_documents(spark, sf))
    out = docs.select("model", "precision", "f1", F.explode("per_attack_detection").alias("d"))
    return out.select("model", "precision", "f1", "d.attack_name", "d.total_windows", "d.detected",
                      F.round("d.detection_rate", 6).alias("detection_rate"))


@query("model_performance", """
SELECT model AS model_name, precision, recall, f1 AS f1_score, true_positives, false_positives, false_negatives
FROM q_metrics""")
def _(spark, sf):
    return al.model_performance(spark, _metrics_documents(spark, sf))


# --- alerts ------------------------------------------------------------------


@query("filter_alerts", ALERT_OUT + " WHERE regexp_matches(user_name, '(?i)USER-1') AND ensemble_score >= 0.3 AND is_attack")
def _(spark, sf):
    return alert_rows(al.filter_alerts(adapter.alerts(spark, sf), "USER-1", min_score=0.3, is_attack=True))


@query("page_alerts", "SELECT *, (SELECT count(*) FROM q_al) AS total FROM (" + ALERT_OUT.replace(
    "FROM q_al", "FROM (SELECT * FROM q_al ORDER BY ensemble_score DESC, user_name, w LIMIT 20 OFFSET 20)") + ")")
def _(spark, sf):
    return alert_rows(al.page_alerts(adapter.alerts(spark, sf), 2, 20))


@query("alert_lookup", f"""
SELECT f.user_name, f.{W}, round(a.ensemble_score, 6) AS ensemble_score, a.vote_count, a.attack_name
FROM q_feat f LEFT JOIN q_al a ON a.user_name = f.user_name AND a.w = f.w""")
def _(spark, sf):
    ens = adapter.ensemble(spark, sf)
    out = al.alert_lookup_all(sc.alert_table(ens), ens)
    return out.select("user_name", "window", F.round("ensemble_score", 6).alias("ensemble_score"), "vote_count", "attack_name")


_severity_sql = """
SELECT count(*) AS total_alerts, count(*) FILTER (ensemble_score >= 0.7) AS high_severity_count,
  count(*) FILTER (ensemble_score >= 0.3 AND ensemble_score < 0.7) AS medium_severity_count,
  count(*) FILTER (ensemble_score < 0.3) AS low_severity_count, count(DISTINCT user_name) AS unique_users_affected FROM q_al"""


@query("severity_buckets", _severity_sql)
def _(spark, sf):
    return al.severity_buckets(adapter.alerts(spark, sf))


@query("attack_distribution", "SELECT attack_name, count(*) AS alerts FROM q_al GROUP BY 1")
def _(spark, sf):
    return al.attack_distribution(adapter.alerts(spark, sf))


@query("alert_timeline", "SELECT strftime(w, '%Y-%m-%d') AS date, count(*) AS count FROM q_al GROUP BY 1")
def _(spark, sf):
    return al.alert_timeline(adapter.alerts(spark, sf))


_top_users_sql = """
SELECT user_name, count(*) AS alert_count, round(avg(ensemble_score), 3) AS avg_score, round(max(ensemble_score), 3) AS max_score
FROM q_al GROUP BY 1 ORDER BY alert_count DESC, user_name LIMIT 10"""


@query("top_users", _top_users_sql)
def _(spark, sf):
    return al.top_users(adapter.alerts(spark, sf))


@query("filter_options", """
SELECT DISTINCT 'user' AS kind, user_name AS value FROM q_al UNION ALL SELECT DISTINCT 'attack_type', attack_name FROM q_al
UNION ALL SELECT DISTINCT 'technique', key || ': ' || name FROM q_kbn WHERE type = 'MITRETechnique'""")
def _(spark, sf):
    return al.filter_options(adapter.alerts(spark, sf), adapter.kb_tables(spark, sf)["techniques"])


@query("overview_stats", f"""
SELECT s.*, (SELECT string_agg(attack_name || '=' || n, ',' ORDER BY attack_name) FROM
    (SELECT attack_name, count(*) AS n FROM q_al GROUP BY 1)) AS attack_types,
  (SELECT string_agg(d || '=' || n, ',' ORDER BY d) FROM
    (SELECT strftime(w, '%Y-%m-%d') AS d, count(*) AS n FROM q_al GROUP BY 1)) AS alerts_by_date,
  (SELECT string_agg(user_name || '=' || alert_count, ',' ORDER BY alert_count DESC, user_name) FROM ({_top_users_sql})) AS top_users
FROM ({_severity_sql}) s""")
def _(spark, sf):
    out = al.overview_stats(adapter.alerts(spark, sf))
    text = lambda col, a, b: F.array_join(F.transform(
        col, lambda r: F.concat(r[a], F.lit("="), r[b].cast("string"))), ",")
    return out.withColumns({
        "attack_types": text(F.col("attack_types"), "attack_name", "alerts"),
        "alerts_by_date": text(F.col("alerts_by_date"), "date", "count"),
        "top_users": text(F.col("top_users"), "user", "alert_count")})


@query("top_k_alerts", f"SELECT * FROM ({ALERT_OUT.replace('FROM q_al', 'FROM (SELECT * FROM q_al ORDER BY ensemble_score DESC, user_name, w LIMIT 10)')})")
def _(spark, sf):
    return alert_rows(al.top_k_alerts(adapter.alerts(spark, sf), 10))
