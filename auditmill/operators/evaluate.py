"""Ranking metrics, text-grounding metrics and operational figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditmill import vocab
from auditmill.functions.scalars import any_contains, count_contained
from auditmill.functions.vectors import cosine
from auditmill.operators.scoring import confusion, safe_div

# --- ranking: ``ranking(query_id, rank, item_id, relevance, is_relevant)`` ---


def mark_relevant(ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    """Flag ranked items found in ``relevant(query_id, item_id)``."""
    hit = relevant.select("query_id", "item_id").distinct().withColumn("h", F.lit(True))
    return ranking.join(hit, ["query_id", "item_id"], "left").withColumn("is_relevant", F.coalesce("h", F.lit(False))).drop("h")


def _top(k):
    return F.col("rank") <= k


def precision_at_k(ranking: DataFrame, k: int = 5) -> DataFrame:
    """Relevant among the first k, over min(k, retrieved)."""
    hits = F.count_distinct(F.when(_top(k) & F.col("is_relevant"), F.col("item_id")))
    seen = F.count_distinct(F.when(_top(k), F.col("item_id")))
    return ranking.groupBy("query_id").agg(safe_div(hits, F.least(F.lit(k), seen)).alias("precision"))


def recall_at_k(ranking: DataFrame, totals: DataFrame, k: int = 5) -> DataFrame:
    """Relevant among the first k, over all relevant: ``totals(query_id, n_relevant)``."""
    hits = F.count_distinct(F.when(_top(k) & F.col("is_relevant"), F.col("item_id"))).alias("hits")
    return ranking.groupBy("query_id").agg(hits).join(totals, "query_id", "left").select(
        "query_id", safe_div(F.col("hits"), F.coalesce("n_relevant", F.lit(0))).alias("recall"))


def mrr(ranking: DataFrame) -> DataFrame:
    first = F.min(F.when(F.col("is_relevant"), F.col("rank")))
    return ranking.groupBy("query_id").agg(F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"))


def ndcg_at_k(ranking: DataFrame, k: int = 5) -> DataFrame:
    """Gain of the first k over the gain of the best order of the retrieved list."""
    ideal = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank")
    gain = lambda r: F.sum(F.when(F.col(r) <= k, F.col("relevance") / F.log2(F.col(r) + 1)).otherwise(F.lit(0.0)))
    return ranking.withColumn("best", F.row_number().over(ideal)).groupBy("query_id").agg(
        gain("rank").alias("dcg"), gain("best").alias("idcg")).select(
        "query_id", F.least(F.greatest(safe_div(F.col("dcg"), F.col("idcg")), F.lit(0.0)), F.lit(1.0)).alias("ndcg"))


def context_precision(relevant: Column, retrieved: Column) -> Column:
    return safe_div(F.size(F.array_intersect(relevant, retrieved)), F.size(F.array_distinct(retrieved)))


def context_recall(relevant: Column, retrieved: Column) -> Column:
    n = F.size(F.array_distinct(relevant))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(relevant, retrieved)) / n)


def alert_rank_quality(alerts: DataFrame, n: int = 10, k: int = 5) -> DataFrame:
    """R1 to R4 for the top ``n`` alerts, relevance = score over the best score."""
    top = alerts.orderBy(F.desc("ensemble_score"), "user_name", "window").limit(n)
    order = Window.partitionBy("query_id").orderBy(F.desc("ensemble_score"), "user_name", "window")  # n rows
    whole = Window.partitionBy("query_id")
    rows = top.withColumn("query_id", F.lit(0)).withColumns({
        "rank": F.row_number().over(order), "relevance": F.col("ensemble_score") / F.max("ensemble_score").over(whole)})
    rows = rows.withColumn("item_id", F.col("rank")).withColumn("is_relevant", F.col("relevance") > 0.5)
    totals = rows.groupBy("query_id").agg(F.sum(F.col("is_relevant").cast("int")).alias("n_relevant"))
    first = rows.filter(F.col("rank") <= k)
    parts = [precision_at_k(first, k), recall_at_k(first, totals, k), mrr(first), ndcg_at_k(rows, k)]
    return reduce(lambda a, b: a.join(b, "query_id"), parts).drop("query_id")


# --- grounding: one row per (query_id, context) with vectors ------------------


def context_similarity(contexts: DataFrame) -> DataFrame:
    """``contexts(query_id, answer_vector, context_vector)`` -> similarity per context."""
    return contexts.withColumn("similarity", cosine(F.col("answer_vector"), F.col("context_vector")))


def faithfulness(similar: DataFrame, threshold: float = 0.5) -> DataFrame:
    best = F.max("similarity")
    return similar.groupBy("query_id").agg(
        F.when(best >= threshold, F.least(F.greatest(best, F.lit(0.0)), F.lit(1.0))).otherwise(best * 0.5).alias("faithfulness"))


def answer_relevance(pairs: DataFrame) -> DataFrame:
    c = cosine(F.col("query_vector"), F.col("answer_vector"))
    return pairs.select("query_id", F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)).alias("answer_relevance"))


def context_utilization(similar: DataFrame, threshold: float = 0.3) -> DataFrame:
    return similar.groupBy("query_id").agg(F.avg((F.col("similarity") > threshold).cast("int")).alias("context_utilization"))


def grounded_precision(similar: DataFrame) -> DataFrame:
    return faithfulness(similar).join(context_utilization(similar), "query_id").select(
        "query_id", (0.6 * F.col("faithfulness") + 0.4 * F.col("context_utilization")).alias("grounded_precision"))


# --- reports -----------------------------------------------------------------


def parse_incidents(reports: DataFrame, content: str = "content") -> DataFrame:
    """One row per ``INCIDENT #n`` block with header, analysis, user and score."""
    blocks = reports.select(*[c for c in reports.columns if c != content],
                            F.posexplode(F.split(content, r"(?=INCIDENT #\d+)")).alias("block_no", "full"))
    blocks = blocks.filter(F.col("full").contains("INCIDENT #"))
    at = F.instr("full", "LLM ANALYSIS:")
    raw = F.when(at > 0, F.regexp_replace(F.substr("full", at + 13), r"^\s+|\s+$", "")).otherwise(F.lit(""))
    absent = raw.contains("LLM unavailable") | F.lower(raw).contains("ollama")
    score = F.regexp_extract("full", r"Score:\s*([\d.]+)", 1)
    return blocks.select(
        "*", F.when(at > 0, F.substr("full", F.lit(1), at - 1)).otherwise(F.col("full")).alias("header"),
        F.when(absent, "").otherwise(raw).alias("llm"), F.regexp_extract("full", r"User:\s*(\S+)", 1).alias("user"),
        F.when(score == "", "0").otherwise(score).alias("score"))


def ids(text: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def playbook_ids(text: Column, strict: bool = False) -> Column:
    return ids(text, vocab.PLAYBOOK_ID_STRICT if strict else vocab.PLAYBOOK_ID)


def technique_ids(text: Column) -> Column:
    return ids(text, vocab.TECHNIQUE_ID_SHORT)


def severity_word(text: Column) -> Column:
    up, out = F.upper(text), F
    for w in vocab.SEVERITY_WORDS:
        out = out.when(up.contains(w), w)
    return out


def action_lines(text: Column) -> Column:
    keep = F.filter(F.split(text, "\n"), lambda ln: any_contains(F.lower(ln), vocab.ACTION_WORDS) & (F.trim(ln) != "") & (F.length(ln) > 10))
    return F.transform(keep, lambda ln: F.regexp_replace(ln, r"^\s+|\s+$", ""))


def extract_report_ids(df: DataFrame, text: str) -> DataFrame:
    t = F.col(text)
    return df.withColumns({"playbooks": playbook_ids(t), "techniques": technique_ids(t), "severity": severity_word(t),
                           "actions": action_lines(t)})


def citation_metrics(incidents: DataFrame) -> DataFrame:
    """Per incident: share of header ids cited, keyword relevance, use of retrieved items."""
    llm = F.lower("llm")
    has = F.length(F.trim("llm")) > 50
    rows = incidents.withColumns({
        "header_techs": technique_ids(F.col("header")), "llm_techs": technique_ids(F.col("llm")),
        "header_books": playbook_ids(F.col("header")), "llm_books": playbook_ids(F.col("llm"))})
    cited = F.size(F.array_intersect("header_techs", "llm_techs"))
    books = F.size(F.array_intersect("header_books", "llm_books"))
    n_tech = F.size("header_techs")
    provided = F.greatest(F.size("header_books") + n_tech, F.lit(1))
    share = lambda words: count_contained(llm, words) / len(words)
    faith = F.when(~has, 0.0).when(n_tech > 0, cited / n_tech).otherwise(share(vocab.GROUNDING_WORDS))
    usage = (F.when(~has, 0.0)
             .when(cited + books == 0, F.least(count_contained(llm, vocab.USAGE_WORDS) / (len(vocab.USAGE_WORDS) * 0.6), F.lit(0.6)))
             .otherwise(F.least((cited + books) / provided, F.lit(1.0))))
    return rows.withColumns({
        "faithfulness": faith, "answer_relevance": F.when(has, share(vocab.ANSWER_WORDS)).otherwise(F.lit(0.0)),
        "context_utilization": usage})


def mean_metrics(per_incident: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: the number of incidents and the mean of each metric over them."""
    return per_incident.agg(F.count(F.lit(1)).alias("incidents"), *[F.avg(m).alias(m) for m in metrics])


def user_truth(alerts: DataFrame) -> DataFrame:
    """Attack of each user's highest alert; ``nan``, ``none`` and nothing mean ``normal``."""
    name = F.coalesce(F.lower(F.trim("attack_name")), F.lit(""))
    name = F.when(name.isin("nan", "none", ""), "normal").otherwise(name)
    return alerts.groupBy(F.col("user_name").alias("user")).agg(
        F.max_by(name, F.struct("ensemble_score", -F.unix_micros("window"))).alias("truth"))


def expected_term_coverage(incidents: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the attack's expected terms in the header and in the whole text."""
    terms = F.create_map(*[x for a, t in vocab.EXPECTED_TERMS.items() for x in (F.lit(a), F.array(*[F.lit(w) for w in t]))])
    rows = incidents.join(truth, "user").withColumn("expected", terms[F.col("truth")]).filter("expected is not null")
    share = lambda c: F.size(F.filter("expected", lambda w: F.contains(F.lower(F.col(c)), w))) / F.size("expected")
    return rows.withColumns({"context_precision": share("header"), "context_recall": share("full")})


def classify_text(text: Column) -> Column:
    """The class stated in the text, else the first class with a matching pattern."""
    stated = F.lower(F.regexp_extract(text, r"(?i)ATTACK CLASSIFICATION[:\s]+(\w+)", 1))
    alias = F.create_map(*[F.lit(x) for kv in vocab.CLASS_ALIASES.items() for x in kv])
    scan = F
    for cls, pats in vocab.CLASS_PATTERNS.items():
        scan = scan.when(reduce(lambda a, b: a | b, [F.lower(text).rlike(p) for p in pats]), cls)
    named = stated.isin(*vocab.CLASS_ALIASES, "unknown")
    return F.when(named, F.when(stated != "unknown", F.try_element_at(alias, stated))).otherwise(scan)


def classify_incident(incidents: DataFrame) -> DataFrame:
    return incidents.withColumn("predicted", F.coalesce(
        F.when(F.col("llm") != "", classify_text(F.col("llm"))), classify_text(F.col("full")), F.lit("unknown")))


def with_truth(incidents: DataFrame, truth: DataFrame) -> DataFrame:
    return incidents.join(truth, "user", "left").withColumn("truth", F.coalesce("truth", F.lit("normal")))


def classification_accuracy(classified: DataFrame, keys=()) -> DataFrame:
    return classified.groupBy(*keys).agg(
        F.avg((F.lower("predicted") == F.lower("truth")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("incidents"))


def expected_playbooks(truth: Column) -> Column:
    m = F.create_map(*[x for a, p in vocab.ATTACK_PLAYBOOKS.items() for x in (F.lit(a), F.array(*[F.lit(i) for i in p]))])
    return F.coalesce(m[truth], F.array().cast("array<string>"))


def playbook_accuracy(rows: DataFrame, keys=()) -> DataFrame:
    """Share of rows (``predicted_playbooks``, ``truth_playbooks``) with a common playbook."""
    hit = F.arrays_overlap(F.transform("predicted_playbooks", F.lower), F.transform("truth_playbooks", F.lower))
    return rows.groupBy(*keys).agg(F.avg(F.coalesce(hit, F.lit(False)).cast("int")).alias("accuracy"))


def playbook_jaccard(rows: DataFrame, keys=()) -> DataFrame:
    """Mean overlap over union where a truth exists, else the share with any playbook."""
    both = F.size(F.array_intersect("predicted_playbooks", "truth_playbooks"))
    either = F.size(F.array_union("predicted_playbooks", "truth_playbooks"))
    known = F.size("truth_playbooks") > 0
    fallback = F.coalesce(F.avg(F.when(F.col("truth") != "normal", (F.size("predicted_playbooks") > 0).cast("int"))), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(F.when(known, both / either)), fallback).alias("jaccard"))


# --- operations --------------------------------------------------------------


def confusion_suite(rows: DataFrame, pred: Column, truth: Column, keys=()) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("true_positives", "false_positives", "true_negatives", "false_negatives"))
    return confusion(rows, pred, truth, keys).withColumns({
        "precision": safe_div(tp, tp + fp), "recall": safe_div(tp, tp + fn), "f1_score": safe_div(2 * tp, 2 * tp + fp + fn),
        "accuracy": safe_div(tp + tn, tp + fp + tn + fn), "fpr": safe_div(fp, fp + tn), "specificity": safe_div(tn, tn + fp)})


def response_times(incidents: DataFrame, keys=("period",)) -> DataFrame:
    """Mean minutes to detect and to contain; infinite when nothing was."""
    inf = F.lit(float("inf"))
    return incidents.groupBy(*keys).agg(
        F.coalesce(F.avg("detect_minutes"), inf).alias("mttd"), F.coalesce(F.avg("contain_minutes"), inf).alias("mttc"))


def operations_kpis(incidents: DataFrame, keys=("period",)) -> DataFrame:
    """Time reduction, load per analyst and the efficiency score of each group."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    base = incidents.groupBy(*keys).agg(
        F.avg("manual_minutes").alias("manual"), F.avg("automated_minutes").alias("automated"),
        F.count(F.lit(1)).alias("n"), F.count_distinct("analyst").alias("analysts"), F.avg("detect_minutes").alias("mttd"))
    quality = confusion_suite(incidents, F.col("flagged"), F.col("is_attack"), keys).select(*keys, "precision", "recall")
    saved = F.when(F.col("manual") > 0, clip((F.col("manual") - F.col("automated")) / F.col("manual"))).otherwise(F.lit(0.0))
    speed = 1.0 - F.least(F.coalesce("mttd", F.lit(float("inf"))) / 30.0, F.lit(1.0))
    return base.join(quality, list(keys)).select(
        *keys, saved.alias("time_reduction"), safe_div(F.col("n"), F.col("analysts")).alias("incidents_per_analyst"),
        clip(0.25 * F.col("precision") + 0.35 * F.col("recall") + 0.20 * saved + 0.20 * speed).alias("efficiency"))


def overall_score(metrics: DataFrame) -> DataFrame:
    """``metrics(run, family, value)`` -> mean per family and the weighted score."""
    weights = vocab.METRIC_FAMILY_WEIGHTS
    wide = metrics.groupBy("run").agg(*[
        F.coalesce(F.avg(F.when(F.col("family") == f, F.col("value"))), F.lit(0.0)).alias(f"avg_{f}_score") for f in weights])
    return wide.withColumn("overall_system_score", reduce(lambda a, b: a + b, [w * F.col(f"avg_{f}_score") for f, w in weights.items()]))
