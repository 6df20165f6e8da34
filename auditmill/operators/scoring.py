"""Thresholds, score fusion, metrics and the alert table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from auditmill import vocab
from auditmill.functions.ranks import auc, exact_percentiles
from auditmill.functions.scalars import fixed
from auditmill.session import materialize

KEYS = ["user_name", "window"]


# --- thresholds --------------------------------------------------------------


def threshold_grid(scored: DataFrame, percentiles, score: str = "score", by: str | None = None) -> DataFrame:
    """F1 for every percentile of the score, in one pass over the rows."""
    keys = [by] if by else []
    cuts = exact_percentiles(scored, score, [p / 100 for p in percentiles], by)
    if by:
        lookup = cuts.agg(F.map_from_entries(F.collect_list(F.struct(by, "percentiles")))).scalar()
        rows = scored.withColumn("cuts", lookup[F.col(by)])
    else:
        rows = scored.withColumn("cuts", cuts.scalar())
    s, y = F.col(score), F.col("is_attack")
    counts = rows.groupBy(*keys).agg(
        F.first("cuts").alias("cuts"), F.sum(y.cast("long")).alias("positives"),
        *[F.sum(((s >= F.col("cuts")[i]) & y).cast("long")).alias(f"tp{i}") for i in range(len(percentiles))],
        *[F.sum((s >= F.col("cuts")[i]).cast("long")).alias(f"flagged{i}") for i in range(len(percentiles))],
    )
    grid = counts.select(*keys, "positives", F.explode(F.array(*[F.struct(
        F.lit(p).alias("percentile"), F.col("cuts")[i].alias("threshold"),
        F.col(f"tp{i}").alias("tp"), F.col(f"flagged{i}").alias("flagged"),
    ) for i, p in enumerate(percentiles)])).alias("g"))
    f1 = F.when(F.col("g.tp") > 0, 2.0 * F.col("g.tp") / (F.col("g.flagged") + F.col("positives"))).otherwise(F.lit(0.0))
    return grid.select(*keys, "g.*", f1.alias("f1"))


def best_f1_threshold(scored: DataFrame, percentiles=None, score: str = "score", by: str | None = None) -> DataFrame:
    """The threshold with the best F1; among equals the lowest percentile."""
    percentiles = percentiles or vocab.MODEL_PERCENTILES
    keys = [by] if by else []
    grid = threshold_grid(scored, percentiles, score, by)
    best = F.max_by(F.struct("percentile", "threshold", "f1"), F.struct("f1", -F.col("percentile")))
    return grid.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


# --- fusion ------------------------------------------------------------------


def minmax(scored: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Min-max normalised copies of score columns (0 when constant)."""
    span = scored.agg(F.struct(*[
        F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns]).alias("s")).scalar()

    def scale(c) -> Column:
        lo, hi = F.col(f"_span.{c}.lo"), F.col(f"_span.{c}.hi")
        return F.when(hi != lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))

    return scored.withColumn("_span", span).withColumns(
        {out: scale(c) for c, out in columns.items()}).drop("_span")


def fuse_scores(if_scores: DataFrame, lof_scores: DataFrame, ae_scores: DataFrame, weights=None) -> DataFrame:
    """Windows scored by all three models, with normalised scores and the weighted sum."""
    weights = weights or vocab.ENSEMBLE_WEIGHTS
    merged = if_scores.join(lof_scores, KEYS).join(ae_scores, KEYS)
    merged = minmax(merged, {f"{m}_score": f"{m}_norm" for m in weights})
    total = reduce(lambda a, b: a + b, [F.lit(w) * F.col(f"{m}_norm") for m, w in weights.items()])
    return merged.withColumn("ensemble_score", total)


def majority_vote(merged: DataFrame) -> DataFrame:
    votes = F.col("if_pred") + F.col("lof_pred") + F.col("ae_pred")
    return merged.withColumns({"vote_count": votes, "majority_vote": (votes >= 2).cast("int")})


def ensemble_scores(if_scores: DataFrame, lof_scores: DataFrame, ae_scores: DataFrame,
                    labels: DataFrame | None = None, weights=None, tune: bool = True) -> DataFrame:
    """The full score table, flagged at the best-F1 threshold (at p90 without labels)."""
    merged = majority_vote(fuse_scores(if_scores, lof_scores, ae_scores, weights))
    if labels is not None:
        merged = (
            merged.join(labels.select(*KEYS, "is_attack", "attack_id", "attack_name"), KEYS, "left")
            .withColumns({
                "is_attack": F.coalesce("is_attack", F.lit(False)),
                "attack_id": F.coalesce("attack_id", F.lit(0)),
                "attack_name": F.coalesce("attack_name", F.lit("normal")),
            }))
    merged = materialize(merged, "fused")  # read for the threshold and for the result
    if labels is not None and tune:
        cut = best_f1_threshold(merged, vocab.ENSEMBLE_PERCENTILES, "ensemble_score").select("threshold").scalar()
    else:
        cut = exact_percentiles(merged, "ensemble_score", [0.9]).select(F.col("percentiles")[0]).scalar()
    return merged.withColumn("ensemble_pred", (F.col("ensemble_score") >= cut).cast("int"))


def alert_table(scores: DataFrame) -> DataFrame:
    """Flagged windows, highest score first."""
    keep = [*KEYS, "ensemble_score", "if_norm", "lof_norm", "ae_norm", "vote_count"]
    keep += [c for c in ("attack_name", "is_attack") if c in scores.columns]
    return (scores.filter(F.col("ensemble_pred") == 1).select(*keep)
            .orderBy(F.desc("ensemble_score"), "user_name", "window"))


def models_by_prediction() -> Column:
    """Models whose prediction is set, with their normalised score."""
    names = {"if": "IsolationForest", "lof": "LOF", "ae": "Autoencoder"}
    return F.array_compact(F.array(*[
        F.when(F.col(f"{m}_pred") != 0,
               F.concat(F.lit(f"{n}(score="), fixed(F.col(f"{m}_norm"), 3), F.lit(")")))
        for m, n in names.items()]))


def alert_payload(scores: DataFrame) -> DataFrame:
    """Alert id, severity, models fired and query text of each row."""
    s = F.col("ensemble_score")
    fired = models_by_prediction()
    text = F.date_format("window", "yyyy-MM-dd HH:mm:ss")
    listed = F.when(F.size("models_fired") > 0, F.array_join("models_fired", ", ")).otherwise(F.lit("none"))
    return scores.withColumn("models_fired", fired).select(
        F.concat_ws("_", "user_name", text).alias("alert_id"),
        text.alias("timestamp"), F.col("user_name").alias("user"), "ensemble_score", "vote_count", "models_fired",
        F.when(s > 0.85, "critical").when(s > 0.70, "high").otherwise("medium").alias("severity"),
        F.concat(
            F.lit("User "), "user_name", F.lit(" anomalous behavior: ensemble score "), fixed(s, 3),
            F.lit(", models: "), listed, F.lit(". IF="), fixed(F.col("if_norm"), 3),
            F.lit(" LOF="), fixed(F.col("lof_norm"), 3), F.lit(" AE="), fixed(F.col("ae_norm"), 3), F.lit("."),
        ).alias("rag_query"),
    )


# --- metrics -----------------------------------------------------------------


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(scored: DataFrame, pred: Column, truth: Column, keys=()) -> DataFrame:
    count = lambda c: F.sum(c.cast("long"))
    return scored.groupBy(*keys).agg(
        count(pred & truth).alias("true_positives"), count(pred & ~truth).alias("false_positives"),
        count(~pred & ~truth).alias("true_negatives"), count(~pred & truth).alias("false_negatives"))


def binary_metrics(scored: DataFrame, pred: Column, truth: Column, keys=(), digits: int | None = 4) -> DataFrame:
    """Confusion cells, precision, recall, F1 and false positive rate (0 where undefined)."""
    tp, fp, tn, fn = (F.col(c) for c in ("true_positives", "false_positives", "true_negatives", "false_negatives"))
    out = confusion(scored, pred, truth, keys).withColumns({
        "precision": safe_div(tp, tp + fp), "recall": safe_div(tp, tp + fn),
        "f1": safe_div(2 * tp, 2 * tp + fp + fn), "false_positive_rate": safe_div(fp, fp + tn)})
    if digits is not None:
        out = out.withColumns({c: F.round(c, digits) for c in ("precision", "recall", "f1", "false_positive_rate")})
    return out


def roc_auc(scored: DataFrame, score: str, truth: Column, by: str | None = None) -> DataFrame:
    return auc(scored, score, truth, by)


def per_attack_detection(scored: DataFrame, pred: str, keys=()) -> DataFrame:
    """Windows, detected windows and rate for each attack."""
    return (
        scored.filter(F.col("attack_id") > 0).groupBy(*keys, "attack_id", "attack_name")
        .agg(F.count(F.lit(1)).alias("total_windows"), F.sum(pred).alias("detected"), F.avg(pred).alias("detection_rate"))
    )


def by_model(scores: DataFrame) -> DataFrame:
    """Long form: one row per window and model with its score and prediction."""
    models = {"isolation_forest": "if", "lof": "lof", "autoencoder": "ae", "ensemble": "ensemble"}
    return scores.select(*KEYS, "is_attack", "attack_id", "attack_name", F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(f"{m}_score").cast("double").alias("score"),
                 F.col(f"{m}_pred").alias("pred")) for n, m in models.items()])).alias("m")
    ).select(*KEYS, "is_attack", "attack_id", "attack_name", "m.*")


def compare_models(scores: DataFrame) -> DataFrame:
    """One row per model with its metrics, best F1 first."""
    long = by_model(scores)
    metrics = binary_metrics(long, F.col("pred") == 1, F.col("is_attack"), ["model"])
    areas = roc_auc(long, "score", F.col("is_attack"), "model")
    return (metrics.join(areas.select("model", F.round("roc_auc", 4).alias("roc_auc")), "model")
            .orderBy(F.desc("f1"), "model"))


def model_coverage(scores: DataFrame) -> DataFrame:
    """Per attack: windows, and how many each model flagged."""
    return (
        scores.filter(F.col("attack_id") > 0).groupBy("attack_id", "attack_name")
        .agg(F.count(F.lit(1)).alias("total"),
             *[F.sum(f"{m}_pred").alias(f"{m}_detected") for m in ("if", "lof", "ae", "ensemble")])
    )
