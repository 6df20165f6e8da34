"""Dashboard queries over the alert table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TIES = ("user_name", "window")


def filter_alerts(alerts: DataFrame, user_name: str | None = None, attack_name: str | None = None,
                  min_score: float | None = None, is_attack: bool | None = None) -> DataFrame:
    """Optional filters; ``user_name`` is a case-insensitive regular expression."""
    if user_name:
        alerts = alerts.filter(F.col("user_name").rlike(f"(?i){user_name}"))
    if attack_name:
        alerts = alerts.filter(F.col("attack_name") == attack_name)
    if min_score is not None:
        alerts = alerts.filter(F.col("ensemble_score") >= min_score)
    if is_attack is not None:
        alerts = alerts.filter(F.col("is_attack") == is_attack)
    return alerts


def page_alerts(alerts: DataFrame, page: int = 1, page_size: int = 50, sort_by: str = "ensemble_score",
                sort_order: str = "desc") -> DataFrame:
    """One page in the chosen order, with the total number of alerts."""
    total = alerts.agg(F.count(F.lit(1))).scalar()
    first = F.asc(sort_by) if sort_order == "asc" else F.desc(sort_by)
    ties = [c for c in TIES if c != sort_by]
    return (alerts.orderBy(first, *ties).offset((page - 1) * page_size).limit(page_size)
            .withColumn("total", total))


def alert_lookup(alerts: DataFrame, user_name: str, window) -> DataFrame:
    """The alert of one user and window."""
    return alerts.filter((F.col("user_name") == user_name) & (F.col("window") == F.lit(window))).limit(1)


def alert_lookup_all(alerts: DataFrame, keys: DataFrame) -> DataFrame:
    """The alert of every (user, window) in ``keys``; null where there is none."""
    first = alerts.groupBy(*TIES).agg(F.min(F.struct(
        *[F.col(c) for c in alerts.columns if c not in TIES])).alias("a"))
    return keys.select(*TIES).join(first, list(TIES), "left").select(*TIES, "a.*")


def severity(score):
    return F.when(score >= 0.7, "high").when(score >= 0.3, "medium").otherwise("low")


def severity_buckets(alerts: DataFrame) -> DataFrame:
    level = severity(F.col("ensemble_score"))
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        *[F.coalesce(F.sum((level == s).cast("long")), F.lit(0)).alias(f"{s}_severity_count")
          for s in ("high", "medium", "low")],
        F.count_distinct("user_name").alias("unique_users_affected"))


def attack_distribution(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("attack_name").agg(F.count(F.lit(1)).alias("alerts"))


def alert_timeline(alerts: DataFrame) -> DataFrame:
    return (alerts.groupBy(F.date_format("window", "yyyy-MM-dd").alias("date"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy("date"))


def top_users(alerts: DataFrame, n: int = 10) -> DataFrame:
    return (
        alerts.groupBy("user_name").agg(
            F.count(F.lit(1)).alias("alert_count"), F.round(F.avg("ensemble_score"), 3).alias("avg_score"),
            F.round(F.max("ensemble_score"), 3).alias("max_score"))
        .orderBy(F.desc("alert_count"), "user_name").limit(n))


def filter_options(alerts: DataFrame, techniques: DataFrame | None = None) -> DataFrame:
    """Distinct users and attack types, and the techniques if given, as sorted rows."""
    users = alerts.select(F.lit("user").alias("kind"), F.col("user_name").alias("value"))
    attacks = alerts.select(F.lit("attack_type").alias("kind"), F.col("attack_name").alias("value"))
    rows = users.unionByName(attacks)
    if techniques is not None:
        name = F.concat_ws(": ", "technique_id", "name")
        rows = rows.unionByName(technique_options(techniques).select(F.lit("technique").alias("kind"), name.alias("value")))
    return rows.distinct().orderBy("kind", "value")


def technique_options(techniques: DataFrame) -> DataFrame:
    return (techniques.filter("technique_id <> ''").select("technique_id", "name").distinct()
            .orderBy("technique_id", "name"))


def overview_stats(alerts: DataFrame) -> DataFrame:
    """One nested row: totals, attack types, alerts by date (a row per day), top users."""
    def listed(df, name):
        return df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name)).scalar()

    users = top_users(alerts).select(
        (-F.col("alert_count")).alias("order"), F.col("user_name").alias("user"), "alert_count", "avg_score", "max_score")
    return severity_buckets(alerts).withColumns({
        "attack_types": listed(attack_distribution(alerts), "attack_types"),
        "alerts_by_date": listed(alert_timeline(alerts), "alerts_by_date"),
        "_top": listed(users, "top_users"),
    }).withColumn("top_users", F.transform("_top", lambda u: u.dropFields("order"))).drop("_top")


MODEL_RESULTS = ("model string, precision double, recall double, f1 double, roc_auc double, "
                 "true_positives long, false_positives long, true_negatives long, false_negatives long, "
                 "false_positive_rate double, per_attack_detection array<struct<attack_name string, "
                 "total_windows long, detected long, detection_rate double>>")


def model_performance(spark: SparkSession, path: str) -> DataFrame:
    """Metrics per model, from the top level of the result documents."""
    return spark.read.schema(MODEL_RESULTS).json(path).select(
        F.col("model").alias("model_name"), "precision", "recall", F.col("f1").alias("f1_score"),
        "true_positives", "false_positives", "false_negatives")


def top_k_alerts(alerts: DataFrame, n: int = 10) -> DataFrame:
    return alerts.orderBy(F.desc("ensemble_score"), *TIES).limit(n)
