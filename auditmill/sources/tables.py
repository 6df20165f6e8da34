"""Score tables, labels, knowledge base, metrics, reports and dataset status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditmill import schema


def write_scores_csv(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").option("header", True).csv(path)


def read_scores_csv(spark: SparkSession, path: str, model: str) -> DataFrame:
    """``user_name, window, <model>_score, <model>_pred`` with ``window`` in UTC."""
    return (
        spark.read.option("header", True).option("enforceSchema", False)
        .schema(f"user_name string, window timestamp, {model}_score double, {model}_pred int").csv(path)
    )


def read_label_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; blank lines give no row."""
    return spark.read.schema(schema.LABELS).json(path).filter(F.col("eventID").isNotNull())


def read_knowledge_base(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Entities of one kind from JSON array files; rows without their id are dropped."""
    ddl, key = {
        "technique": (schema.TECHNIQUE, "technique_id"),
        "pattern": (schema.PATTERN, "pattern_id"),
        "playbook": (schema.PLAYBOOK, "playbook_id"),
        "service": (schema.SERVICE, "service_name"),
    }[kind]
    rows = spark.read.schema(ddl).option("multiLine", True).json(path)
    return rows.filter(F.coalesce(F.col(key), F.lit("")) != "")


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relations from a JSON array, or from an object that holds it as ``relationships``."""
    nested = f"relationships array<struct<{schema.RELATION}>>"
    rows = spark.read.schema(f"{schema.RELATION}, {nested}").option("multiLine", True).json(path)
    flat = rows.filter("relationships is null").drop("relationships")
    inner = rows.select(F.explode("relationships").alias("r")).select("r.*")
    return flat.unionByName(inner)


def write_metrics_json(metrics: DataFrame, per_attack: DataFrame, path: str) -> None:
    """One JSON document per model, with its list of per-attack rows."""
    nested = per_attack.groupBy("model").agg(
        F.sort_array(F.collect_list(F.struct("attack_name", "total_windows", "detected", "detection_rate")))
        .alias("per_attack_detection"))
    metrics.join(nested, "model", "left").write.mode("overwrite").json(path)


def dataset_status(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Existence, size, time and rows of each dataset; ``ready`` = all of them present."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = None
    for name, path in paths.items():
        if hadoop(path).getFileSystem(conf).exists(hadoop(path)):
            files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size",
                                                    "_metadata.file_modification_time")
            one = files.groupBy("file_path").agg(
                F.count(F.lit(1)).alias("rows"), F.max("file_size").alias("size"),
                F.max("file_modification_time").alias("modified"),
            ).agg(F.sum("rows").alias("rows"), F.round(F.sum("size") / 1048576, 2).alias("size_mb"),
                  F.max("modified").alias("modified"))
            one = one.select(F.lit(name).alias("dataset"), F.lit(True).alias("exists"),
                             F.coalesce("rows", F.lit(0)).alias("rows"), "size_mb", "modified")
        else:
            one = spark.range(1).select(
                F.lit(name).alias("dataset"), F.lit(False).alias("exists"), F.lit(0).cast("long").alias("rows"),
                F.lit(None).cast("double").alias("size_mb"), F.lit(None).cast("timestamp").alias("modified"))
        out = one if out is None else out.unionByName(one)
    ready = out.agg(F.min(F.col("exists").cast("int")).alias("r")).select((F.col("r") == 1)).scalar()
    return out.withColumn("ready", ready)


def read_reports(spark: SparkSession, path: str, glob: str = "incident_report_*.txt") -> DataFrame:
    """Whole report files, with the time in their name, sorted by name."""
    name = F.col("_metadata.file_name")
    stamp = F.regexp_extract("file", r"incident_report_(\d{8}_\d{6})", 1)
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .text(path, wholetext=True)
        .select(name.alias("file"), F.col("value").alias("content"))
        .withColumn("timestamp", F.nullif(stamp, F.lit("")))
        .orderBy("file")
    )


def write_window_labels_csv(features: DataFrame, path: str) -> None:
    (features.select("user_name", "window", "is_attack", "attack_id", "attack_name")
     .write.mode("overwrite").option("header", True).csv(path))


def read_window_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("header", True).schema(
            "user_name string, window timestamp, is_attack boolean, attack_id int, attack_name string")
        .csv(path)
    )
