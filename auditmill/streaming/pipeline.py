"""Incremental versions of ingest, window counts, deduplication and alerting.

Each function starts a query that processes what is available and stops
(``availableNow``); run again with the same checkpoint it continues.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from auditmill import schema
from auditmill.functions.scalars import is_business_hours
from auditmill.operators.features import FLAG_COUNTS, event_flags, with_ratios
from auditmill.operators.models import score_new_rows
from auditmill.operators.normalize import flatten_events
from auditmill.operators.scoring import KEYS
from auditmill.session import ship_package, write_table


def read_audit_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Flat events of new log files."""
    docs = (
        spark.readStream.schema(schema.RAW_FILE).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json.gz").option("maxFilesPerTrigger", files_per_trigger).json(path))
    return flatten_events(docs.select(F.explode("Records").alias("r")).select("r.*"))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = {"stateStore.providerClass": ROCKS, "stateStore.rocksdb.boundedMemoryUsage": "true", "stateStore.rocksdb.maxMemoryUsageMB": "300", "minBatchesToRetain": "2"}


@contextmanager
def state_on_disk(spark: SparkSession):
    """Queries that start inside keep their state in files, with a bounded part of each executor's memory, and two versions of it."""
    names = {f"spark.sql.streaming.{k}": v for k, v in STATE.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write a stream to a parquet table, exactly once per checkpoint."""
    with state_on_disk(stream.sparkSession):
        query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
                 .outputMode(mode).trigger(availableNow=True).start())
        query.awaitTermination()


EVENTS_TOGETHER = 1 << 20


def time_slices(events: DataFrame, path: str, time: str = "eventTime", files: int = 8) -> list[DataFrame]:
    """Store a table of events below ``path`` in slices that follow each other in time, of about ``EVENTS_TOGETHER`` rows each.

    A slice has time-ordered files.  Rows without a time are in the first one.
    """
    micros = F.unix_micros(F.col(time))
    n = events.count()
    slices = max(1, -(-n // EVENTS_TOGETHER))
    cuts = sorted(set(events.agg(F.percentile_approx(micros, [i / slices for i in range(1, slices)], 10_000)).first()[0] or [])) if slices > 1 else []
    number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), lambda c: F.coalesce(micros > c, F.lit(False))))
    dealt = events.repartitionByRange(files * (len(cuts) + 1), time).sortWithinPartitions(time)
    write_table(dealt.withColumn("slice", number), path, by="slice")
    stored = events.sparkSession.read.schema(T.StructType([*events.schema.fields, T.StructField("slice", T.IntegerType())])).parquet(path)
    return [stored.filter(F.col("slice") == i).drop("slice") for i in range(len(cuts) + 1)]


def replay(slices: list[DataFrame], source: str, counted, path: str, checkpoint: str) -> None:
    """Let ``counted(stream)`` read ``slices`` one after the other, as if each arrived when the one before was done.

    A run takes what one slice brings, so its state is that of the windows which are open then.
    """
    for rows in slices:
        rows.write.mode("append").parquet(source)
        run_to_table(counted(rows.sparkSession.readStream.schema(rows.schema).parquet(source)), path, checkpoint)


DISTINCT_COUNTS = {"unique_resources": "request_bucket_name", "unique_ips": "sourceIPAddress", "unique_event_types": "eventName"}


def stream_window_counts(events: DataFrame, window_minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Window counts on a stream; rows later than ``delay`` are dropped.

    Two aggregations in a chain: the first keeps one row for each value of a window, the second counts
    these, so the distinct counts are exact.  The state holds the distinct values of the open windows; a
    busy user is spread by them in the first aggregation.
    """
    size = f"{window_minutes} minutes"
    rows = event_flags(events.filter(F.col("user_name").isNotNull()).withColumn(
        "is_business_hours", F.coalesce(is_business_hours(F.col("eventTime")), F.lit(False))))
    parts = F.array(F.struct(F.lit("all").alias("part"), F.xxhash64("eventID").bitwiseAND(F.lit(63)).cast("string").alias("value")), *[
        F.struct(F.lit(name).alias("part"), F.col(column).alias("value")) for name, column in DISTINCT_COUNTS.items()])
    sums = {name: F.sum(F.col(flag).cast("long")) for name, flag in FLAG_COUNTS.items()}
    sums |= {"total_events": F.count("eventID"), "bytes_out_total": F.sum("bytes_transferred_out")}
    values = (
        rows.withWatermark("eventTime", delay).withColumn("p", F.explode(parts))
        .groupBy("user_name", F.window("eventTime", size).alias("w"), F.col("p.part").alias("part"), F.col("p.value").alias("value"))
        .agg(*[c.alias(name) for name, c in sums.items()], F.max("bytes_transferred_out").alias("bytes_out_max")))
    whole = F.col("part") == "all"
    counted = values.groupBy("user_name", F.window("w", size).alias("v")).agg(
        F.sum(F.when(whole, F.col("total_events"))).alias("total_events"),
        *[F.sum(F.when(whole, F.col(name))).alias(name) for name in FLAG_COUNTS],
        *[F.count(F.when(F.col("part") == name, F.col("value"))).alias(name) for name in DISTINCT_COUNTS],
        F.sum(F.when(whole, F.col("bytes_out_total"))).alias("bytes_out_total"), F.max("bytes_out_max").alias("bytes_out_max"))
    return with_ratios(counted.withColumn("window", F.col("v.start")).drop("v"))


def stream_dedup(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per event id among the events within ``delay`` of each other."""
    return events.withWatermark("eventTime", delay).dropDuplicatesWithinWatermark(["eventID"])


def stream_alerts(windows: DataFrame, baselines: DataFrame, threshold: float, path: str, checkpoint: str) -> None:
    """Flag windows far above their user's saved baseline and add them to the alert table."""
    saved = baselines.select("user_name", "total_events_mean", "total_events_std")

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = batch.join(saved, "user_name", "left").withColumn("score", F.coalesce(
            (F.col("total_events") - F.col("total_events_mean")) / F.col("total_events_std"), F.lit(0.0)))
        add_alerts(scored.filter(F.col("score") > threshold), path, batch_id)

    (windows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


ALERT_COLUMNS = "user_name string, window timestamp, total_events long, score double, model_score double"
ALERTS = f"{ALERT_COLUMNS}, day date, batch int"


def add_alerts(alerts: DataFrame, path: str, batch_id: int) -> None:
    """Add the alerts of one batch; windows that the table holds already are left out.

    The table is stored by day and batch.  A batch that is run again after a failure replaces its own
    folders, and only the days that the batch touches are read.
    """
    spark = alerts.sparkSession
    if "model_score" not in alerts.columns:
        alerts = alerts.withColumn("model_score", F.lit(None).cast("double"))
    names = [c.split()[0] for c in ALERT_COLUMNS.split(", ")]
    new = alerts.select(*names).dropDuplicates(KEYS).withColumns({"day": F.to_date("window"), "batch": F.lit(batch_id)}).persist()
    try:
        days = [r.day for r in new.select("day").distinct().collect()]  # of one batch
        known = read_alerts(spark, path)
        if known is not None and days:
            old = known.filter(F.col("day").isin(days) & (F.col("batch") < batch_id)).select(*KEYS)
            new = new.join(old, KEYS, "left_anti")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
    finally:
        new.unpersist()


def read_alerts(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(ALERTS).parquet(path)


# --- baselines that are kept as state ------------------------------------------------

SEEN = "n long, mean double, m2 double"


class UserBaseline(StatefulProcessor):
    """Number, mean and squared deviations of a user's windows so far; every window is scored before it counts."""

    def __init__(self, column: str):
        self.column = column

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", SEEN)

    def handleInputRows(self, key, rows, timerValues):
        n, mean, m2 = self.seen.get() if self.seen.exists() else (0, 0.0, 0.0)
        pdf = pd.concat(list(rows)).sort_values("window", kind="stable")  # the closed windows of one user in one batch
        scores = []
        for x in pdf[self.column].astype(float):
            spread = math.sqrt(m2 / n) if n else 0.0
            scores.append((x - mean) / spread if spread > 0 else 0.0)
            n += 1
            step = x - mean
            mean += step / n
            m2 += step * (x - mean)
        self.seen.update((n, mean, m2))
        yield pdf.assign(score=scores, seen=range(n - len(pdf), n))

    def close(self) -> None:
        pass


def keyed_scores(windows: DataFrame, column: str = "total_events") -> DataFrame:
    """Add ``score``, the deviation from the user's windows before, and ``seen``, their number.

    The baseline is state of the query: it survives restarts and needs no table of earlier windows.
    Windows are taken in order of time within a batch; batches in order of arrival.
    """
    schema = windows.schema.simpleString()[len("struct<"):-1]
    return windows.groupBy("user_name").transformWithStateInPandas(
        UserBaseline(column), f"{schema}, score double, seen long", outputMode="append", timeMode="None")


def stream_model_alerts(windows: DataFrame, path: str, checkpoint: str, threshold: float = 3.0, warm_up: int = 2,
                        model: str | None = None, columns: list[str] | None = None) -> None:
    """Alerts from baselines kept as state and, with ``model``, from a saved scaler, model and threshold.

    A window is an alert when its user has ``warm_up`` earlier ones and it is ``threshold`` deviations above
    them, or when the saved model flags it.
    """
    spark = windows.sparkSession
    ship_package(spark)
    scored = keyed_scores(windows)

    def write(batch: DataFrame, batch_id: int) -> None:
        hit = (F.col("score") > threshold) & (F.col("seen") >= warm_up)
        if model is not None:
            judged = score_new_rows(spark, batch.withColumnRenamed("score", "_score"), model, columns)
            batch = judged.withColumnRenamed("score", "model_score").withColumnRenamed("_score", "score")
            hit = hit | (F.col("pred") == 1)
        add_alerts(batch.filter(hit), path, batch_id)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        query = (scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    query.awaitTermination()
