"""Audit logs: readers and writers."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditmill import schema
from auditmill.functions.scalars import floor_window
from auditmill.operators.normalize import parse_event_time


def read_audit_json(spark: SparkSession, path, max_files: int | None = None) -> DataFrame:
    """Records of all ``*.json.gz`` files below ``path``.

    A file that cannot be decoded, or has no ``Records``, gives no rows.  Gzip files
    are not splittable, so parallelism comes from the number of files.  ``max_files``
    keeps the first files by name, as a listing only (no content is read for it).
    """
    if max_files:
        names = (
            spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.json.gz").load(path)
            .select("path").orderBy("path").limit(max_files)
        )
        path = [r.path for r in names.collect()]  # at most max_files names
    return _documents(spark, path).select(F.explode("Records").alias("r")).select("r.*")


def _documents(spark: SparkSession, path) -> DataFrame:
    """One row for each file that can be decoded; ``Records`` is null where it has none."""
    return (
        spark.read.schema(schema.RAW_FILE)
        .option("multiLine", True).option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json.gz")
        .option("ignoreCorruptFiles", True).json(path)
    )


def skipped_audit_files(spark: SparkSession, path) -> DataFrame:
    """(file, bytes) of the ``*.json.gz`` files below ``path`` that ``read_audit_json`` takes nothing from.

    These are files that cannot be decoded and files without ``Records``; a file with an empty list is read.
    The listing reads no content.
    """
    name = F.col("_metadata.file_path").alias("file")
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json.gz").load(path)
              .select(name, F.col("length").alias("bytes")))
    read = _documents(spark, path).filter("Records is not null").select(name).distinct()
    return listed.join(read, "file", "left_anti")


def day_paths(base: str, start: str, end: str) -> list[str]:
    """The day folders ``base/YYYY/MM/DD`` of an inclusive range."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    days = (first + timedelta(n) for n in range((last - first).days + 1))
    return [f"{base.rstrip('/')}/{d:%Y/%m/%d}" for d in days]


def read_audit_json_range(spark: SparkSession, base: str, start: str, end: str) -> DataFrame:
    """Only the files of the days in ``[start, end]``; other folders are not listed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [p for p in day_paths(base, start, end) if hadoop(p).getFileSystem(conf).exists(hadoop(p))]
    if not paths:
        return spark.createDataFrame([], schema.RAW_EVENT)
    return read_audit_json(spark, paths)


def write_audit_json_buckets(
    raw: DataFrame, path: str, window_minutes: int = 15, max_records: int = 100_000,
) -> None:
    """One or more gzip JSON documents ``{"Records": [...]}`` per time bucket.

    Documents go to ``YYYY/MM/DD`` folders; records whose time cannot be read form a bucket
    of their own in ``unparsed``.  A bucket with more than ``max_records`` records is written
    as several documents, as the log service itself does, so that no task holds an unbounded
    bucket.
    """
    bucketed = raw.withColumn("bucket", floor_window(parse_event_time(F.col("eventTime")), window_minutes))
    record = F.struct(*[F.col(c) for c in raw.columns])
    sizes = bucketed.groupBy("bucket").agg(
        F.ceil(F.count(F.lit(1)) / max_records).cast("int").alias("parts"))
    documents = (
        bucketed.join(sizes.withColumnRenamed("bucket", "_bucket"), F.col("bucket").eqNullSafe(F.col("_bucket")))
        .withColumn("part", F.pmod(F.xxhash64(record), F.col("parts")))
        .groupBy("bucket", "part")
        .agg(F.sort_array(F.collect_list(F.struct("eventTime", "eventID", record.alias("record"))))
             .alias("items"))
        .select(
            F.coalesce(F.date_format("bucket", "yyyy-MM-dd"), F.lit("unparsed")).alias("day"),
            F.transform("items", lambda i: i["record"]).alias("Records"),
        )
    )
    # maxRecordsPerFile=1: every document is a file of its own
    (documents.write.partitionBy("day").option("compression", "gzip")
     .option("maxRecordsPerFile", 1).mode("overwrite").json(path))
    _plain_day_folders(raw.sparkSession, path)


def _plain_day_folders(spark: SparkSession, path: str) -> None:
    """``day=2026-02-23`` becomes ``2026/02/23``: one rename per day, no data is moved."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(conf)
    for found in store.listStatus(hadoop(path)):
        name = found.getPath().getName()
        if name.startswith("day="):
            to = hadoop(f"{path.rstrip('/')}/{name.removeprefix('day=').replace('-', '/')}")
            store.mkdirs(to.getParent())
            if not store.rename(found.getPath(), to):
                raise OSError(f"cannot rename {found.getPath()} to {to}")


def read_audit_buckets(spark: SparkSession, path: str, start: str | None = None,
                       end: str | None = None) -> DataFrame:
    """Documents written by :func:`write_audit_json_buckets`, all or those of the days ``start..end``."""
    if start and end:
        return read_audit_json_range(spark, path, start, end)
    return read_audit_json(spark, path)


def events_by_day(raw: DataFrame) -> DataFrame:
    """Day and number of events, days ascending."""
    day = F.substring(F.coalesce("eventTime", F.lit("")), 1, 10)
    return raw.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("events")).orderBy("day")


def write_events_by_day(raw: DataFrame, path: str) -> None:
    """The rows form: one folder per day, rows in time order inside each file."""
    day = F.substring(F.coalesce("eventTime", F.lit("")), 1, 10)
    (raw.withColumn("day", day).sortWithinPartitions("day", "eventTime")
     .write.partitionBy("day").mode("overwrite").parquet(path))


def write_events_parquet(events: DataFrame, path: str, partition_by_date: bool = False) -> None:
    writer = events.write.mode("overwrite")
    if partition_by_date and "event_date" in events.columns:
        # adaptive execution gathers small days and splits large ones by size
        writer = events.hint("rebalance", F.col("event_date")).write.mode("overwrite").partitionBy("event_date")
    writer.parquet(path)


def read_events_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Events with ``eventTime`` as a timestamp, whatever type it was stored in."""
    reader = spark.read.schema(schema) if schema else spark.read
    events = reader.parquet(path)
    if "eventTime" in events.columns:
        events = events.withColumn("eventTime", F.col("eventTime").cast("timestamp"))
    return events


def read_date_range(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Rows of the days ``start..end``; on a date-partitioned table the scan is pruned."""
    day = F.date_format(F.col("event_date").cast("date"), "yyyy-MM-dd")
    return (
        read_events_parquet(spark, path)
        .filter(F.col("event_date").between(F.lit(start), F.lit(end)))
        .withColumn("event_date", day)
    )
