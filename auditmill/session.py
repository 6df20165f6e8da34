"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


_OWN: set[str] = set()
_STEPS: list[list[str]] = []  # tables of the steps under way, innermost last
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows in memory over their size in compressed columns.  Spark compares file sizes with its limit for broadcasts; windows
#: and scores of a few bytes a row would be sent whole to every executor, as hash tables some 70 times their files.
FILE_COMPRESSION = "spark.sql.sources.fileCompressionFactor", "40"


def build_session(app: str = "auditmill", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config(*FILE_COMPRESSION)
    )
    if master:
        b = b.master(master)
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Calendar fields and window edges are defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_sizes(spark: SparkSession) -> SparkSession:
    """Let Spark judge broadcasts by the size in memory, where the session does not say otherwise."""
    name, factor = FILE_COMPRESSION
    if float(spark.conf.get(name)) == 1.0:
        spark.conf.set(name, factor)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only where none is named and everything runs in one process (local runs, tests) a
    temporary folder is made and kept in the session, so that later calls see the same one.
    On a cluster such a folder would be another one on each machine, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="auditmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/auditmill-{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system access; nothing happens once the session is gone."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    try:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # at exit the gateway may be closed already
        return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df, path: str, mode: str = "error", by: str | None = None) -> None:
    """Write ``df`` as parquet, in folders ``by`` a column; its shuffle files are removed then, not when the driver happens to collect garbage."""
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.mode(mode).parquet(path, partitionBy=by)
    finally:
        conf.set(FREE_SHUFFLES, before)


def materialize(df, name: str):
    """Cut the lineage of ``df`` by writing it as a table in the shared folder."""
    spark = df.sparkSession
    path = step_path(spark, name)
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


def step_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table that goes with the step around it, if ``freed`` runs one."""
    path = scratch_path(spark, name)
    if _STEPS:
        _STEPS[-1].append(path)
    return path


@contextmanager
def freed(spark: SparkSession):
    """Remove the tables that ``materialize`` writes inside once the block ends.

    What is read later must be written within an outer block or none: ``keep`` does that.
    """
    _STEPS.append([])
    try:
        yield
    finally:
        for path in _STEPS.pop():
            remove(spark, path)


def keep(df, name: str):
    """``materialize`` for what a ``freed`` block leaves."""
    inner = _STEPS.pop()
    try:
        return materialize(df, name)
    finally:
        _STEPS.append(inner)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session: they need not run in its folder."""
    flag = "auditmill.shipped"
    if spark.conf.get(flag, "") == spark.sparkContext.applicationId:
        return
    package, held = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    folder = tempfile.mkdtemp(prefix="auditmill-")  # on the driver only, which serves it to the executors
    name = os.path.join(os.path.realpath(folder), "auditmill.zip")
    Path(name).write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(name)
    spark.conf.set(flag, spark.sparkContext.applicationId)
