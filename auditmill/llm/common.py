"""What several operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from auditmill.session import materialize, ship_package

#: Arrow batches end at this many rows or bytes, so a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 2_000, 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_ready(df: DataFrame) -> DataFrame:
    """Prepare the session for Python workers: the package on the executors, bounded Arrow batches."""
    spark = df.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def utf8_bytes(text: Column) -> Column:
    """Length in UTF-8 bytes, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def dense_rank_in(df: DataFrame, by: list[str], order: list[Column], bucket: Column, name: str,
                  summed: dict[str, Column] | None = None) -> DataFrame:
    """Gapless position from 0 inside each ``by`` group, in the order (``bucket``, ``order``), without one task per group.

    ``bucket`` is a small integer that comes first in the order; rows are numbered inside a
    (group, bucket) cell and shifted by what the lower cells of the group hold.  The table of
    cells is all that is ordered per group.  ``summed`` adds running sums before each row in
    the same order.
    """
    summed = summed or {}
    rows = df.withColumn("_bucket", bucket)
    cells = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{k}") for k, c in summed.items()])
    below = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_bucket").alias("_k_bucket"),
                          F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_start"),
                          *[F.coalesce(F.sum(f"_s_{k}").over(below), F.lit(0)).alias(f"_start_{k}") for k in summed])
    same = F.col("_bucket") == F.col("_k_bucket")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    numbered = rows.withColumns({"_row": F.row_number().over(inside) - 1, **{
        f"_in_{k}": F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for k, c in summed.items()}})
    out = numbered.join(starts, same).withColumns({
        name: F.col("_start") + F.col("_row"), **{k: F.col(f"_start_{k}") + F.col(f"_in_{k}") for k in summed}})
    return out.drop("_bucket", "_row", "_start", "_k_bucket", *[f"_k_{c}" for c in by],
                    *[f"_start_{k}" for k in summed], *[f"_in_{k}" for k in summed])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (``node``, ``component``) per node with an edge.

    ``component`` is the smallest node reachable.  Alternating stars: every node hands its
    larger neighbours to its smallest one, then keeps the smallest only, until nothing
    changes.  Every round is a shuffle of the edges and is written to the shared folder.
    """
    def minima(rows):
        return rows.groupBy("u").agg(F.min("v").alias("m"))

    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = minima(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # every node keeps its edge to its own smallest neighbour
        large = materialize(large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct(), name)
        small_min = minima(large)
        small = large.join(small_min, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small_min.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, name)
        summary = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == summary:
            break
        state = summary
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def runs(batches, keys: list[str]):
    """Tables of neighbouring rows that agree on the integer columns ``keys``; holds one run at a time."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch[k].to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(values[:, a].tolist())
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
