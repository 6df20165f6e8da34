"""Tables whose files are small for their rows are not sent whole to every task."""

from pyspark.sql import functions as F

from auditmill.plans import adapter


def test_compressible_tables_are_joined_by_shuffles(spark, tmp_path):
    spark.conf.unset("spark.sql.sources.fileCompressionFactor")
    # a few bytes a row in the file, some hundred in a hash table
    rows = spark.range(800_000).select(F.concat(F.lit("user-"), (F.col("id") / 100).cast("long")).alias("user_name"), (F.xxhash64("id") % 1000).alias("window"), F.lit(1.0).alias("score"))
    for name in ("one", "two"):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    size = sum(f.stat().st_size for f in (tmp_path / "two.parquet").glob("*.parquet"))
    assert 500_000 < size < 10 << 20  # below Spark's limit for broadcasts
    both = adapter.table(spark, str(tmp_path), "one").join(adapter.table(spark, str(tmp_path), "two").drop("score"), ["user_name", "window"])
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    tiny = spark.range(10).select(F.col("id").alias("window"), F.lit("x").alias("name"))
    tiny.write.parquet(f"{tmp_path}/tiny.parquet")
    small = adapter.table(spark, str(tmp_path), "one").join(adapter.table(spark, str(tmp_path), "tiny"), "window")
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
