from pathlib import Path

from pyspark.sql import functions as F

from cohortspark.plans.shared import checked_broadcast, discard, fits_broadcast, shared_dir, written


def test_written_table_has_the_same_rows(spark):
    df = spark.range(10).withColumn("x", F.when(F.col("id") > 5, F.lit("a")))
    again = written(df, "test")
    assert again.dtypes == df.dtypes and sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    assert written(df.limit(0), "test").count() == 0 and shared_dir(spark) == shared_dir(spark)


def test_broadcast_only_below_the_bound(spark):
    small, large = spark.range(3), spark.range(30)
    plan = lambda side: spark.range(100).join(side, "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(checked_broadcast(small, 5)) and "broadcast" not in plan(checked_broadcast(large, 5))
    assert checked_broadcast(large, 5).count() == 30 and checked_broadcast(small.limit(0)).count() == 0


def test_bytes_are_bounded_too(spark):
    wide = written(spark.range(50).select("id", F.sha2(F.col("id").cast("string"), 512).alias("x")), "test")
    assert fits_broadcast(wide) and not fits_broadcast(wide, max_bytes=1000) and not fits_broadcast(wide, max_rows=49)


def test_discard_deletes_shared_tables_only(spark, tmp_path):
    table, other = written(spark.range(5), "test"), spark.range(5)
    other.write.parquet(f"{tmp_path}/kept")
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    discard(table, spark.read.parquet(f"{tmp_path}/kept"))
    assert not Path(folder).exists() and spark.read.parquet(f"{tmp_path}/kept").count() == 5
