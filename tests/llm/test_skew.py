from pyspark.sql import functions as F

from tallyfield.llm import skew


def test_equals_a_plain_join(spark):
    """One key with a third of the rows, keys that are not counted, and null keys."""
    rows = spark.range(30000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 101 == 1, None).otherwise(F.col("id") % 5000).alias("k"))
    counted = rows.where("k is not null and k % 2 = 1").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = skew.join_counted(rows, counted, ["k"], "id")
    assert sorted(got.columns) == ["first", "id", "k", "n"]
    want = rows.join(counted, "k").select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_hot_key_is_dealt(spark):
    rows = spark.range(30000).select("id", (F.col("id") % 3 * F.col("id")).alias("k"))
    counted = rows.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = skew.join_counted(rows, counted, ["k"], "id").where("k = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks == 8


def test_empty(spark):
    rows = spark.range(10).select("id", F.col("id").alias("k"))
    counted = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert skew.join_counted(rows, counted.where("false"), ["k"], "id").count() == 0
    assert skew.join_counted(rows.where("false"), counted, ["k"], "id").count() == 0
