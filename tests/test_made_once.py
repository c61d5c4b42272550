"""What is published is made once."""

from pyspark.sql import functions as F

from tidemark.operators import published


def test_equal_tables_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    rows = spark.range(40).select("id", (F.col("id") * 2).alias("v"))
    wanted = rows.select("id", F.udf(seen, "long")("v").alias("v"))
    off, joined = published.differences(rows, wanted, ("id",))
    assert off.count() == 0 and joined.first()["joined"] == 0
    assert made.value == 40
    off, joined = published.differences(rows, rows.withColumn("v", F.when(F.col("id") == 3, -1).otherwise(F.col("v"))), ("id",))
    assert [tuple(r) for r in off.collect()] == [(3, "v")] and joined.first()["joined"] >= 1
