"""Text is read once, and relations are judged in one pass."""

from pyspark.sql import functions as F

from tidemark.operators import contracts, diagnosis


def test_days(spark):
    texts = ["1998-02-28", "1998-02-30", "2000-02-29", "1900-02-29", "0000-01-01", "0001-01-01", "9999-12-31", "19980203", "1998-2-03", " 1998-02-03", "1998-02-03 ", "1998-02-03\n", "1998-02-03T00:00:00", "1998-13-01", "1998-00-10", "1998-01-00", "١٩٩٨-٠٢-٠٣", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = rows.select("text", contracts.day(F.col("text")).cast("string").alias("day"), F.when(F.col("text").rlike(contracts.DAY), F.try_to_date("text", "yyyy-MM-dd")).cast("string").alias("parsed"))
    for r in found.collect():
        assert r["day"] == r["parsed"], r
    plan = rows.select(contracts.day(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "gettimestamp" not in plan.lower()


def test_relations_are_judged_in_one_pass(spark):
    rows = spark.createDataFrame([("a", 2, None), ("b", 1, 1), ("c", 3, 1)], "id string, n int, at int")
    found = diagnosis._related(rows, "t", F.col("id"), twice=F.col("n") > 1, orphan=F.col("at").isNull())
    assert sorted((r["locator"], r["code"]) for r in found.collect()) == [("a", "orphan"), ("a", "twice"), ("c", "twice")]
