"""Stages of the pipeline judge rows by themselves, not by ids that others have too."""

from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near, phrases
from tidemark.sources.shared import stored


def test_clean_rows_of_contaminated_ids_stay(spark):
    leak, clean = "one two three four five six", "nothing of that kind here"
    docs = spark.createDataFrame([(None, leak), (None, clean), (None, clean), (7, f"x {leak} y"), (7, "short"), (8, None)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(None, clean), (None, clean), (7, "short"), (8, None)], key=repr)


def test_one_row_of_each_group_stays(spark):
    a, b, c = ("a b c d e f g h", "k l m n o p q r", "s t u v w x y z")
    docs = spark.createDataFrame([(1, a), (1, a), (2, a), (None, b), (None, b), (None, c), (1, c), (3, "p q")], "doc_id long, text string").repartition(3)
    kept = near.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, a), (None, b), (1, c), (3, "p q")], key=repr)


def test_a_large_benchmark_by_its_bitmap(spark):
    word = F.concat(F.lit("w"), F.pmod(F.xxhash64("id", "i"), F.lit(5000)))
    texts = spark.range(400).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(79)))).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", word.alias("w")))), lambda x: x["w"]), " ").alias("text"))
    texts = stored(texts, "texts")
    bench = texts.filter("id < 200").select(F.col("id").alias("item_id"), "text")
    leaks = texts.filter("id % 40 = 0").select("id", F.concat(F.lit("Before, "), "text", F.lit(" after")).alias("text"))
    docs = texts.filter("id >= 200").unionByName(leaks).unionByName(spark.createDataFrame([(None, None), (None, ""), (9, "two words")], "id long, text string")).withColumnRenamed("id", "doc_id")
    known = sorted(map(tuple, decontaminate.scan(docs, bench).collect()), key=repr)
    assert sorted(map(tuple, decontaminate.scan(docs, bench, max_set=0).collect()), key=repr) == known
    assert sum(len(r[2]) > 0 for r in known) == 5

    # The bitmap lets few windows of clean documents pass; what passes is the same for the hash as written and as probed.
    windows = decontaminate.item_windows(bench).select("hash", "window", F.col("n_words").alias("k")).distinct()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), decontaminate.words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    assert decontaminate._met_by_bitmap(stored(rows, "rows"), windows, [10]).count() == 5 * 71


def test_rows_of_one_opening_spread_over_blocks(spark):
    opening = "the same opening of every one of these texts, longer than any prefix " * 3
    docs = spark.range(60).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit(opening), *(F.concat(F.lit(" "), F.xxhash64("id", F.lit(i))) for i in range(40))).alias("text"))
    sizes = [r["count"] for r in phrases.deal(docs, blocks=20).groupBy("block").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 12
    got = phrases.remove_repeats(docs, block_bytes=2000).collect()
    assert {(r["n_words"], r["n_removed"]) for r in got} == {(79, 39)} and len(got) == 60
