"""Boosted trees are fitted on weighted cells of bins, not on rows."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.operators import models


def rows(spark, n):
    x = F.array((F.col("id") * 7919 % 1000 / 1000).alias("x"), (F.col("id") % 4).cast("double"), (F.col("id") % 100 == 3).cast("double"))
    noisy = (F.col("id") * 7919 % 1000 / 1000 + (F.col("id") % 4) / 4 + (F.col("id") * 31 % 17) / 34 + F.when(F.col("id") % 100 == 3, 2).otherwise(0)) > 1.2
    return spark.range(n).select(F.col("id").alias("application_id"), noisy.cast("int").alias("label"), array_to_vector(x).alias("features"))


def test_a_fit_passes_over_cells_whatever_the_rows(spark, monkeypatch):
    seen = []
    fit = models.GBTClassifier.fit
    monkeypatch.setattr(models.GBTClassifier, "fit", lambda self, data: seen.append((data.count(), data.agg(F.sum("rows")).first()[0])) or fit(self, data))
    for n in (4000, 40000):
        models.fit_trees(rows(spark, n), rounds=2)
    (few, small), (more, large) = seen
    assert (small, large) == (4000, 40000) and more <= 33 * 5 * 3 * 2 and more < 2 * few


def test_cells_score_like_rows(spark):
    data = rows(spark, 4000)
    binned = models.raw_scores(models.fit_trees(data, rounds=20, leaf=20), data)
    plain = models.raw_scores(models.GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, stepSize=0.05, maxDepth=3, minInstancesPerNode=20, seed=7).fit(data), data)
    brier = lambda scored: scored.agg(F.avg((F.col("raw_pd") - F.col("label")) ** 2), F.count("*")).first()
    (got, n), (expected, _) = brier(binned), brier(plain)
    assert n == 4000 and got < expected + 0.005


def test_rare_values_and_small_tables(spark):
    spread, columns = models.spread_out(rows(spark, 4000), 3)
    cuts = models.bin_cuts(spread, columns)
    assert cuts[1:] == [[0.0, 1.0, 2.0, 3.0], [0.0, 1.0]] and 25 <= len(cuts[0]) <= 31
    one = models.raw_scores(models.fit_trees(rows(spark, 30), rounds=2, leaf=20), rows(spark, 30)).select("raw_pd").distinct().collect()
    assert len(one) == 1 and one[0][0] == pytest.approx(0.5, abs=0.5)
