"""Bootstraps over no rows, and the rows that a capture bootstrap lays."""

from pyspark.sql import functions as F

from tidemark.operators import metrics


def test_nothing_is_drawn_without_months(spark):
    none = spark.createDataFrame([], "method string, vintage string, score decimal(12,10), label int")
    draws = metrics.bootstrap_draws(none, 5, 7)
    assert draws.count() == 0
    replicates = metrics.block_bootstrap(none, draws, "score", "label", ("method",))
    assert metrics.quantile_interval(metrics.paired_metric(replicates, "brier", "constant"), "difference", ("method",)).count() == 0


def test_cells_do_not_grow_with_rows(spark, monkeypatch):
    rows = spark.range(4000).select(F.lit("a").alias("method"), (F.col("id") + 1).alias("rank"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") * 7 % 5).cast("string").alias("vintage"))
    draws = metrics.bootstrap_draws(rows, 4, 7)
    capacities = spark.createDataFrame([(5,), (33,)], "percent int")
    expected = sorted(map(tuple, metrics.capture_bootstrap(rows, draws, capacities, per_cell=1, cells=4000).collect()))
    laid, running = [], metrics.running_counts

    def counted(values, *args, **named):
        laid.append(values.count())
        return running(values, *args, **named)

    monkeypatch.setattr(metrics, "running_counts", counted)
    got = sorted(map(tuple, metrics.capture_bootstrap(rows, draws, capacities, per_cell=1, cells=16).collect()))
    assert got == expected and len(got) == 8
    assert laid == [4 * 16]
