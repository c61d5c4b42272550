"""The bootstrap from pairs of months against replicates that are built row by row, and quality of scores of any order."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.sources import shared

MONTHS = ("2020-01", "2020-02", "2020-03", None)


def rows(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.choice([rng.random(), rng.randrange(5) / 4])
        out.append((rng.choice(["a", "b", None]), round(s, 9), int(rng.random() < 0.2 + 0.5 * s), MONTHS[i % 4]))
    return out + [("one class", 0.5, 1, "2020-01"), ("a", None, 1, "2020-01"), ("a", 0.5, None, "2020-01"), ("a", float("nan"), 0, "2020-01")]


SCHEMA = "method string, score double, label int, vintage string"


@pytest.mark.parametrize("ranges", ["1", "7"])
def test_replicates_against_weighted_rows(spark, ranges):
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = spark.createDataFrame(rows(), SCHEMA)
        draws = metrics.bootstrap_draws(data, 25, 3)
        got = metrics.block_bootstrap(data, draws, "score", "label", ("method",), precision=True)
        months = draws.withColumnRenamed("vintage", "month")
        weighted = data.join(months, data["vintage"].eqNullSafe(months["month"]))
        slow = metrics.quality(weighted, "score", "label", ("replicate", "method"), F.col("weight"))
        key = lambda r: (r["replicate"], str(r["method"]))
        expected = {key(r): r for r in slow.collect()}
        found = {key(r): r for r in got.collect()}
        assert set(found) == set(expected) and any(r["method"] is None for r in found.values())
        for k, r in found.items():
            for c in ("brier", "records", "events", "auc", "average_precision"):
                assert r[c] == pytest.approx(expected[k][c], abs=1.1e-8), (k, c)
        assert all(r["auc"] is None for r in found.values() if r["method"] == "one class")
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_stored_rows_do_not_grow_with_the_replicates(spark, monkeypatch):
    written = []

    def counted(df, name):
        out = shared.stored(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr("tidemark.operators.ranking.stored", counted)
    data = spark.createDataFrame([("a", i / 997, i % 3 // 2, MONTHS[i % 3]) for i in range(900)], SCHEMA)
    for replicates in (5, 200):
        metrics.block_bootstrap(data, metrics.bootstrap_draws(data, replicates, 1), "score", "label", ("method",)).collect()
    assert written == [900, 900]


@pytest.mark.parametrize(("kind", "scores"), [("int", [-700, 0, 100, 100, 850]), ("double", [-1e300, 0.0, 0.5, 1.5, 1e300]), ("string", ["A", "B", "B-", "C", "D"]), ("decimal(30,2)", [-10**20, 0, 1, 2, 10**20])])
def test_quality_of_any_ordered_score(spark, kind, scores):
    from decimal import Decimal

    data = [(Decimal(s) if kind.startswith("dec") else s, i % 2) for i, s in enumerate(scores * 3)]
    r = metrics.quality(spark.createDataFrame(data, f"score {kind}, label int"), "score", "label").first()
    events, others = [s for s, y in data if y], [s for s, y in data if not y]
    area = sum((a > b) + (a == b) / 2 for a in events for b in others) / len(events) / len(others)
    assert r["auc"] == pytest.approx(area, abs=1e-8) and r["brier"] is None and r["average_precision"] is not None


def test_brier_only_for_probabilities(spark):
    data = spark.createDataFrame([("p", "0.25", 1), ("p", "1", 0), ("q", "0.5", 1), ("q", "1.5", 0)], "method string, score string, label int")
    got = {r["method"]: r["brier"] for r in metrics.quality(data, "score", "label", ("method",)).collect()}
    assert got == {"p": pytest.approx((0.75**2 + 1) / 2), "q": None}
