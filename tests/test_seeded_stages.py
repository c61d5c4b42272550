"""Stages of several seeds without an order of the rows, and tables that a step leaves behind."""

import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, study
from tidemark.plans import studies
from tidemark.plans.registry import Tables
from tidemark.sources import shared


def left_behind(spark):
    top = urlparse(shared._own_folder(spark)).path
    return {name for name in (os.listdir(top) if os.path.isdir(top) else [])}


@pytest.mark.parametrize("bits", [1, 12, 20])
def test_stages_are_those_of_the_order(spark, bits):
    rows = spark.range(4003).select(F.concat(F.lit("A"), F.col("id").cast("string")).alias("k"), F.when(F.col("id") % 500 == 7, None).when(F.col("id") % 9 == 0, 1).otherwise(0).alias("y")).repartition(5)
    some = rows.unionByName(spark.createDataFrame([("only", 5)], "k string, y int"))
    found = features.seeded_stages(some, "y", "k", (7, 41), bits=bits)
    assert found.columns == ["k", "y", "stage_7", "stage_41"]
    for seed in (7, 41):
        want = features.stratified_split(some, "y", "k", seed).select("k", "y", "stage")
        assert sorted(map(tuple, found.select("k", "y", f"stage_{seed}").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_rows_are_not_moved_to_be_staged(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).alias("y"))
    plan = features.seeded_stages(rows, "y", "k", (7, 41))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def test_a_step_deletes_what_it_stored(spark):
    before = left_behind(spark)
    with shared.step(spark):
        gone, kept = shared.stored(spark.range(3), "gone"), shared.stored(spark.range(4), "kept", outlive=True)
        assert gone.count() == 3
    assert kept.count() == 4
    assert {n.split("-")[0] for n in left_behind(spark) - before} == {"kept"}


def test_a_seed_leaves_its_results_only(spark, monkeypatch):
    t = Tables(spark, "/root/testdata/sf0.001")
    own = study.fitted
    monkeypatch.setattr(study, "fitted", lambda *args, **kwargs: own(*args[:5], False, *args[6:], **kwargs))  # no trees, to be quick
    before = left_behind(spark)
    base = studies.labelled_risk(t, (7, 23))
    assert {n.split("-")[0] for n in left_behind(spark) - before} == {"split"}
    found = studies.split_results(t, base, 7)
    assert found.count() == 3 * 3
    assert sorted(n.split("-")[0] for n in left_behind(spark) - before) == ["results", "split"]
