"""Joined and merged entities, and both forms of the derived tables, give the same rows."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.plans import fixtures
from tidemark.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def mixed(monkeypatch):
    """Entities with more than one decision or eight records are crowded, others are not."""
    monkeypatch.setattr(asof, "FEW_DECISIONS", 1)
    monkeypatch.setattr(asof, "FEW_RECORDS", 8)
    monkeypatch.setattr(asof, "BUCKETS", 64)


def test_merged_and_joined_are_one(spark, mixed, monkeypatch):
    t = Tables(spark, SF)
    decisions = t.decisions.select("application_id", "decision_at", "k").filter("k % 5 < 3").drop("k")
    decisions = decisions.unionByName(decisions.limit(20)).unionByName(spark.sql("select cast(null as string) as application_id, date'1997-01-01' as decision_at"))
    jobs = (
        lambda: asof.asof_latest(decisions, t.feature_events),
        lambda: asof.compare_naive(decisions, t.feature_events),
        lambda: asof.bitemporal(decisions, t.observations, t.features),
    )
    both = [_rows(job()) for job in jobs]
    for few, many in ((0, 0), (10**9, 10**9)):
        monkeypatch.setattr(asof, "FEW_DECISIONS", few)
        monkeypatch.setattr(asof, "FEW_RECORDS", many)
        assert [_rows(job()) for job in jobs] == both
    assert all(both)


def test_a_join_has_one_shuffle_a_side(spark):
    """What follows the as-of join by entity moves nothing again; the merge had four orders and a stored table of all rows."""
    t = Tables(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = asof.asof_latest(t.applications, t.feature_events)._jdf.queryExecution().executedPlan().toString()
        perf = asof.latest_reports(t.applications.select("application_id", "decision_at"), t.performance, F.lit("1998-10-01").cast("date"))._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Window") == 0 and plan.count("rangepartitioning") == 0
    assert perf.count("/orders.parquet") == 2


@pytest.mark.parametrize("name", sorted(fixtures.PLANNED))
def test_planned_tables_hold_what_the_sql_says(spark, tmp_path, name):
    for n in fixtures.GIVEN:
        rows = spark.read.parquet(f"{SF}/{n}.parquet")
        if n == "lineitem":
            rows = rows.unionByName(rows.filter("l_orderkey % 6 = 0").withColumn("l_discount", F.col("l_discount") + 0.01))
        if n == "orders":
            rows = rows.unionByName(rows.filter("o_orderkey % 7 = 0")).unionByName(rows.filter("o_orderkey % 9 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1))
        rows.write.parquet(f"{tmp_path}/{n}.parquet")
    plain, planned = fixtures.frame(spark, str(tmp_path), name, fixtures.TABLES), fixtures.frame(spark, str(tmp_path), name)
    assert plain.dtypes == planned.dtypes
    assert plain.exceptAll(planned).isEmpty() and planned.exceptAll(plain).isEmpty()
