"""Tables of the stages' applications alone, features asked for once, and future observations by a join."""

from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.plans import jobs
from tidemark.plans import known_then as K
from tidemark.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_tables_of_some_applications(spark, tmp_path):
    for name in ("customer", "lineitem"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    # Some applications have a second row of another day.
    later = orders.filter("o_orderkey % 5 = 2").withColumn("o_orderdate", (F.col("o_orderdate").cast("date") + F.expr("interval 400 days")).cast(orders.schema["o_orderdate"].dataType))
    orders.unionByName(later).write.parquet(f"{tmp_path}/orders.parquet")
    t = Tables(spark, str(tmp_path))
    some = asof.in_stages(t.applications, t.stages)
    own = t.kept("applications").of(some)
    for name in ("feature_events", "performance"):
        assert _rows(getattr(own, name)) == _rows(getattr(t, name).join(some, "application_id", "left_semi")) != []


def test_cohorts_derive_tables_of_the_stages_alone(spark, monkeypatch):
    given = []
    monkeypatch.setattr(asof, "stage_cohorts", lambda *tables: given.extend(tables))
    t = Tables(spark, SF)
    K.cohorts(t)
    staged = asof.in_stages(t.applications, t.stages)
    for rows in given[:3]:
        assert not rows.isEmpty() and rows.join(staged, "application_id", "left_anti").isEmpty()


def test_a_monitor_asks_for_features_once(spark, monkeypatch):
    asked, plain = [], asof.asof_latest
    monkeypatch.setattr(asof, "asof_latest", lambda *a, **k: asked.append(1) or plain(*a, **k))
    t = Tables(spark, SF)
    current = jobs.monitored(t)[1]
    assert len(asked) == 1
    # Without a label, or with one, a row of the current cohort is scored.
    visible = asof.in_stages(t.applications, t.stages).filter((F.col("stage") == "test") & (F.col("decision_at") <= K.day()))
    wide = asof.feature_pivot(plain(visible, t.feature_events)).dropna()
    assert current.count() == wide.count() > 0


def test_future_observations_are_joined_or_merged(spark, monkeypatch):
    t = Tables(spark, SF)
    decisions = t.decisions.unionByName(t.decisions.limit(30)).unionByName(t.decisions.limit(3).withColumn("decision_at", F.lit(None).cast("date")))
    observed = t.observations.withColumn("published_at", F.when(F.hash("record_id") % 7 != 0, F.col("published_at")))
    found = []
    for few in (0, 1, 10**9):
        monkeypatch.setattr(asof, "FEW_DECISIONS", few)
        found.append(_rows(asof.future_observations(decisions, observed)))
    assert found[0] == found[1] == found[2] != []
    monkeypatch.setattr(asof, "_merged", None)
    asof.future_observations(decisions, observed)
