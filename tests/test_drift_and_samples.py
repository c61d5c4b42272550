"""Drift with null groups and unknown values, bottom-k samples, and gates, against plain Python."""

import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contracts, diagnosis, drift, ranking

SCHEMA = "g string, v double"


def plain_ks(old, new):
    """Greatest gap and the least value that has it."""
    best = max(((abs(Fraction(sum(x <= v for x in old), len(old)) - Fraction(sum(x <= v for x in new), len(new))), -v) for v in {*old, *new}), default=None)
    return (float(best[0]), -best[1])


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_ks_by_group_against_plain_python(spark, seed, coalesced):
    rng = random.Random(seed)
    value = lambda: rng.choice([rng.randrange(6) / 2, rng.randrange(6) / 2, rng.random() * 3, None, float("nan"), float("inf")])
    old = [(None, value()) for _ in range(rng.choice([60, 200]))]
    new = [(rng.choice(["a", "b", None, "few"] if i % 9 else ["few"]), value()) for i in range(240)] + [("unknown", None)] * 30
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        got = {r["g"]: r for r in drift.ks_distance(spark.createDataFrame(old, SCHEMA).repartition(3), spark.createDataFrame(new, SCHEMA).repartition(5), "v", ("g",)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    finite = lambda rows: [v for v in rows if v is not None and v == v and v != float("inf")]
    assert set(got) == {g for g, _ in new}
    base = finite(v for _, v in old)
    for g, r in got.items():
        own = finite(v for k, v in new if k == g)
        assert r["current_missing"] == sum(k == g for k, _ in new) - len(own) and r["reference_missing"] == len(old) - len(base)
        if len(own) < drift.MINIMUM_ROWS:
            assert r["distance"] is None and r["status"] == "insufficient_sample"
            continue
        gap, at = plain_ks(base, own)
        assert (r["distance"], r["at_value"]) == (pytest.approx(gap, abs=6e-7), at)


def test_rows_laid_for_drift_do_not_grow_with_groups(spark, monkeypatch):
    laid, own = [], ranking.stored

    def counted(df, name):
        out = own(df, name)
        laid.append(out.count())
        return out

    monkeypatch.setattr(ranking, "stored", counted)
    old = spark.range(2000).select(F.lit("x").alias("g"), F.col("id").cast("double").alias("v"))
    totals = []
    for groups in (2, 50):
        new = spark.range(1000).select((F.col("id") % groups).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
        laid.clear()
        drift.ks_distance(old, new, "v", ("g",)).collect()
        totals.append(sum(laid))
    assert totals[0] == totals[1] == 2000 + 3 * 1000


def test_psi_and_shares_keep_null_groups(spark):
    old = spark.createDataFrame([("r", i / 40) for i in range(40)], SCHEMA)
    new = spark.createDataFrame([(g, i / 40 + 0.3) for g in ("a", None) for i in range(30)] + [(None, None)] * 9, SCHEMA)
    got = {r["g"]: (r["rows"], r["psi"]) for r in drift.psi(old, new, "v", ("g",)).collect()}
    assert set(got) == {"a", None} and got["a"] == got[None] and got["a"][0] == 30 and got["a"][1] > 0
    kinds = new.withColumn("kind", F.when(F.col("v") > 0.5, "high").otherwise("low"))
    shares = drift.total_variation(old.withColumn("kind", F.lit("low")), kinds.filter("v is not null"), "kind", ("low", "high"), ("g",)).collect()
    assert len(shares) == 2 and len({r["distance"] for r in shares}) == 1


@pytest.mark.parametrize("digits", [1, 4])
def test_samples_have_the_lowest_hashes(spark, digits):
    rows = [(("a", "b", None)[i % 3], f"k{i}") for i in range(900)] + [("c", "only"), ("a", None)]
    data = spark.createDataFrame(rows, "g string, k string").repartition(4)
    place = lambda k: hashlib.sha256(f"s:{k or ''}".encode()).hexdigest()
    wanted = lambda g, n: sorted((k for h, k in rows if h == g), key=place)[:n]
    for n, sizes in ((25, dict.fromkeys(["a", "b", "c", None], 25)), ({"a": 7, "c": 5}, {"a": 7, "b": 0, "c": 5, None: 0})):
        got = ranking.hash_sample(data, "g", F.col("k"), n, "s", digits).collect()
        for g, size in sizes.items():
            assert sorted((r["k"] for r in got if r["g"] == g), key=place) == wanted(g, size)


def test_a_sample_is_cut_before_it_is_ranked(spark):
    data = spark.range(40_000).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("k"))
    hashed = data.withColumn("h", F.sha2(F.concat(F.lit("s:"), "k"), 256))
    got = ranking.hash_sample(data, "g", F.col("k"), 20_000, "s")
    assert got.count() == 20_000 and got.agg(F.max("sample_hash")).first()[0] == hashed.orderBy("h").limit(20_000).agg(F.max("h")).first()[0]
    ranked = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number" in line]
    assert ranked and "Join" in got._jdf.queryExecution().optimizedPlan().toString()


def test_gates_follow_what_blocks_them(spark):
    found = lambda *checks: spark.createDataFrame([("t", c, "l", "x") for c in checks], "table string, check string, locator string, code string")
    status = lambda *checks: {r["check"]: r["status"] for r in contracts.gate_status(found(*checks), diagnosis.GRAPH).collect()}
    assert status() == dict.fromkeys(diagnosis.GRAPH, "passed")
    assert status("configuration") == {"configuration": "failed", "rows": "passed", "relationships": "passed", "cohorts": "blocked"}
    assert status("rows", "rows") == {"configuration": "passed", "rows": "failed", "relationships": "blocked", "cohorts": "blocked"}
    assert status("cohorts")["cohorts"] == "failed"
    report = diagnosis.diagnose(found(*["rows"] * 7), 3).collect()
    assert sum(r["section"] == "finding" for r in report) == 3
    assert [(r["findings"], r["truncated"], r["status"]) for r in report if r["section"] == "total"] == [(7, True, "invalid_inputs")]
    assert [r["status"] for r in diagnosis.diagnose(found(), 3).collect() if r["section"] == "total"] == ["ready_for_evaluation"]


def test_every_rule_is_found_once(spark):
    D = "2024-01-{:02d}".format
    apps = [("A", D(5), "100", "retail"), ("A", D(5), "100", "retail"), ("B", D(6), "100", "retail"), ("bad id", D(5), "0", "x"), ("C", "2024-02-30", "1", "retail")]
    feats = [("A", "utilization", "0.5", D(1), D(2)), ("A", "utilization", "0.6", D(1), D(2)), ("Z", "utilization", "0.5", D(1), D(2)), ("B", "income", "1", D(1), D(2)), ("B", "debt_to_income", "2", D(1), D(2)), ("B", "utilization", "0.1", D(3), D(2))]
    perf = [("A", D(4), D(8), "0"), ("A", D(9), D(9), "0"), ("A", D(9), D(9), "30"), ("Z", D(9), D(9), "0"), ("B", D(9), D(8), "0"), ("B", D(9), D(9), "366")]
    text = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    stages = spark.sql("SELECT 'train' AS stage, DATE '2024-01-01' AS start_at, DATE '2024-01-31' AS end_at, DATE '2024-12-31' AS cutoff UNION ALL SELECT 'back', DATE '2024-09-02', DATE '2024-09-01', DATE '2025-01-01' UNION ALL SELECT 'empty', DATE '2025-01-01', DATE '2025-01-31', DATE '2025-12-31'")
    ledger = diagnosis.findings(text(apps, "application_id decision_at principal_cents segment"), text(feats, "application_id name value observed_at available_at"), text(perf, "application_id as_of available_at days_past_due"), stages)
    got = {(r["table"], r["check"], r["code"]) for r in ledger.collect()}
    assert got == {
        ("stages", "configuration", "invalid_window"), ("stages", "cohorts", "cohort_contract"),
        ("applications", "rows", "invalid_id"), ("applications", "rows", "invalid_principal"), ("applications", "rows", "invalid_segment"), ("applications", "rows", "invalid_date"),
        ("features", "rows", "unknown_feature"), ("features", "rows", "out_of_range"), ("features", "rows", "available_before_observed"),
        ("performance", "rows", "available_before_report"), ("performance", "rows", "invalid_days_past_due"),
        ("applications", "relationships", "duplicate_application"), ("features", "relationships", "ambiguous_feature_revision"), ("features", "relationships", "orphan"), ("features", "relationships", "missing_decision_feature"),
        ("performance", "relationships", "duplicate_report_revision"), ("performance", "relationships", "orphan"), ("performance", "relationships", "report_not_after_decision"),
        ("applications", "cohorts", "missing_performance"),
    }
