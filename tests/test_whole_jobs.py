"""Composed jobs run as many rounds and repeats as the reference."""

import pytest

from tidemark.operators import metrics, models, study
from tidemark.plans import scores as S
from tidemark.plans.catalog import QUERIES
from tidemark.plans.registry import Tables

SF = "/root/testdata/sf0.001"


def test_boosted_trees_of_a_hundred_rounds(spark, monkeypatch):
    class Enough(Exception):
        pass

    class Trees:
        def __init__(self, maxIter, **_):
            raise Enough(maxIter)

    monkeypatch.setattr(models, "GBTClassifier", Trees)
    with pytest.raises(Enough, match="^100$"):
        QUERIES["l06_fit_boosted_trees"](spark, SF)


def test_five_seeds_and_their_summary(spark):
    rows = QUERIES["e11_repeated_split_study"](spark, SF).collect()
    runs, summary = [r for r in rows if r["seed"] is not None], {(r["method"], r["percent"]): r for r in rows if r["seed"] is None}
    assert sorted({r["seed"] for r in runs}) == [7, 23, 41, 59, 83]
    assert len(runs) == 5 * len(summary) and len(summary) == 3 * 4
    for key, whole in summary.items():
        own = [r for r in runs if (r["method"], r["percent"]) == key]
        for c in ("auc", "average_precision", "brier", "captured", "capture"):
            values = [r[c] for r in own]
            assert whole[f"mean_{c}"] == pytest.approx(sum(values) / 5, abs=1e-8)
            assert (whole[f"min_{c}"], whole[f"max_{c}"]) == (min(values), max(values))
    for r in runs:
        assert r["reviewed"] == -(-r["records"] * r["percent"] // 100) and r["events"] == r["total_events"]


@pytest.mark.parametrize("name", ["l04_fit_isotonic", "l20_frozen_stages", "l21_fit_audit", "d09_monitor_scores", "e01_evaluate", "e14_lineage_job"])
def test_fitted_jobs_run(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows


def test_isotonic_against_pooling(spark):
    rows = [r.asDict() for r in QUERIES["l04_fit_isotonic"](spark, SF).collect()]
    by_raw = sorted((r["raw_pd"], r["calibrated_pd"]) for r in rows)
    assert all(a[1] <= b[1] for a, b in zip(by_raw, by_raw[1:], strict=False))  # no score falls as the raw one rises

    data = [(0.1, 0), (0.2, 1), (0.3, 0), (0.3, 1), (0.5, 0), (0.7, 1), (0.8, 1)]
    model = models.fit_isotonic(spark.createDataFrame(data, "raw_pd double, label int"))
    blocks = []
    for x in sorted({x for x, _ in data}):
        ys = [y for v, y in data if v == x]
        blocks.append([sum(ys), len(ys), [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    expected = {x: s / n for s, n, xs in blocks for x in xs}
    got = {r["raw_pd"]: r["calibrated_pd"] for r in models.calibrated(model, spark.createDataFrame([(x,) for x in expected], "raw_pd double")).collect()}
    assert got == pytest.approx(expected, abs=1e-9)


def same_rows(spark, got, section, name):
    """A section's rows are the rows of the query ``name``, whose SQL test_oracle holds."""
    wanted = QUERIES[name](spark, SF)
    part = got.filter(f"section = '{section}'").select(*wanted.columns)
    assert wanted.count() > 0
    assert part.exceptAll(wanted).count() == wanted.exceptAll(part).count() == 0


def test_evaluation_sections_are_the_single_queries(spark):
    t = Tables(spark, SF)
    got = study.evaluate(t.predictions, 10, 5, 7)
    for section, name in (("queue", "m05_precision_capture_at_k"), ("portfolio", "a03_portfolio_aggregate"), ("vintage", "a04_vintage_metrics"), ("decile", "a05_risk_deciles")):
        same_rows(spark, got, section, name)
    quality = {r["method"]: r for r in got.filter("section = 'quality'").collect()}
    assert all(r["low"] <= r["auc"] <= r["high"] and r["valid"] == 5 for r in quality.values()) and set(quality) == {"logistic", "isotonic"}


def test_comparison_is_policies_beside_paired_intervals(spark):
    t = Tables(spark, SF)
    got = study.compare(t.scores, t.outcomes, t.capacities, 20, S.SEED, "rule").withColumn("section", study.F.lit("x"))
    same_rows(spark, got, "x", "a10_capacity_policy_table")
    ranked = QUERIES["w01_priority_rank"](spark, SF).join(t.outcomes.select("application_id", "label", "vintage"), "application_id")
    pairs = metrics.paired_difference(metrics.capture_bootstrap(ranked, metrics.bootstrap_draws(t.outcomes, 20, S.SEED), t.capacities), "rule").collect()
    whole = [r for r in got.collect() if r["group_type"] == "portfolio"]
    assert sorted({r["method"] for r in whole if r["low"] is not None}) == ["alt", "constant"]
    for r in whole:
        values = [p["difference"] for p in pairs if (p["method"], p["percent"]) == (r["method"], r["percent"])]
        assert r["valid"] == (len(values) or None)
        assert not values or min(values) <= r["low"] <= r["high"] <= max(values)
    assert all(r["low"] is None for r in got.collect() if r["group_type"] != "portfolio")


def test_score_drift_sections_are_the_single_queries(spark):
    old, new = S.sides(Tables(spark, SF))
    got = study.score_drift(old, new, "calibrated_pd")
    same_rows(spark, got, "bin", "d03_psi")
    same_rows(spark, got.filter("vintage is null or vintage <> 'all'"), "psi", "d04_psi_by_vintage")
    whole, = got.filter("vintage = 'all'").collect()
    parts = [r["psi_component"] for r in got.filter("section = 'bin'").collect()]
    assert whole["psi"] == pytest.approx(sum(parts), abs=1e-6) and whole["rows"] == new.filter("calibrated_pd is not null").count()


def test_a_constant_score_and_an_unseen_category(spark):
    rows = [(f"A{i}", i % 3 == 0, i / 10, "a" if i % 2 else "b") for i in range(40)]
    train = spark.createDataFrame([(a, int(y), x, k) for a, y, x, k in rows], "application_id string, label int, x double, kind string")
    test = spark.createDataFrame([("T1", 1, 1.0, "unseen"), ("T2", 0, 2.0, "a")], train.schema)
    got = {(r["method"], r["application_id"]): float(r["score"]) for r in study.fitted(train, train, test, ("x",), ("kind",), trees=False).collect()}
    assert len(got) == 6
    assert got["constant", "T1"] == got["constant", "T2"] == pytest.approx(14 / 40, abs=1e-10)
    assert all(0 <= v <= 1 for v in got.values())


@pytest.mark.parametrize("name", ["e09_same_budget_comparison", "e10_static_split_study", "e12_dated_loan_study"])
def test_studies_score_every_method_on_the_same_rows(spark, name):
    rows = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
    rows = [r for r in rows if r.get("percent") is not None and r.get("group_type") in (None, "portfolio")]
    methods = {r["method"] for r in rows}
    assert methods >= {"constant", "logistic", "isotonic", "boosted_trees"} and len(rows) == 3 * len(methods)
    assert len({(r["percent"], r["reviewed"]) for r in rows}) == 3  # one budget size for every method


def test_contributions_rebuild_the_score(spark):
    rows = [r.asDict() for r in QUERIES["e09_same_budget_comparison"](spark, SF).filter("section <> 'policy'").collect()]
    parts = [r for r in rows if r["section"] == "explanation"]
    whole, = (r for r in rows if r["section"] == "rebuild")
    ids = {r["application_id"] for r in parts}
    assert len(parts) == 5 * len(ids) and whole["applications"] == len(ids) > 0 and whole["greatest_gap"] <= 1e-7
    for i in list(ids)[:20]:
        own = sorted((r["reason_rank"], -r["contribution"]) for r in parts if r["application_id"] == i)
        assert [k for k, _ in own] == [1, 2, 3, 4, 5] and [c for _, c in own] == sorted(c for _, c in own)
