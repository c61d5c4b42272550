"""Hand-calculated cases: boundary days, ties, exact thresholds, state machines, order and leakage invariance."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, coverage, drift, features, journal, loans, metrics, models, ranking, reconcile, rollup
from tidemark.sources import tables
from tidemark.streaming.review import decide, stream_review

D = dt.date
APPS = "application_id string, decision_at date, principal_cents long, segment string"
EVENTS = "application_id string, name string, value double, observed_at date, available_at date"
REPORTS = "application_id string, as_of date, available_at date, days_past_due int"


def day(x):
    return F.lit(x).cast("date")


@pytest.fixture
def one_loan(spark):
    start = D(2024, 1, 1)
    apps = spark.createDataFrame([("A", start, 100, "retail")], APPS)
    reports = [("A", start + dt.timedelta(n), start + dt.timedelta(n + 2), 0) for n in range(30, 181, 30)]
    return start, apps, reports


def status(spark, apps, reports, cutoff):
    row = asof.mature_outcomes(apps, spark.createDataFrame(reports, REPORTS), day(cutoff)).first()
    return row["status"], row["label"]


def test_maturity_days(spark, one_loan):
    start, apps, reports = one_loan
    assert status(spark, apps, reports, start + dt.timedelta(181)) == ("not_mature", None)
    assert status(spark, apps, reports, start + dt.timedelta(182)) == ("observed_nondefault", 0)
    assert status(spark, apps, reports[:-1], start + dt.timedelta(182)) == ("missing_performance", None)


def test_revisions_and_known_defaults(spark, one_loan):
    start, apps, reports = one_loan
    late = (("A"), start + dt.timedelta(90), start + dt.timedelta(300), 90)
    assert status(spark, apps, [*reports, late], start + dt.timedelta(182)) == ("observed_nondefault", 0)
    assert status(spark, apps, [*reports, late], start + dt.timedelta(300)) == ("default", 1)
    known = ("A", start + dt.timedelta(60), start + dt.timedelta(62), 95)
    assert status(spark, apps, [known], start + dt.timedelta(182)) == ("default", 1)


def test_future_rows_change_nothing(spark):
    apps = spark.createDataFrame([("A", D(2024, 3, 1), 1, "retail"), ("B", D(2024, 3, 2), 1, "retail")], APPS)
    events = [("A", "utilization", 0.2, D(2024, 2, 1), D(2024, 2, 2)), ("A", "utilization", 0.4, D(2024, 2, 1), D(2024, 3, 1)), ("B", "utilization", 0.5, D(2024, 3, 2), D(2024, 3, 2))]
    before = sorted(asof.asof_latest(apps, spark.createDataFrame(events, EVENTS)).collect())
    assert [(r["application_id"], r["value"]) for r in before] == [("A", 0.4), ("B", 0.5)]
    later = [*events, ("A", "utilization", 0.9, D(2024, 2, 1), D(2024, 3, 2)), ("B", "utilization", 0.9, D(2024, 3, 3), D(2024, 3, 1))]
    random.Random(1).shuffle(later)
    assert sorted(asof.asof_latest(apps, spark.createDataFrame(later, EVENTS).repartition(5)).collect()) == before


def test_each_decision_of_an_entity_knows_its_own_past(spark):
    rng = random.Random(5)
    ids = ["hot", "hot", "hot", "cold", None]
    when = lambda: D(2024, 1, 1) + dt.timedelta(days=rng.randrange(60))
    decisions = [(rng.choice(ids), when()) for _ in range(60)]
    events = [(rng.choice(ids), rng.choice(["x", "y", None]), float(i), when(), when()) for i in range(120)]
    frame = spark.createDataFrame(decisions, "application_id string, decision_at date")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, asof.asof_latest(frame, spark.createDataFrame(events, EVENTS).repartition(3)).select("application_id", "decision_at", "name", "value").collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = []
    for a, at in {d for d in decisions if d[0]}:
        for n in {e[1] for e in events}:
            known = [(e[4], e[3], e[2]) for e in events if e[0] == a and e[1] == n and e[3] <= at and e[4] <= at]
            expected += [(a, at, n, max(known)[2])] if known else []
    assert got == sorted(expected, key=repr) and len(got) > 60


def test_no_decision_sees_a_later_record(spark):
    T = lambda d: dt.datetime(2020, 1, d)
    records = [(f"r{d}", "e", "s", "f", T(d), T(d), T(d), 1, float(d), False) for d in (1, 10, 30)]
    observed = spark.createDataFrame(records, "record_id string, entity_id string, source string, feature string, event_at timestamp, published_at timestamp, ingested_at timestamp, revision int, value double, deleted boolean")
    decisions = spark.createDataFrame([("e", D(2020, 1, 1)), ("e", D(2020, 1, 12)), ("e", D(2020, 1, 30)), ("e", D(2019, 1, 1)), ("other", D(2020, 1, 1))], "application_id string, decision_at date")
    slots = asof.bitemporal(decisions, observed, spark.createDataFrame([("f",)], "name string"))
    assert {(r["application_id"], str(r["decision_at"])): (r["status"], r["record_id"]) for r in slots.collect()} == {
        ("e", "2020-01-01"): ("selected", "r1"), ("e", "2020-01-12"): ("selected", "r10"), ("e", "2020-01-30"): ("selected", "r30"), ("e", "2019-01-01"): ("no_history", None), ("other", "2020-01-01"): ("no_history", None),
    }
    counts = {str(r["decision_at"]): (r["observations"], r["future"]) for r in asof.future_observations(decisions, observed).collect()}
    assert counts == {"2020-01-01": (3, 2), "2020-01-12": (3, 1), "2020-01-30": (3, 0), "2019-01-01": (3, 3)}


def test_a_hot_entity_fills_many_tasks(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), (F.col("id") * 7919 % 5000).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranking.carried(rows.repartition(4), ("k",), ("t",), best=("max", "v"), all=("sum", "v"), last=("max_before", "t")).orderBy("t").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    best, total = -1, 0
    for i, r in enumerate(out):
        best, total = max(best, r["v"]), total + r["v"]
        assert (r["best"], r["all"], r["last"]) == (best, total, i - 1 if i else None)


def test_strict_snapshot_refuses_a_missing_feature(spark):
    apps = spark.createDataFrame([("a", D(2024, 1, 5)), ("b", D(2024, 1, 5))], "application_id string, decision_at date")
    events = spark.createDataFrame([("a", "x", 1.0, D(2024, 1, 1), D(2024, 1, 1)), ("b", "x", 1.0, D(2024, 1, 1), D(2024, 1, 9))], EVENTS)
    reports = spark.createDataFrame([], REPORTS)
    loose = asof.snapshot(apps, events, reports, day("2024-02-01"), names=("x",)).collect()
    assert {r["application_id"]: r["x"] for r in loose} == {"a": 1.0, "b": None}
    assert asof.snapshot(apps.filter("application_id = 'a'"), events, reports, day("2024-02-01"), strict=True, names=("x",)).count() == 1
    with pytest.raises(Exception, match="feature not known at the decision: b/2024-01-05/x"):
        asof.snapshot(apps, events, reports, day("2024-02-01"), strict=True, names=("x",)).collect()


def test_slot_statuses(spark):
    at = D(2024, 5, 10)
    slots = spark.createDataFrame([("current", x, at) for x in "abcde"], "population string, application_id string, decision_at date").crossJoin(spark.createDataFrame([("utilization",)], "name string"))
    events = [("a", "utilization", 0.1, D(2024, 5, 5), D(2024, 5, 9)), ("b", "utilization", 0.2, D(2024, 5, 5), D(2024, 5, 12)), ("c", "utilization", 0.3, D(2024, 5, 11), D(2024, 5, 12)), ("d", "utilization", 0.4, D(2024, 5, 5), D(2024, 7, 1))]
    out = coverage.slot_status(slots, spark.createDataFrame(events, EVENTS), day("2024-06-01"))
    got = {r["application_id"]: (r["status"], r["observation_age_days"], r["availability_lag_days"], r["late_days"]) for r in out.collect()}
    assert got == {"a": ("available", 5, 4, None), "b": ("late_for_decision", None, 7, 2), "c": ("observed_after_decision", None, 1, None), "d": ("no_visible_event", None, None, None), "e": ("no_visible_event", None, None, None)}
    row = coverage.coverage_rollup(out).filter("vintage = 'all'").first()
    assert (row["applications"], row["available"], row["coverage_rate"], row["max_late_days"]) == (5, 1, 0.2, 2)


def test_policy_thresholds_are_exact(spark):
    cover = spark.createDataFrame([("t", "all", "x", 3, 2), ("t", "all", "y", 80, 78)], "population string, vintage string, feature string, applications long, available long")
    rules = [(1, "a", "t", "all", "x", 1, "0.66666667"), (2, "b", "t", "all", "x", 1, "0.66666666"), (3, "c", "t", "all", "y", 1, "0.975"), (4, "d", "t", "all", "y", 1, "0.975000000000000001"), (5, "e", "t", "all", "y", 81, "0"), (6, "f", "t", "all", "z", 1, "1")]
    checks = coverage.policy_check(spark.createDataFrame(rules, "ordinal int, id string, population string, vintage string, feature string, min_applications long, min_coverage string"), cover)
    assert [r["result"] for r in checks.orderBy("ordinal").collect()] == ["fail", "pass", "pass", "fail", "insufficient", "insufficient"]
    assert coverage.policy_verdict(checks).first()["verdict"] == "fail"


FOUR = [("A", "2024-01", "retail", 10000, 1, "0.8", 1), ("B", "2024-01", "small_business", 90000, 1, "0.2", 0), ("C", "2024-02", "retail", 40000, 1, "0.6", 0), ("D", "2024-02", "small_business", 60000, 0, "0.6", 1)]


def test_rollup_of_four_rows(spark):
    rows = spark.createDataFrame(FOUR, "application_id string, vintage string, segment string, principal_cents long, label int, pd string, review_selected int").withColumn("calibrated_pd", F.col("pd").cast("decimal(12,10)"))
    out = {(r["scope"], r["vintage"], r["segment"]): r for r in rollup.cohort_rollup(rows).collect()}
    total = out["portfolio", "all", "all"]
    assert (total["event_rate"], total["mean_pd"], total["exposure_weighted_pd"], total["review_precision"], total["event_capture"]) == (0.75, 0.55, 0.43, 0.5, 0.33333333)
    assert (total["scenario_expected_loss_usd"], total["scenario_event_loss_proxy_usd"]) == (387.0, 630.0)
    second = out["vintage", "2024-02", "all"]
    assert (second["previous_event_rate"], second["event_rate_change"]) == (1.0, -0.5)
    assert len(out) == 9


@pytest.mark.parametrize("n", [1, 7, 23, 400])
def test_global_rank_is_row_number(spark, n):
    rng = random.Random(n)
    rows = [(f"id{rng.randrange(10**6):07d}{i}", rng.choice([0.0, 0.5, 0.5, 0.5001, 1.0, rng.random()])) for i in range(n)]
    for data in (rows, [(i, 0.2) for i, _ in rows]):
        got = {r["id"]: r["rank"] for r in ranking.global_rank(spark.createDataFrame(data, "id string, score double").repartition(3), "score", "id").collect()}
        assert got == {i: k for k, (i, _) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])), 1)}


def test_null_scores_and_groups_are_ranked(spark):
    data = [("a", 0.1, "g"), ("b", None, "g"), ("c", 0.9, None), ("d", None, None), ("e", float("nan"), "g"), ("f", 0.9, "g"), ("g", 7.5, None)]
    ranked = ranking.global_rank(spark.createDataFrame(data, "id string, at double, part string").withColumnRenamed("at", "score").withColumn("at", F.lit(1)).repartition(3), "score", "id", ("part",))
    assert ranked.columns == ["id", "score", "part", "at", "rank"]
    assert {r["id"]: r["rank"] for r in ranked.collect()} == {"f": 1, "a": 2, "b": 3, "e": 4, "g": 1, "c": 2, "d": 3}
    chosen = ranking.select_capacity(spark.createDataFrame(data, "id string, score double, g string"), 50, "score", "id", ("g",))
    assert sorted(r["id"] for r in chosen.collect()) == ["a", "c", "f", "g"]


def test_running_counts_of_null_groups_and_values(spark):
    data = [(None, 1.0, 2), (None, None, 3), ("g", 5.0, 1), ("g", 1e300, 1), ("g", None, 4)]
    got = ranking.running_counts(spark.createDataFrame(data, "g string, v double, n int"), "v", ("n",), ("g",), totals=True).collect()
    assert sorted(((r["g"], r["v"], r["cum_n"], r["all_n"]) for r in got), key=repr) == sorted([(None, 1.0, 2, 5), (None, None, 5, 5), ("g", 5.0, 1, 6), ("g", 1e300, 2, 6), ("g", None, 6, 6)], key=repr)


def test_quality_keeps_null_groups(spark):
    data = [(None, 0.2, 0), (None, 0.7, 1), ("g", 0.3, 1), ("g", None, 0), ("g", float("nan"), 1), ("g", 0.1, None)]
    got = {r["g"]: (r["records"], r["auc"]) for r in metrics.quality(spark.createDataFrame(data, "g string, score double, label int"), "score", "label", ("g",)).collect()}
    assert got == {None: (2, 1.0), "g": (1, None)}


@pytest.mark.parametrize("n", [1, 2, 5, 240])
def test_quantiles_are_interpolated(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.5, round(rng.random(), 2)]) for _ in range(n)]
    got = ranking.quantiles(spark.createDataFrame([(v,) for v in [*values, None]], "v double"), "v", (0.0, 0.1, 0.5, 0.9, 1.0)).first()
    assert got["n"] == n
    for f, q in zip((0.0, 0.1, 0.5, 0.9, 1.0), got["q"], strict=True):
        place = f * (n - 1)
        low, high = sorted(values)[math.floor(place)], sorted(values)[math.ceil(place)]
        assert q == pytest.approx(low + (high - low) * (place - math.floor(place)), abs=1e-12)


def test_budgets_round_up(spark):
    rows = spark.createDataFrame([("m", f"{i:02d}", i / 20, int(i in (0, 2, 20))) for i in range(21)], "method string, application_id string, score double, label int")
    chosen = ranking.multi_budget(rows, spark.createDataFrame([(5,), (10,), (20,)], "percent int"), "score", "application_id")
    got = {r["percent"]: (r["n"], r["hits"]) for r in chosen.groupBy("percent").agg(F.count("*").alias("n"), F.sum("label").alias("hits")).collect()}
    assert got == {5: (2, 1), 10: (3, 1), 20: (5, 1)}


def plain_auc(rows):
    pairs = [(1.0 if p > q else 0.5 if p == q else 0.0) for (p, a), (q, b) in itertools.product(rows, rows) if a == 1 and b == 0]
    return round(sum(pairs) / len(pairs), 8) if pairs else None


@pytest.mark.parametrize("seed", range(3))
def test_quality_with_ties(spark, seed):
    rng = random.Random(seed)
    rows = [(round(rng.random(), rng.choice([1, 3])), int(rng.random() < 0.3)) for _ in range(200)]
    out = metrics.quality(spark.createDataFrame(rows, "score double, label int").withColumn("score", F.col("score").cast("decimal(12,10)")), "score", "label").first()
    assert out["auc"] == plain_auc(rows)
    found = whole = 0.0
    for s in sorted({p for p, _ in rows}, reverse=True):
        above = [y for p, y in rows if p >= s]
        found += sum(y for p, y in rows if p == s) * sum(above) / len(above)
    whole = sum(y for _, y in rows)
    assert out["average_precision"] == pytest.approx(found / whole, abs=2e-8)
    assert out["brier"] == pytest.approx(sum((p - y) ** 2 for p, y in rows) / 200, abs=2e-8)


def test_one_class_has_no_auc(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.2, 0)], "score double, label int")
    out = metrics.quality(rows, "score", "label").first()
    assert (out["auc"], out["average_precision"]) == (None, None)


def test_capture_bootstrap_against_resampling(spark):
    rng = random.Random(3)
    rows = [(f"i{i:02d}", rng.choice(["a", "b", "c"]), rng.random() < 0.4, rng.random()) for i in range(30)]
    draws = [(0, "a", 2), (0, "c", 1), (1, "b", 3), (2, "a", 1), (2, "b", 1), (2, "c", 1)]
    data = spark.createDataFrame([("m", i, v, int(y), s) for i, v, y, s in rows], "method string, application_id string, vintage string, label int, score double")
    ranked = ranking.global_rank(data, "score", "application_id", ("method",))
    got = metrics.capture_bootstrap(ranked, spark.createDataFrame(draws, "replicate int, vintage string, weight int"), spark.createDataFrame([(10,), (50,)], "percent int"))
    for r in got.collect():
        weight = {v: w for k, v, w in draws if k == r["replicate"]}
        sample = sorted((row for row in rows for _ in range(weight.get(row[1], 0))), key=lambda x: (-x[3], x[0]))
        k = -(-len(sample) * r["percent"] // 100)
        assert r["captured"] == sum(y for _, _, y, _ in sample[:k])


def test_distances_by_hand(spark):
    old = spark.createDataFrame([(0.0, "a")] * 10 + [(1.0, "b")] * 10, "v double, c string")
    new = spark.createDataFrame([(0.0, "a")] * 5 + [(1.0, "b")] * 15, "v double, c string")
    ks = drift.ks_distance(old, new, "v").first()
    assert (ks["distance"], ks["at_value"], ks["reference_cdf"], ks["current_cdf"]) == (0.25, 0.0, 0.5, 0.25)
    assert drift.total_variation(old, new, "c", ("a", "b", "z")).first()["distance"] == 0.25
    assert [r["current_count"] for r in drift.category_shares(old, new, "c", ("a", "b", "z")).orderBy("value").collect()] == [5, 15, 0]
    assert drift.ks_distance(old, new.limit(19), "v").first()["status"] == "insufficient_sample"
    assert drift.reference_edges(old, "v").first()["edges"] == [0.5]


def test_anniversaries_money_and_labels(spark):
    dates = spark.createDataFrame([(D(2016, 2, 29),), (D(2013, 1, 31),)], "d date")
    assert [r[0] for r in dates.select(loans.anniversary(F.col("d"))).collect()] == [D(2018, 2, 28), D(2015, 1, 31)]
    texts = spark.createDataFrame([("1.50",), ("0",), ("-1",), ("1.005",), ("x",), (" 7 ",), ("1e3",)], "t string")
    assert [None if r[0] is None else float(r[0]) for r in texts.select(loans.money(F.col("t"))).collect()] == [1.5, 0.0, None, None, None, 7.0, 1000.0]
    ends = spark.createDataFrame([(D(2015, 1, 1),), (D(2015, 1, 2),), (None,)], "c date")
    assert [r[0] for r in ends.select(loans.label_chargeoff(F.col("c"), day("2015-01-01"))).collect()] == [1, 0, 0]


def test_replay_stops_at_the_first_violation(spark):
    schema = "sequence long, request_id string, application_id string, action string, actor string, expected_version int, note string, evidence string, outcome string"
    events = [(1, "q1", "A", "claim", "x", 0, "", "", None), (2, "q2", "A", "resolve", "x", 1, "n", "e", "escalated"), (3, "q3", "B", "claim", "x", 0, "", "", None), (4, "q4", "B", "release", "y", 1, "n", "", None), (5, "q5", "B", "release", "x", 2, "n", "", None)]
    queue = spark.createDataFrame([("A",), ("B",), ("C",)], "application_id string")
    got = {r["application_id"]: tuple(r)[1:] for r in journal.replay(queue, spark.createDataFrame(events, schema)).collect()}
    end = (4, "not_owner")
    assert got == {"A": ("resolved", "x", "escalated", 2, *end), "B": ("in_review", "x", None, 1, *end), "C": ("queued", None, None, 0, *end)}
    stop = lambda rows: tuple(journal.first_violation(journal.judged(spark.createDataFrame(rows, schema), queue)).first())
    claim = lambda n, request, case, actor="x": (n, request, case, "claim", actor, 0, "", "", None)
    # A violation of one case ends the journal for all of them.
    assert {r["version"] for r in journal.replay(queue, spark.createDataFrame([claim(1, "a", "A"), (2, "b", "A", "resolve", "y", 1, "n", "e", "cleared"), claim(3, "c", "B")], schema)).filter("application_id <> 'A'").collect()} == {0}
    assert stop([claim(1, "a", "A"), claim(2, "b", "B")]) == (None, None)
    assert stop([claim(1, "a", "A"), claim(3, "b", "B")]) == (3, "broken_sequence")
    assert stop([claim(1, "a", "A"), claim(2, "a", "B"), claim(3, "c", "C")]) == (2, "repeated_request")
    assert stop([claim(1, "a", "A"), claim(2, "b", "D")]) == (2, "unknown_case")
    stamped = spark.createDataFrame([(*claim(1, "a", "A"), "2024-01-01T00:00:00Z"), (*claim(2, "b", "B"), "2024-01-01T00:00:00.5+00:00"), (*claim(3, "c", "C"), "2024-01-01T00:00:00+01:00")], schema + ", occurred_at string")
    assert tuple(journal.first_violation(journal.judged(stamped, queue)).first()) == (3, "time_not_utc")
    whole = journal.running_identity(stamped, "request_id", "actor").orderBy("sequence").collect()
    for n, r in enumerate(whole, 1):
        assert tuple(r)[1:] == tuple(reconcile.fingerprint(stamped.filter(F.col("sequence") <= n), "request_id", "actor").first())
    assert decide("queued", None, 0, "claim", "x", 1) == "stale_version"
    assert decide("in_review", "x", 1, "resolve", "y", 1) == "not_owner"


COMMANDS = "request_id string, application_id string, action string, actor string, expected_version int, note string, evidence string, outcome string"


def test_rules_of_single_commands(spark):
    cases = [
        (("q", "A", "claim", "x", 0, "", None, ""), None),
        (("q", "A", "claim", "x", 0, "n", "", ""), "claim_with_text"),
        (("q", "A", "release", "x", 1, "", "", ""), "missing_reason"),
        (("q", "A", "release", "x", 1, "n", "e", ""), "evidence_without_resolution"),
        (("q", "A", "reopen", "x", 1, "n", "", ""), None),
        (("q", "A", "reopen", "x", 1, None, "", ""), "missing_reason"),
        (("q", "A", "resolve", "x", 1, "n", "e", "cleared"), None),
        (("q", "A", "resolve", "x", 1, "n", "", "cleared"), "incomplete_resolution"),
        (("q", "A", "resolve", "x", 1, "n", "e", "confirmed"), "unknown_outcome"),
        ((" q", "A", "claim", "x", 0, "", "", ""), "invalid_request_id"),
        (("q", "A" * 201, "claim", "x", 0, "", "", ""), "invalid_application_id"),
        (("q", "A", "claim", None, 0, "", "", ""), "invalid_actor"),
        (("q", "A", "release", "x", 0, "n ", "", ""), "invalid_note"),
        (("q", "A", "claim", "x", None, "", "", ""), "invalid_version"),
        (("q", "A", "close", "x", 0, "", "", ""), "invalid_action"),
    ]
    rows = spark.createDataFrame([c for c, _ in cases], COMMANDS).coalesce(1)
    assert [r[0] for r in rows.select(journal.command_issue()).collect()] == [issue for _, issue in cases]


def test_stream_decides_like_the_replay(spark, tmp_path):
    commands = [
        ("q1", "A", "claim", "x", 0, "", "", ""),
        ("q2", "A", "resolve", "x", 1, "", "", ""),
        ("q3", "A", "resolve", "x", 1, "n", "e", "cleared"),
        ("q1", "A", "claim", "x", 0, "", "", ""),
        ("q3", "A", "resolve", "x", 1, "n", "other", "cleared"),
        ("q4", "A", "reopen", "z", 2, "n", "", ""),
        ("q5", "A", "claim", "y", 1, "", "", ""),
        ("q1", "B", "claim", "x", 0, "", "", ""),
        ("q6", "unlisted", "claim", "x", 0, "", "", ""),
        ("q7", "B", "claim", "x", 0, "", "", ""),
    ]
    schema = spark.createDataFrame([], COMMANDS).schema
    for i, c in enumerate(commands):
        spark.createDataFrame([c], schema).write.mode("append").parquet(f"{tmp_path}/in{i}")
    got = []
    (tmp_path / "all").mkdir()
    queue = spark.createDataFrame([("A",), ("B",)], "application_id string")
    live = stream_review(spark.readStream.schema(schema).parquet(f"{tmp_path}/all"), queue)
    for i in range(len(commands)):
        spark.read.parquet(f"{tmp_path}/in{i}").write.mode("append").parquet(f"{tmp_path}/all")
        live.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        got.append(spark.read.parquet(f"{tmp_path}/out").count())
    assert got == list(range(1, len(commands) + 1))
    results = sorted((r["request_id"], r["result"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert results == sorted(
        [("q1", "accepted", ""), ("q2", "rejected", "incomplete_resolution"), ("q3", "accepted", ""), ("q1", "replayed", ""), ("q3", "rejected", "request_conflict"), ("q4", "accepted", ""), ("q5", "rejected", "stale_version"),
         ("q1", "rejected", "request_conflict"), ("q6", "rejected", "unknown_case"), ("q7", "accepted", "")]
    )


def test_fingerprint_ignores_order_and_sees_copies(spark):
    rows = [("a", 1), ("b", None), ("c", 3)]
    make = lambda r: reconcile.fingerprint(spark.createDataFrame(r, "k string, v int").repartition(2), "k", "v").first()
    assert make(rows) == make(rows[::-1])
    assert make(rows) != make([*rows, rows[0], rows[0]])
    assert make(rows) != make([("a", 1), ("b", 2), ("c", 3)])


def test_reconcile_finds_every_kind_of_difference(spark):
    schema = "k int, x double, s string"
    a = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, None), (3, 3.0, "c")], schema)
    e = spark.createDataFrame([(1, 1.0000001, "a"), (2, 2.5, "b"), (4, 4.0, "d")], schema)
    got = {(r["k"], r["difference"]) for r in reconcile.reconcile(a, e, ("k",), {"x": 1e-6}).collect()}
    assert got == {(2, "x"), (2, "s"), (3, "unexpected_row"), (4, "missing_row")}


def test_logistic_penalty_matches_newton(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    x = (x - x.mean(0)) / x.std(0)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [0.8, -0.5] + 0.2)))).astype(float)
    w = np.zeros(3)
    a = np.column_stack([x, np.ones(300)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag([1, 1, 0]), a.T @ (y - p) - np.array([1, 1, 0]) * w)
    from pyspark.ml.linalg import Vectors

    model = models.fit_logistic(spark.createDataFrame([(Vectors.dense(v), float(t)) for v, t in zip(x.tolist(), y, strict=True)], ["features", "label"]))
    assert [*model.coefficients, model.intercept] == pytest.approx(w.tolist(), abs=1e-6)


def test_imputation_and_scaling_learn_from_training_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    rows = spark.createDataFrame([(None,), (100.0,)], "x double")
    assert sorted(tuple(r) for r in features.impute_median(train, rows, "x").collect()) == [(2.0, 1), (100.0, 0)]
    assert features.standardize(train.dropna(), rows.dropna(), ("x",)).first()["x"] == 98.0


def test_csv_tables_are_strict(spark, tmp_path):
    (tmp_path / "a.csv").write_text("application_id,decision_at,principal_cents,segment\nA,2024-01-01,9223372036854775807,retail\nB,x,1.5,retail\n")
    rows = tables.typed(tables.read_text_table(spark, str(tmp_path / "a.csv"), tables.APPLICATIONS)).orderBy("application_id").collect()
    assert (rows[0]["principal_cents"], rows[1]["decision_at"]) == (2**63 - 1, None)
    with pytest.raises(ValueError, match="columns differ"):
        tables.read_text_table(spark, str(tmp_path / "a.csv"), ("application_id", "segment"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        for _ in range(2):
            tables.write_table(spark.range(1), str(tmp_path / "out"), ("id",))


def test_readers_check_headers_classes_and_identities(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return f"{tmp_path}/{name}"

    coded = tables.read_coded_table(spark, file("coded", "A11 6 1\nA12 48 2\nA14 12 1\n"), ("status", "months", "class"))
    assert [(r["record_id"], r["status"], r["label"]) for r in coded.orderBy("record_id").collect()] == [(1, "A11", 0), (2, "A12", 1), (3, "A14", 0)]
    with pytest.raises(Exception, match="neither 1 nor 2"):
        tables.read_coded_table(spark, file("bad", "A11 6 9\n"), ("status", "months", "class")).collect()

    wide = tables.read_wide_int_table(spark, file("wide.csv", "id,limit\n1,20\n2,30\n"), ("id", "limit"))
    assert sorted(map(tuple, wide.collect())) == [(1, 20), (2, 30)]
    with pytest.raises(ValueError, match="columns differ"):
        tables.read_wide_int_table(spark, file("swapped.csv", "limit,id\n1,20\n"), ("id", "limit"))
    with pytest.raises(Exception, match="count the rows"):
        tables.read_wide_int_table(spark, file("ids.csv", "id,limit\n7,20\n7,30\n"), ("id", "limit")).collect()

    raw = tables.read_raw_loans(spark, {"B": file("b.csv", "x,y\n1,2\n3,4\n"), "A": file("a.csv", "x,y\n5,6\n")}, ("x", "y"))
    assert sorted((r["source"], r["ordinal"], r["x"], r["y"]) for r in raw.collect()) == [("A", 1, "5", "6"), ("B", 1, "1", "2"), ("B", 2, "3", "4")]
    with pytest.raises(ValueError, match="columns differ"):
        tables.read_raw_loans(spark, {"C": file("c.csv", "y,x\n1,2\n")}, ("x", "y"))


def test_rows_are_numbered_over_the_blocks_of_a_file(spark, tmp_path):
    (tmp_path / "long").write_text("".join(f"c{i} {i} 1\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = tables.read_coded_table(spark, f"{tmp_path}/long", ("code", "n", "class")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 3000
    assert all(r["record_id"] == int(r["n"]) + 1 for r in rows)
