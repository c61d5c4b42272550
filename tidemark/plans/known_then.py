"""Queries on what was known at a decision: as-of joins, outcomes, coverage and policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators import asof, coverage, rollup
from tidemark.plans.registry import Tables, query
from tidemark.sources.shared import stored

AS_OF = "1998-10-01"


def day() -> Column:
    return F.lit(AS_OF).cast("date")

def asof_values(source: str) -> str:
    """What each decision of ``source`` knew."""
    return f"""asof_values AS (
  SELECT application_id, decision_at, name, arg_max(value, available_at) AS value, arg_max(observed_at, available_at) AS observed_at, max(available_at) AS available_at
  FROM {source} JOIN feature_events USING (application_id) WHERE available_at <= decision_at AND observed_at <= decision_at GROUP BY application_id, decision_at, name)"""


ASOF, ASOF_DECISIONS = asof_values("applications"), asof_values("decisions")
WIDE = """wide AS (
  SELECT application_id, decision_at, max(CASE WHEN name = 'utilization' THEN value END) AS utilization, max(CASE WHEN name = 'debt_to_income' THEN value END) AS debt_to_income,
    max(CASE WHEN name = 'prior_delinquencies' THEN value END) AS prior_delinquencies FROM asof_values GROUP BY application_id, decision_at)"""
STAGED = """staged AS (SELECT application_id, decision_at, principal_cents, segment, stage, cutoff FROM applications JOIN stages ON decision_at BETWEEN start_at AND end_at)"""


def outcome(source: str, cutoff: str, name: str = "outcome", performance: str = "performance") -> str:
    """Reports of ``performance`` visible at ``cutoff`` of the rows of ``source``, and their status and label."""
    return f"""reports AS (
  SELECT application_id, decision_at, {cutoff} AS cut, as_of, as_of - decision_at AS step, arg_max(days_past_due, p.available_at) AS dpd FROM {source} JOIN {performance} p USING (application_id)
  WHERE p.available_at <= {cutoff} AND as_of > decision_at AND as_of - decision_at <= 180 GROUP BY application_id, decision_at, cut, as_of, step
), seen AS (SELECT application_id, decision_at, cut, bool_or(dpd >= 90) AS bad, count(*) FILTER (WHERE step % 30 = 0) AS n FROM reports GROUP BY application_id, decision_at, cut
), {name} AS (
  SELECT *, CAST(CASE status WHEN 'default' THEN 1 WHEN 'observed_nondefault' THEN 0 END AS INTEGER) AS label FROM (
    SELECT s.*, CASE WHEN {cutoff} - s.decision_at < 182 THEN 'not_mature' WHEN bad THEN 'default' WHEN n >= 6 THEN 'observed_nondefault' ELSE 'missing_performance' END AS status
    FROM {source} s LEFT JOIN seen ON s.application_id = seen.application_id AND s.decision_at = seen.decision_at AND seen.cut = {cutoff}) x)"""


CUT = f"CAST('{AS_OF}' AS DATE)"
VISIBLE = f"visible AS (SELECT application_id, decision_at, principal_cents, segment FROM decisions WHERE decision_at <= {CUT})"
APPS = ("application_id", "decision_at", "principal_cents", "segment")


@query("decisions feature_events", ASOF_DECISIONS + " SELECT * FROM asof_values")
def j01_asof_latest(t: Tables):
    return asof.asof_latest(t.decisions, t.feature_events)


@query("decisions feature_events", f"{ASOF_DECISIONS}, {WIDE} SELECT * FROM wide")
def j02_feature_pivot(t: Tables):
    return asof.feature_pivot(asof.asof_latest(t.decisions, t.feature_events))


@query(
    "decisions feature_events performance",
    f"{ASOF_DECISIONS}, {WIDE}, {VISIBLE}, {outcome('visible', CUT)} SELECT outcome.*, utilization, debt_to_income, prior_delinquencies FROM outcome LEFT JOIN wide USING (application_id, decision_at)",
)
def j03_snapshot(t: Tables):
    return asof.snapshot(t.decisions.select(*APPS), t.feature_events, t.performance, day())


BITEMPORAL = """usable AS (
  SELECT a.application_id, a.decision_at, o.*, greatest(published_at, ingested_at) AS seen_at FROM decisions a JOIN observations o ON o.entity_id = a.application_id
  WHERE greatest(published_at, ingested_at) < CAST(a.decision_at + 1 AS TIMESTAMP)
), best AS (SELECT *, row_number() OVER (PARTITION BY application_id, decision_at, feature ORDER BY event_at DESC, revision DESC, record_id DESC) AS n FROM usable
), slots AS (
  SELECT a.application_id, a.decision_at, f.name AS feature, CASE WHEN b.record_id IS NULL THEN 'no_history' WHEN b.deleted THEN 'deleted'
      WHEN b.event_at >= CAST(a.decision_at + 1 AS TIMESTAMP) - INTERVAL 1 MICROSECOND - INTERVAL 7 DAY THEN 'selected' ELSE 'stale' END AS status,
    b.event_at, b.revision, b.record_id, b.value, b.deleted, b.source, b.published_at, b.ingested_at, b.seen_at AS available_at
  FROM decisions a CROSS JOIN features f LEFT JOIN best b ON b.application_id = a.application_id AND b.decision_at = a.decision_at AND b.feature = f.name AND b.n = 1)"""


@query("decisions observations features", BITEMPORAL + " SELECT * FROM slots")
def j04_asof_bitemporal(t: Tables):
    return asof.bitemporal(t.decisions, t.observations, t.features)


@query(
    "decisions observations",
    """SELECT application_id, decision_at, count(*) AS observations, count(*) FILTER (WHERE greatest(published_at, ingested_at) >= CAST(decision_at + 1 AS TIMESTAMP)) AS future
    FROM decisions JOIN observations ON entity_id = application_id GROUP BY application_id, decision_at""",
)
def j05_future_observations(t: Tables):
    return asof.future_observations(t.decisions, t.observations)


@query(
    "applications performance",
    f"""SELECT application_id, decision_at, as_of, arg_max(days_past_due, available_at) AS days_past_due FROM applications JOIN performance USING (application_id)
    WHERE available_at <= {CUT} AND as_of > decision_at AND as_of - decision_at <= 180 GROUP BY application_id, decision_at, as_of""",
)
def j06_latest_reports(t: Tables):
    return asof.latest_reports(t.applications.select("application_id", "decision_at"), t.performance, day())


@query("decisions performance", f"{VISIBLE}, {outcome('visible', CUT)} SELECT * FROM outcome")
def j07_mature_outcomes(t: Tables):
    return asof.mature_outcomes(t.decisions.filter(F.col("decision_at") <= day()).select(*APPS), t.performance, day())


COHORTS = f"{ASOF}, {WIDE}, {STAGED}, {outcome('staged', 'cutoff')}, cohorts AS (SELECT outcome.*, utilization, debt_to_income, prior_delinquencies FROM outcome LEFT JOIN wide USING (application_id, decision_at))"
COHORT_TABLES = "applications feature_events performance stages"


def cohorts(t: Tables):
    t = t.kept("applications")
    own = t.of(asof.in_stages(t.applications, t.stages))
    return asof.stage_cohorts(own.applications.select(*APPS), own.feature_events, own.performance, t.stages)


@query(COHORT_TABLES, f"{COHORTS} SELECT * FROM cohorts")
def j08_stage_cohorts(t: Tables):
    return cohorts(t)


@query("applications performance stages", f"{STAGED} SELECT * FROM performance WHERE application_id IN (SELECT application_id FROM staged WHERE stage IN ('train', 'calibration'))")
def j09_stage_scoped_outcomes(t: Tables):
    known = asof.in_stages(t.applications, t.stages).filter("stage in ('train', 'calibration')").select("application_id")
    return t.performance.join(known, "application_id", "left_semi")


@query(
    "decisions feature_events",
    f"""SELECT application_id, decision_at, name, coalesce(min(available_at) FILTER (WHERE observed_at <= decision_at), min(available_at)) AS available_at, count(*) FILTER (WHERE observed_at <= decision_at) > 0 AS observed_before
    FROM decisions JOIN feature_events USING (application_id) WHERE available_at <= {CUT} GROUP BY application_id, decision_at, name
    HAVING count(*) FILTER (WHERE observed_at <= decision_at AND available_at <= decision_at) = 0""",
)
def j10_first_late_arrival(t: Tables):
    return asof.first_late_arrival(t.decisions, t.feature_events, day())


@query(
    "decisions observations features",
    BITEMPORAL + " SELECT application_id, decision_at, feature, value, source, record_id, revision, event_at, published_at, ingested_at, available_at FROM slots WHERE status = 'selected'",
)
def j11_feature_lineage(t: Tables):
    return asof.feature_lineage(asof.bitemporal(t.decisions, t.observations, t.features))


@query(
    "decisions feature_events",
    f"""{ASOF_DECISIONS}, naive AS (SELECT application_id, name, arg_max(value, available_at) AS naive_value FROM feature_events GROUP BY application_id, name)
    SELECT application_id, decision_at, name, naive_value, value AS known_value FROM decisions JOIN naive USING (application_id) LEFT JOIN asof_values USING (application_id, decision_at, name) WHERE naive_value IS DISTINCT FROM value""",
)
def j13_compare_naive(t: Tables):
    return asof.compare_naive(t.decisions, t.feature_events)


POPULATIONS = f"""names AS (SELECT stage AS population, start_at, end_at FROM stages UNION ALL SELECT 'future', DATE '2030-01-01', DATE '2030-12-31' UNION ALL SELECT 'current', DATE '1998-01-01', DATE '2000-12-31'
), inside AS (SELECT population, application_id, decision_at FROM applications JOIN names ON decision_at BETWEEN start_at AND end_at), populations AS (SELECT * FROM inside WHERE decision_at <= {CUT})"""
SLOTS = f"""{POPULATIONS}, found AS (
  SELECT p.population, p.application_id, p.decision_at, f.name AS feature,
    arg_max(struct_pack(value, observed_at, available_at), available_at) FILTER (WHERE observed_at <= decision_at AND available_at <= decision_at) AS timely,
    arg_min(struct_pack(value, observed_at, available_at), available_at) FILTER (WHERE observed_at <= decision_at) AS late,
    arg_min(struct_pack(value, observed_at, available_at), available_at) FILTER (WHERE available_at IS NOT NULL) AS post
  FROM populations p CROSS JOIN features f LEFT JOIN feature_events e ON e.application_id = p.application_id AND e.name = f.name AND e.available_at <= {CUT}
  GROUP BY p.population, p.application_id, p.decision_at, f.name
), judged AS (
  SELECT *, CASE WHEN timely IS NOT NULL THEN 'available' WHEN late IS NOT NULL THEN 'late_for_decision' WHEN post IS NOT NULL THEN 'observed_after_decision' ELSE 'no_visible_event' END AS status,
    coalesce(timely, late, post) AS x FROM found
), slots AS (
  SELECT population, application_id, decision_at, strftime(decision_at, '%Y-%m') AS vintage, feature, status, x.value AS value, x.observed_at AS observed_at, x.available_at AS available_at,
    CAST(CASE WHEN status = 'available' THEN decision_at - x.observed_at END AS INTEGER) AS observation_age_days, CAST(x.available_at - x.observed_at AS INTEGER) AS availability_lag_days,
    CAST(CASE WHEN status = 'late_for_decision' THEN x.available_at - decision_at END AS INTEGER) AS late_days FROM judged)"""
SLOT_TABLES = "applications feature_events features stages"


def names(t: Tables):
    """The stages, a window that reaches beyond the day of the report, and one that no application falls into."""
    more = t.spark.sql("SELECT stage, CAST(a AS DATE) AS start_at, CAST(b AS DATE) AS end_at FROM (VALUES ('future', '2030-01-01', '2030-12-31'), ('current', '1998-01-01', '2000-12-31')) AS w(stage, a, b)")
    return t.stages.select("stage", "start_at", "end_at").unionByName(more)


def windows(t: Tables):
    every = names(t)
    inside = t.applications.join(F.broadcast(every), F.col("decision_at").between(F.col("start_at"), F.col("end_at")))
    return inside.select(F.col("stage").alias("population"), "application_id", "decision_at")


def populations(t: Tables):
    return windows(t).filter(F.col("decision_at") <= day())


def slots(t: Tables):
    """Stored, since reports read the same slots several times; features are derived for the populations' applications alone."""
    own = populations(t)
    return stored(coverage.slot_status(coverage.expected_slots(own, t.features), t.of(own).feature_events, day()), "slots")


def completeness(t: Tables, own):
    return coverage.population_completeness(windows(t), names(t).withColumnRenamed("stage", "population"), own, day())


@query(SLOT_TABLES, f"{POPULATIONS} SELECT population, application_id, decision_at, name FROM populations CROSS JOIN features")
def q01_expected_slots(t: Tables):
    return coverage.expected_slots(populations(t), t.features)


@query(SLOT_TABLES, f"{SLOTS} SELECT population, application_id, feature, status, value FROM slots")
def q02_slot_status(t: Tables):
    return slots(t).select("population", "application_id", "feature", "status", "value")


@query(SLOT_TABLES, f"{SLOTS} SELECT * FROM slots")
def q03_slot_timing(t: Tables):
    return slots(t)


ROLLUP = f"""{SLOTS}, doubled AS (SELECT * FROM slots UNION ALL SELECT population, application_id, decision_at, 'all', feature, status, value, observed_at, available_at, observation_age_days, availability_lag_days, late_days FROM slots
), coverage AS (
  SELECT population, vintage, feature, count(*) AS applications, count(*) FILTER (WHERE status = 'available') AS available, count(*) FILTER (WHERE status = 'late_for_decision') AS late_for_decision,
    count(*) FILTER (WHERE status = 'observed_after_decision') AS observed_after_decision, count(*) FILTER (WHERE status = 'no_visible_event') AS no_visible_event,
    round(count(*) FILTER (WHERE status = 'available') / count(*), 8) AS coverage_rate, quantile_cont(observation_age_days, 0.5) AS median_observation_age_days,
    quantile_cont(availability_lag_days, 0.5) FILTER (WHERE status = 'available') AS median_availability_lag_days, max(availability_lag_days) FILTER (WHERE status = 'available') AS max_availability_lag_days,
    quantile_cont(late_days, 0.5) AS median_late_days, max(late_days) AS max_late_days FROM doubled GROUP BY population, vintage, feature)"""


@query(SLOT_TABLES, f"{ROLLUP} SELECT * FROM coverage")
def a12_coverage_rollup(t: Tables):
    return coverage.coverage_rollup(slots(t))


COMPLETENESS = """per_app AS (SELECT population, application_id, bool_and(status = 'available') AS complete FROM slots GROUP BY population, application_id
), counted AS (SELECT n.population, (SELECT count(*) FROM populations p WHERE p.population = n.population) AS applications, (SELECT count(*) FROM per_app p WHERE p.population = n.population AND complete) AS complete,
  (SELECT count(*) FROM inside i WHERE i.population = n.population) AS within FROM names n
), completeness AS (SELECT population, applications, complete, applications - complete AS incomplete, within - applications AS not_yet_visible,
  CASE WHEN applications = 0 THEN 'no_visible_applications' WHEN complete < applications THEN 'incomplete_coverage' ELSE 'complete_coverage' END AS status FROM counted)"""


@query(SLOT_TABLES, f"{SLOTS}, {COMPLETENESS} SELECT * FROM completeness")
def a13_population_completeness(t: Tables):
    return completeness(t, slots(t))


REPORT = f"""{ROLLUP}, {COMPLETENESS} SELECT q.*, c.vintage, c.feature, c.applications AS feature_applications, c.available, c.late_for_decision, c.observed_after_decision, c.no_visible_event, c.coverage_rate,
  c.median_observation_age_days, c.median_availability_lag_days, c.max_availability_lag_days, c.median_late_days, c.max_late_days FROM completeness q LEFT JOIN coverage c ON c.population = q.population"""


@query(SLOT_TABLES, REPORT)
def q04_coverage_report(t: Tables):
    """Each population's completeness with its coverage by feature and month; one without visible applications has a row without them."""
    own = slots(t)
    rows = coverage.coverage_rollup(own).withColumnRenamed("applications", "feature_applications")
    return completeness(t, own).join(rows, "population", "left")


CHECKS = f"""{ROLLUP}, checks AS (
  SELECT ordinal, id, r.population, r.vintage, r.feature, coalesce(applications, 0) AS applications, coalesce(available, 0) AS available, coverage_rate,
    CASE WHEN coalesce(applications, 0) < min_applications THEN 'insufficient'
      WHEN CAST(available AS HUGEINT) * 1000000000000000000 < CAST(applications AS HUGEINT) * CAST(CASE WHEN contains(min_coverage, '.') THEN split_part(min_coverage, '.', 1) || rpad(split_part(min_coverage, '.', 2), 18, '0')
        ELSE min_coverage || '000000000000000000' END AS HUGEINT) THEN 'fail' ELSE 'pass' END AS result
  FROM policy_rules r LEFT JOIN coverage c ON c.population = r.population AND c.vintage = r.vintage AND c.feature = r.feature)"""


@query(SLOT_TABLES + " policy_rules", f"{CHECKS} SELECT * FROM checks")
def q05_policy_check(t: Tables):
    return coverage.policy_check(t.policy_rules, coverage.coverage_rollup(slots(t)))


@query(
    SLOT_TABLES + " policy_rules",
    f"""{CHECKS} SELECT count(*) FILTER (WHERE result = 'pass') AS passed, count(*) FILTER (WHERE result = 'fail') AS failed, count(*) FILTER (WHERE result = 'insufficient') AS insufficient,
    CASE WHEN count(*) FILTER (WHERE result = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (WHERE result = 'insufficient') > 0 THEN 'insufficient' ELSE 'pass' END AS verdict FROM checks""",
)
def q06_policy_verdict(t: Tables):
    return coverage.policy_verdict(coverage.policy_check(t.policy_rules, coverage.coverage_rollup(slots(t))))


@query(SLOT_TABLES, f"{SLOTS} SELECT population, application_id, decision_at, feature, status, observed_at, available_at, (SELECT count(*) FROM slots WHERE status <> 'available') AS total FROM slots WHERE status <> 'available'")
def q08_missing_slots(t: Tables):
    return coverage.missing_slots(slots(t))


#: The stages and one that no application falls into.
MORE_STAGES = "every AS (SELECT * FROM stages UNION ALL SELECT 'later', DATE '2030-01-01', DATE '2030-12-31', DATE '2031-06-30')"


def more_stages(t: Tables):
    return t.stages.unionByName(t.spark.sql("SELECT 'later' AS stage, DATE '2030-01-01' AS start_at, DATE '2030-12-31' AS end_at, DATE '2031-06-30' AS cutoff"))


A01 = f"""{MORE_STAGES}, ready AS (SELECT e.stage, count(c.stage) AS applications, count(*) FILTER (WHERE label = 1) AS events, count(*) FILTER (WHERE label = 0) AS non_events, count(*) FILTER (WHERE c.stage IS NOT NULL AND label IS NULL) AS unlabelled,
    (SELECT count(*) FROM applications a WHERE NOT EXISTS (SELECT 1 FROM every w WHERE a.decision_at BETWEEN w.start_at AND w.end_at)) AS outside_windows FROM every e LEFT JOIN cohorts c ON c.stage = e.stage GROUP BY e.stage)"""
A02 = f"""monitor AS (SELECT *, CAST(NULL AS BIGINT) AS not_yet_visible FROM ready WHERE stage <> 'test' UNION ALL SELECT 'test', count(*) FILTER (WHERE decision_at <= {CUT}), NULL, NULL, NULL, NULL, count(*) FILTER (WHERE decision_at > {CUT})
    FROM applications WHERE decision_at BETWEEN (SELECT start_at FROM stages WHERE stage = 'test') AND (SELECT end_at FROM stages WHERE stage = 'test'))"""


@query(COHORT_TABLES, f"{COHORTS}, {A01} SELECT * FROM ready")
def a01_preflight(t: Tables):
    return rollup.preflight(cohorts(t), more_stages(t), t.applications)


@query(COHORT_TABLES, f"{COHORTS}, {A01}, {A02} SELECT * FROM monitor")
def a02_preflight_monitor(t: Tables):
    return rollup.preflight_monitor(cohorts(t), more_stages(t), t.applications, day())
