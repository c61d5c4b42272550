"""Queries on row contracts, relationships between tables, loan preparation, journals and published results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, contracts, diagnosis, features, journal, loans, ranking, reconcile, rollup
from tidemark.plans.known_then import A01, A02, COHORT_TABLES, COHORTS, CUT, MORE_STAGES, cohorts, day, more_stages, outcome
from tidemark.plans.registry import Tables, query
from tidemark.sources.shared import stored

ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def day_ok(c: str) -> str:
    return f"(regexp_matches({c}, '{DAY}') AND TRY_CAST({c} AS DATE) IS NOT NULL)"


def finite(c: str) -> str:
    return f"(TRY_CAST({c} AS DOUBLE) IS NOT NULL AND isfinite(TRY_CAST({c} AS DOUBLE)))"


def code(ok: str, name: str) -> str:
    return f"CASE WHEN NOT coalesce({ok}, false) THEN '{name}' END"


def check(table: str, column: str, ok: str, name: str) -> str:
    return f"SELECT {column} AS value, {code(ok, name)} AS code, count(*) AS rows FROM {table} GROUP BY ALL"


def judged(rows, column: str, issue):
    return rows.groupBy(F.col(column).alias("value"), issue.alias("code")).agg(F.count("*").alias("rows"))


@query("dirty_applications", check("dirty_applications", "application_id", f"regexp_matches(application_id, '{ID}')", "invalid_id"))
def p01_valid_id(t: Tables):
    return judged(t.dirty_applications, "application_id", contracts.valid_id(F.col("application_id")))


@query("dirty_applications", check("dirty_applications", "decision_at", day_ok("decision_at"), "invalid_date"))
def p02_valid_date(t: Tables):
    return judged(t.dirty_applications, "decision_at", contracts.valid_date(F.col("decision_at")))


@query("dirty_applications", check("dirty_applications", "principal_cents", r"regexp_matches(principal_cents, '^[0-9]+\z') AND TRY_CAST(principal_cents AS BIGINT) > 0", "invalid_principal"))
def p03_valid_principal(t: Tables):
    return judged(t.dirty_applications, "principal_cents", contracts.valid_principal(F.col("principal_cents")))


@query("dirty_applications", check("dirty_applications", "segment", "segment IN ('retail', 'small_business')", "invalid_segment"))
def p04_valid_segment(t: Tables):
    return judged(t.dirty_applications, "segment", contracts.valid_member(F.col("segment"), contracts.SEGMENTS))


VALUE_CODE = f"""CASE WHEN name NOT IN ('utilization', 'debt_to_income', 'prior_delinquencies') THEN 'unknown_feature' WHEN NOT {finite('value')} THEN 'not_finite'
  WHEN name <> 'prior_delinquencies' AND CAST(value AS DOUBLE) BETWEEN 0 AND 1 THEN NULL WHEN name = 'prior_delinquencies' AND CAST(value AS DOUBLE) BETWEEN 0 AND 20 AND floor(CAST(value AS DOUBLE)) = CAST(value AS DOUBLE) THEN NULL
  ELSE 'out_of_range' END"""


@query("dirty_features", f"SELECT name, code, count(*) AS rows FROM (SELECT name, {VALUE_CODE} AS code FROM dirty_features) GROUP BY name, code")
def p05_valid_feature_value(t: Tables):
    return t.dirty_features.groupBy("name", contracts.valid_feature_value(F.col("name"), F.col("value")).alias("code")).agg(F.count("*").alias("rows"))


@query("dirty_features", f"SELECT application_id, name, {code('observed_at <= available_at', 'available_before_observed')} AS code FROM dirty_features WHERE NOT observed_at <= available_at")
def p06_valid_feature_dates(t: Tables):
    issue = contracts.valid_order(F.col("observed_at"), F.col("available_at"), "available_before_observed").alias("code")
    return t.dirty_features.select("application_id", "name", issue).filter("code is not null")


@query(
    "performance",
    """SELECT CASE WHEN NOT as_of <= seen THEN 'available_before_report' WHEN NOT dpd BETWEEN 0 AND 365 THEN 'invalid_days_past_due' END AS code, count(*) AS rows FROM (
    SELECT as_of, available_at - CAST(date_part('day', as_of) AS INTEGER) % 5 AS seen, days_past_due * 5 AS dpd FROM performance) GROUP BY code""",
)
def p07_valid_report(t: Tables):
    rows = t.performance.select("as_of", F.expr("date_sub(available_at, day(as_of) % 5)").alias("seen"), (F.col("days_past_due") * 5).alias("dpd"))
    return rows.groupBy(contracts.valid_report(F.col("as_of"), F.col("seen"), F.col("dpd")).alias("code")).agg(F.count("*").alias("rows"))


@query("dirty_features", f"SELECT value, {finite('value')} AS finite, count(*) AS rows FROM dirty_features GROUP BY ALL")
def p08_finite_number(t: Tables):
    return t.dirty_features.groupBy("value", contracts.finite(F.col("value")).isNotNull().alias("finite")).agg(F.count("*").alias("rows"))


BROKEN = """broken AS (SELECT CASE WHEN principal_cents % 19 = 0 THEN 'no id' ELSE application_id END AS application_id, decision_at, CASE WHEN principal_cents % 23 = 0 THEN '1990-01' ELSE vintage END AS vintage, segment,
  CASE WHEN principal_cents % 29 = 0 THEN 0 ELSE principal_cents END AS principal_cents, CASE WHEN principal_cents % 31 = 0 THEN 2 ELSE label END AS label, raw_pd, CASE WHEN principal_cents % 37 = 0 THEN 2 ELSE calibrated_pd END AS calibrated_pd FROM predictions)"""


@query(
    "predictions",
    f"""{BROKEN} SELECT CASE WHEN NOT regexp_matches(application_id, '{ID}') THEN 'invalid_id' WHEN segment NOT IN ('retail', 'small_business') THEN 'invalid_segment' WHEN principal_cents <= 0 THEN 'invalid_principal'
    WHEN vintage <> strftime(decision_at, '%Y-%m') THEN 'wrong_vintage' WHEN label NOT IN (0, 1) THEN 'invalid_label' WHEN NOT (raw_pd BETWEEN 0 AND 1 AND calibrated_pd BETWEEN 0 AND 1) THEN 'invalid_probability' END AS code, count(*) AS rows
    FROM broken GROUP BY code""",
)
def p09_valid_prediction(t: Tables):
    cents = F.col("principal_cents")
    changed = {
        "application_id": F.when(cents % 19 == 0, "no id").otherwise(F.col("application_id")),
        "vintage": F.when(cents % 23 == 0, "1990-01").otherwise(F.col("vintage")),
        "label": F.when(cents % 31 == 0, 2).otherwise(F.col("label")),
        "calibrated_pd": F.when(cents % 37 == 0, 2).otherwise(F.col("calibrated_pd")),
        "principal_cents": F.when(cents % 29 == 0, 0).otherwise(cents),
    }
    return t.predictions.withColumns(changed).groupBy(contracts.valid_prediction().alias("code")).agg(F.count("*").alias("rows"))


@query(
    "predictions",
    "SELECT count(*) AS rows, count(*) FILTER (WHERE NOT (vintage = strftime(decision_at, '%Y-%m') AND calibrated_pd BETWEEN 0 AND 1 AND principal_cents > 0)) AS invalid FROM predictions WHERE review_selected = 1",
)
def p10_valid_queue_row(t: Tables):
    return t.predictions.filter("review_selected = 1").agg(F.count("*").alias("rows"), F.count_if(contracts.valid_prediction().isNotNull()).alias("invalid"))


@query("applications stages", "SELECT application_id, stage FROM applications JOIN stages ON decision_at BETWEEN start_at AND end_at")
def p12_window_filter(t: Tables):
    return asof.in_stages(t.applications, t.stages).select("application_id", "stage")


@query("applications", f"SELECT application_id, decision_at FROM applications WHERE decision_at <= {CUT}")
def p13_visibility_filter(t: Tables):
    return t.applications.filter(F.col("decision_at") <= day()).select("application_id", "decision_at")


RULES = """rules AS (SELECT CASE WHEN n % 7 = 1 THEN 'bad id' ELSE 'r' || CAST(n AS VARCHAR) END AS id, CASE WHEN n % 11 = 1 THEN 'live' ELSE 'test' END AS population, CASE WHEN n % 5 = 1 THEN '1998-13' ELSE '1998-08' END AS vintage,
  'utilization' AS feature, CASE WHEN n % 13 = 1 THEN 0 ELSE n END AS min_applications, CASE n % 3 WHEN 0 THEN '0.5' WHEN 1 THEN '1.0' ELSE '0.1234567890123456789' END AS min_coverage FROM (SELECT DISTINCT c AS n FROM applications))"""


@query(
    "applications",
    rf"""{RULES} SELECT id, CASE WHEN NOT regexp_matches(id, '{ID}') THEN 'invalid_id' WHEN population NOT IN ('train', 'calibration', 'test') THEN 'invalid_population'
    WHEN NOT (vintage = 'all' OR regexp_matches(vintage, '^[0-9]{{4}}-(0[1-9]|1[0-2])\z')) THEN 'invalid_vintage' WHEN NOT min_applications >= 1 THEN 'invalid_minimum'
    WHEN NOT regexp_matches(min_coverage, '^(0(\.[0-9]{{1,18}})?|1(\.0{{1,18}})?)\z') THEN 'invalid_threshold' END AS code FROM rules""",
)
def p14_valid_policy_rules(t: Tables):
    n = F.col("n")
    rules = t.applications.select(F.col("c").alias("n")).distinct().select(
        F.when(n % 7 == 1, "bad id").otherwise(F.concat(F.lit("r"), n.cast("string"))).alias("id"), F.when(n % 11 == 1, "live").otherwise("test").alias("population"), F.when(n % 5 == 1, "1998-13").otherwise("1998-08").alias("vintage"),
        F.lit("utilization").alias("feature"), F.when(n % 13 == 1, 0).otherwise(n).alias("min_applications"), F.when(n % 3 == 0, "0.5").when(n % 3 == 1, "1.0").otherwise("0.1234567890123456789").alias("min_coverage"),
    )
    return rules.select("id", contracts.valid_policy_rule().alias("code"))


@query("applications stages", "SELECT DISTINCT strftime(decision_at, '%Y-%m') AS vintage, stage AS population FROM applications CROSS JOIN stages WHERE NOT strftime(decision_at, '%Y-%m') BETWEEN strftime(start_at, '%Y-%m') AND strftime(end_at, '%Y-%m')")
def p15_month_inside_window(t: Tables):
    rules = t.applications.select(F.date_format("decision_at", "yyyy-MM").alias("vintage")).distinct().crossJoin(t.stages.select(F.col("stage").alias("population"))).withColumns({"ordinal": F.lit(1), "id": F.lit("r")})
    return contracts.month_in_window(rules, t.stages).select("vintage", "population")


@query("dirty_applications", "SELECT application_id, count(*) - 1 AS extra FROM dirty_applications GROUP BY application_id HAVING count(*) > 1")
def r01_duplicate_keys(t: Tables):
    return contracts.duplicate_keys(t.dirty_applications, "application_id")


@query("dirty_features applications", "SELECT * FROM dirty_features WHERE application_id NOT IN (SELECT application_id FROM applications)")
def r02_orphans(t: Tables):
    return contracts.orphans(t.dirty_features, t.applications, "application_id")


@query("performance applications", "SELECT application_id, decision_at, as_of FROM (SELECT application_id, as_of - 60 AS as_of FROM performance) JOIN applications USING (application_id) WHERE as_of <= decision_at")
def r03_reports_not_after_decision(t: Tables):
    return contracts.reports_not_after_decision(t.performance.select("application_id", F.date_sub("as_of", 60).alias("as_of")), t.applications)


@query("dirty_features", "SELECT application_id, name, available_at, count(*) - 1 AS extra FROM dirty_features GROUP BY ALL HAVING count(*) > 1")
def r04_ambiguous_feature_revisions(t: Tables):
    return contracts.duplicate_keys(t.dirty_features, "application_id", "name", "available_at")


@query("performance", "SELECT application_id, as_of, count(*) - 1 AS extra FROM performance GROUP BY ALL HAVING count(*) > 1")
def r05_duplicate_report_revisions(t: Tables):
    return contracts.duplicate_keys(t.performance, "application_id", "as_of")


@query(
    "applications feature_events features",
    f"""SELECT application_id, name FROM applications CROSS JOIN features WHERE decision_at <= {CUT} AND NOT EXISTS (SELECT 1 FROM feature_events e WHERE e.application_id = applications.application_id AND e.name = features.name
    AND e.available_at <= decision_at AND e.observed_at <= decision_at)""",
)
def r06_missing_decision_features(t: Tables):
    visible = t.applications.filter(F.col("decision_at") <= day())
    return contracts.missing_features(visible, t.features, asof.asof_latest(visible, t.feature_events))


@query(COHORT_TABLES, f"{COHORTS} SELECT stage, status, count(*) AS rows FROM cohorts WHERE label IS NULL GROUP BY stage, status")
def r07_incomplete_outcomes(t: Tables):
    return contracts.incomplete_outcomes(cohorts(t))


def gate_sql(stages: str, staged: str) -> str:
    """Each of ``stages`` and whether its rows of ``staged`` are enough."""
    return f"""gates AS (SELECT e.stage, count(label) AS rows, count(*) FILTER (WHERE label = 1) AS events, count(c.stage) - count(label) AS unlabelled, count(*) FILTER (WHERE status = 'not_mature') AS not_mature,
      count(*) FILTER (WHERE status = 'missing_performance') AS missing_performance, count(c.stage) = count(label) AND count(label) >= 20 AND count(*) FILTER (WHERE label = 1) BETWEEN 1 AND count(label) - 1 AS passed
      FROM {stages} e LEFT JOIN {staged} c ON c.stage = e.stage GROUP BY e.stage)"""


@query(COHORT_TABLES, f"{COHORTS}, {MORE_STAGES}, {gate_sql('every', 'cohorts')} SELECT * FROM gates")
def r08_stage_gate(t: Tables):
    return contracts.stage_gate(cohorts(t), more_stages(t))


WHOLE_NUMBER = "regexp_matches(days_past_due, '^[0-9]+" + chr(92) + "z') AND TRY_CAST(days_past_due AS INTEGER) BETWEEN 0 AND 365"
CLEAN = f"""app_codes AS (
  SELECT *, list_filter([{code(f"regexp_matches(application_id, '{ID}')", 'invalid_id')}, {code(day_ok('decision_at'), 'invalid_date')}, {code("regexp_matches(principal_cents, '^[0-9]+" + chr(92) + "z') AND TRY_CAST(principal_cents AS BIGINT) > 0", 'invalid_principal')},
    {code("segment IN ('retail', 'small_business')", 'invalid_segment')}], lambda x: x IS NOT NULL) AS codes FROM dirty_applications
), feat_codes AS (
  SELECT *, list_filter([{code(f"regexp_matches(application_id, '{ID}')", 'invalid_id')}, {VALUE_CODE}, CASE WHEN NOT {day_ok('observed_at')} OR NOT {day_ok('available_at')} THEN 'invalid_date'
    WHEN observed_at > available_at THEN 'available_before_observed' END], lambda x: x IS NOT NULL) AS codes FROM dirty_features
), perf_codes AS (
  SELECT *, list_filter([{code(f"regexp_matches(application_id, '{ID}')", 'invalid_id')}, CASE WHEN NOT {day_ok('as_of')} OR NOT {day_ok('available_at')} THEN 'invalid_date'
    WHEN as_of > available_at THEN 'available_before_report' END, {code(WHOLE_NUMBER, 'invalid_days_past_due')}], lambda x: x IS NOT NULL) AS codes FROM dirty_performance
), ids AS (SELECT application_id, count(*) AS n, min(CAST(decision_at AS DATE)) AS decision_at FROM app_codes WHERE len(codes) = 0 GROUP BY application_id
), revisions AS (SELECT application_id, name, CAST(value AS DOUBLE) AS value, CAST(observed_at AS DATE) AS observed_at, CAST(available_at AS DATE) AS available_at FROM feat_codes WHERE len(codes) = 0
), reported AS (SELECT application_id, CAST(as_of AS DATE) AS as_of, CAST(available_at AS DATE) AS available_at, CAST(days_past_due AS INTEGER) AS days_past_due FROM perf_codes WHERE len(codes) = 0
), settings AS (
  SELECT stage, CASE WHEN start_at > end_at THEN 'invalid_window' WHEN EXISTS (SELECT 1 FROM dirty_stages o WHERE o.stage <> s.stage AND o.start_at <= s.end_at AND s.start_at <= o.end_at AND o.start_at <= o.end_at) THEN 'overlapping_window'
    WHEN end_at > cutoff THEN 'cutoff_before_end' END AS code FROM dirty_stages s
), usable AS (SELECT * FROM dirty_stages WHERE stage IN (SELECT stage FROM settings WHERE code IS NULL)
), placed AS (SELECT application_id, decision_at, stage, cutoff FROM ids JOIN usable ON decision_at BETWEEN start_at AND end_at
), {outcome('placed', 'cutoff', 'finished', 'reported')}, {gate_sql('usable', 'finished')}"""
FINDINGS = f"""{CLEAN}, by_revision AS (SELECT application_id, name, available_at, count(*) AS n FROM revisions GROUP BY ALL
), by_report AS (SELECT application_id, as_of, available_at, count(*) AS n FROM reported GROUP BY ALL
), found AS (
  SELECT 'stages' AS "table", 'configuration' AS "check", stage AS locator, code FROM settings
  UNION ALL SELECT 'applications', 'rows', application_id, unnest(codes) FROM app_codes
  UNION ALL SELECT 'features', 'rows', concat_ws('/', application_id, name), unnest(codes) FROM feat_codes
  UNION ALL SELECT 'performance', 'rows', concat_ws('/', application_id, as_of), unnest(codes) FROM perf_codes
  UNION ALL SELECT 'applications', 'relationships', application_id, 'duplicate_application' FROM ids WHERE n > 1
  UNION ALL SELECT 'features', 'relationships', concat_ws('/', application_id, name, CAST(available_at AS VARCHAR)), 'ambiguous_feature_revision' FROM by_revision WHERE n > 1
  UNION ALL SELECT 'features', 'relationships', concat_ws('/', application_id, name, CAST(available_at AS VARCHAR)), 'orphan' FROM by_revision WHERE application_id NOT IN (SELECT application_id FROM ids)
  UNION ALL SELECT 'performance', 'relationships', concat_ws('/', application_id, CAST(as_of AS VARCHAR), CAST(available_at AS VARCHAR)), 'duplicate_report_revision' FROM by_report WHERE n > 1
  UNION ALL SELECT 'performance', 'relationships', concat_ws('/', application_id, CAST(as_of AS VARCHAR), CAST(available_at AS VARCHAR)), 'orphan' FROM by_report WHERE application_id NOT IN (SELECT application_id FROM ids)
  UNION ALL SELECT 'performance', 'relationships', concat_ws('/', application_id, CAST(as_of AS VARCHAR), CAST(available_at AS VARCHAR)), 'report_not_after_decision' FROM by_report JOIN ids USING (application_id) WHERE as_of <= decision_at
  UNION ALL SELECT 'features', 'relationships', concat_ws('/', application_id, name), 'missing_decision_feature' FROM placed p CROSS JOIN (SELECT unnest(['utilization', 'debt_to_income', 'prior_delinquencies']) AS name) f
    WHERE NOT EXISTS (SELECT 1 FROM revisions r WHERE r.application_id = p.application_id AND r.name = f.name AND r.observed_at <= p.decision_at AND r.available_at <= p.decision_at)
  UNION ALL SELECT 'applications', 'cohorts', concat_ws('/', stage, application_id), status FROM finished WHERE label IS NULL
  UNION ALL SELECT 'stages', 'cohorts', stage, 'cohort_contract' FROM gates WHERE unlabelled = 0 AND NOT passed
), ledger AS (SELECT * FROM found WHERE code IS NOT NULL
), checks(ordinal, "check", blockers) AS (VALUES (0, 'configuration', []::VARCHAR[]), (1, 'rows', []), (2, 'relationships', ['rows']), (3, 'cohorts', ['configuration', 'rows', 'relationships'])
), counted AS (SELECT c.ordinal, c."check", blockers, count(l.code) AS findings FROM checks c LEFT JOIN ledger l ON l."check" = c."check" GROUP BY ALL
), statuses AS (SELECT CAST(ordinal AS INTEGER) AS ordinal, "check", findings, CASE WHEN findings > 0 THEN 'failed' WHEN EXISTS (SELECT 1 FROM counted b WHERE b.findings > 0 AND list_contains(c.blockers, b."check")) THEN 'blocked' ELSE 'passed' END AS status FROM counted c)"""
LEDGER_TABLES = "dirty_applications dirty_features dirty_performance dirty_stages"
#: Findings that a diagnosis shows.
SHOWN_FINDINGS = 100


def ledger(t: Tables):
    return diagnosis.findings(t.dirty_applications, t.dirty_features, t.dirty_performance, t.dirty_stages)


@query(LEDGER_TABLES, f"{FINDINGS} SELECT * FROM ledger")
def r10_issue_ledger(t: Tables):
    return ledger(t)


@query(LEDGER_TABLES, f"{FINDINGS} SELECT * FROM statuses")
def r09_gate_status(t: Tables):
    return contracts.gate_status(ledger(t), diagnosis.GRAPH)


JUDGE = """parsed AS (
  SELECT *, CASE WHEN regexp_matches(trim(ApprovalDate), '^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z') THEN TRY_CAST(trim(ApprovalDate) AS DATE) END AS approved, CASE WHEN regexp_matches(trim(FirstDisbursementDate), '^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z') THEN TRY_CAST(trim(FirstDisbursementDate) AS DATE) END AS funded_at,
    CASE WHEN regexp_matches(trim(PaidInFullDate), '^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z') THEN TRY_CAST(trim(PaidInFullDate) AS DATE) END AS paid_at, CASE WHEN regexp_matches(trim(ChargeOffDate), '^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z') THEN TRY_CAST(trim(ChargeOffDate) AS DATE) END AS charged_off_at,
    regexp_replace(LoanStatus, '\\s+', '', 'g') AS status, TRY_CAST(trim(GrossApproval) AS DECIMAL(38, 10)) AS g, TRY_CAST(trim(SBAGuaranteedApproval) AS DECIMAL(38, 10)) AS u, TRY_CAST(trim(InitialInterestRate) AS DOUBLE) AS r, trim(ProcessingMethod) AS method,
    regexp_replace(upper(BorrName), '[^A-Z0-9]', '', 'g') AS b1, regexp_replace(upper(BorrState), '[^A-Z0-9]', '', 'g') AS b2, regexp_replace(upper(BorrZip), '[^A-Z0-9]', '', 'g') AS b3 FROM raw_loans
), judged AS (
  SELECT *, CAST(funded_at + INTERVAL 24 MONTH AS DATE) AS horizon_end, CASE WHEN b1 || b2 || b3 <> '' THEN sha256(b1 || '|' || b2 || '|' || b3) END AS borrower_group,
    CASE WHEN g > 0 AND g = CAST(g AS DECIMAL(38, 2)) THEN CAST(g AS DECIMAL(18, 2)) END AS gross, CASE WHEN u >= 0 AND u = CAST(u AS DECIMAL(38, 2)) THEN CAST(u AS DECIMAL(18, 2)) END AS guaranteed, CASE WHEN r BETWEEN 0 AND 100 THEN r END AS rate
  FROM parsed LEFT JOIN stages ON funded_at BETWEEN start_at AND end_at
), reasoned AS (
  SELECT *, CASE WHEN (trim(ApprovalDate) <> '' AND approved IS NULL) OR (trim(FirstDisbursementDate) <> '' AND funded_at IS NULL) OR (trim(PaidInFullDate) <> '' AND paid_at IS NULL) OR (trim(ChargeOffDate) <> '' AND charged_off_at IS NULL) THEN 'invalid_date'
    WHEN funded_at IS NULL OR approved IS NULL THEN 'missing_funding_or_approval' WHEN funded_at > DATE '2014-12-31' OR approved > funded_at THEN 'invalid_date_order' WHEN stage IS NULL THEN 'outside_frozen_windows'
    WHEN horizon_end > DATE '2014-12-31' THEN 'immature_horizon' WHEN status NOT IN ('PIF', 'CHGOFF', 'EXEMPT') THEN 'unusable_loan_status' WHEN status = 'CHGOFF' AND charged_off_at IS NULL THEN 'chargeoff_date_missing'
    WHEN paid_at < funded_at OR paid_at > DATE '2014-12-31' OR charged_off_at < funded_at OR charged_off_at > DATE '2014-12-31' THEN 'invalid_outcome_date' WHEN gross IS NULL OR guaranteed IS NULL THEN 'invalid_money'
    WHEN guaranteed > gross THEN 'guarantee_exceeds_gross' WHEN trim(InitialInterestRate) <> '' AND rate IS NULL THEN 'invalid_initial_rate' WHEN method = '' THEN 'missing_processing_method' WHEN borrower_group IS NULL THEN 'missing_borrower_identity' END AS reason
  FROM judged
), loans AS (
  SELECT 'L' || source || '-' || lpad(CAST(ordinal AS VARCHAR), 7, '0') AS record_id, borrower_group, source, ordinal, stage, approved AS approval_date, funded_at, horizon_end, gross, guaranteed, rate, method, status, paid_at, charged_off_at,
    CAST(coalesce(charged_off_at <= horizon_end, false) AS INTEGER) AS chargeoff_24m FROM reasoned WHERE reason IS NULL
), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY borrower_group ORDER BY funded_at, record_id) AS place FROM loans) WHERE place = 1)"""
SNAPSHOT = "2014-12-31"


def judged_loans(t: Tables):
    return loans.judge(t.raw_loans, t.stages, SNAPSHOT)


def prepared(t: Tables):
    return loans.prepare(t.raw_loans, t.stages, SNAPSHOT)


@query("raw_loans stages", f"{JUDGE} SELECT source, ordinal, reason FROM reasoned")
def n01_first_exclusion_reason(t: Tables):
    return judged_loans(t).select("source", "ordinal", "reason")


@query("raw_loans", "SELECT count(*) FILTER (WHERE trim(AsOfDate) <> '2014-12-31' OR trim(Program) <> '7A') AS other_version FROM raw_loans")
def n02_assert_snapshot_version(t: Tables):
    return loans.snapshot_version(t.raw_loans, SNAPSHOT, "7A")


@query("raw_loans stages", f"{JUDGE} SELECT source, ordinal, borrower_group FROM judged")
def n03_borrower_key(t: Tables):
    return t.raw_loans.select("source", "ordinal", loans.borrower_key(F.col("BorrName"), F.col("BorrState"), F.col("BorrZip")).alias("borrower_group"))


@query("raw_loans stages", f"{JUDGE} SELECT source, ordinal, gross, guaranteed FROM judged")
def n04_parse_money(t: Tables):
    return t.raw_loans.select("source", "ordinal", loans.money(F.col("GrossApproval"), True).alias("gross"), loans.money(F.col("SBAGuaranteedApproval")).alias("guaranteed"))


@query("raw_loans stages", f"{JUDGE} SELECT source, ordinal, rate FROM judged")
def n05_parse_rate(t: Tables):
    return t.raw_loans.select("source", "ordinal", loans.rate(F.col("InitialInterestRate")).alias("rate"))


@query("raw_loans stages", f"{JUDGE} SELECT source, ordinal, stage FROM judged")
def n06_funding_stage(t: Tables):
    return judged_loans(t).select("source", "ordinal", "stage")


@query("applications", "SELECT application_id, CAST(decision_at + INTERVAL 24 MONTH AS DATE) AS horizon_end FROM applications")
def n07_anniversary_24m(t: Tables):
    return t.applications.select("application_id", loans.anniversary(F.col("decision_at")).alias("horizon_end"))


@query("raw_loans stages", f"{JUDGE} SELECT record_id, chargeoff_24m FROM loans")
def n08_chargeoff_label(t: Tables):
    return loans.eligible(judged_loans(t)).select("record_id", "chargeoff_24m")


#: Loans that the frozen study takes of each stage.
SAMPLE = {"train": 20_000, "calibration": 5_000, "test": 10_000}
AUDIT = f"""{JUDGE}, audit AS (
  SELECT 'excluded' AS section, reason, NULL AS stage, count(*) AS rows FROM reasoned WHERE reason IS NOT NULL GROUP BY reason
  UNION ALL SELECT 'eligible', NULL, stage, count(*) FROM loans GROUP BY stage UNION ALL SELECT 'earliest', NULL, stage, count(*) FROM firsts GROUP BY stage)"""


@query(
    "raw_loans stages",
    f"""{AUDIT}, sizes(stage, asked) AS (VALUES ('train', 20000), ('calibration', 5000), ('test', 10000)
    ), chosen AS (SELECT f.* EXCLUDE (place) FROM firsts f JOIN sizes USING (stage) QUALIFY row_number() OVER (PARTITION BY stage ORDER BY sha256('loans:' || source || ':' || ordinal)) <= asked
    ), gate AS (SELECT count(*) FILTER (WHERE trim(AsOfDate) <> '2014-12-31' OR trim(Program) <> '7A') AS other_version FROM raw_loans)
    SELECT 'gate' AS section, other_version, other_version = 0 AS passed FROM gate UNION ALL BY NAME SELECT audit.* FROM audit, gate WHERE other_version = 0
    UNION ALL BY NAME SELECT 'selected' AS section, stage, count(record_id) AS rows, count(record_id) = asked AS enough FROM sizes LEFT JOIN chosen USING (stage), gate WHERE other_version = 0 GROUP BY stage, asked
    UNION ALL BY NAME SELECT 'loan' AS section, chosen.* FROM chosen, gate WHERE other_version = 0""",
)
def n09_prepare_loans(t: Tables):
    return loans.preparation(t.raw_loans, t.stages, SNAPSHOT, "7A", SAMPLE)


@query("raw_loans stages", f"{JUDGE} SELECT record_id, round(ln(1 + CAST(gross AS DOUBLE)), 8) AS log_gross, round(CAST(guaranteed AS DOUBLE) / CAST(gross AS DOUBLE), 8) AS guaranteed_share, rate, method FROM firsts")
def n10_loan_features(t: Tables):
    return loans.loan_features(prepared(t))


@query(
    "raw_loans stages",
    f"""{JUDGE}, own AS (SELECT stage, count(*) AS rows, max(horizon_end) AS last_horizon FROM firsts GROUP BY stage), following AS (SELECT stage, lead(start_at) OVER (ORDER BY start_at) AS next_start FROM stages)
    SELECT stage, rows, last_horizon, next_start, coalesce(last_horizon < next_start, true) AS separate FROM own JOIN following USING (stage)""",
)
def n11_validate_loans(t: Tables):
    return contracts.horizon_overlap(prepared(t), t.stages)


@query("raw_loans stages", f"{JUDGE} SELECT stage, count(*) AS rows, max(horizon_end) AS last_horizon FROM loans GROUP BY stage")
def r12_horizon_overlap(t: Tables):
    return contracts.horizon_overlap(loans.eligible(judged_loans(t)), t.stages).select("stage", "rows", "last_horizon")


@query("raw_loans stages", f"{JUDGE} SELECT borrower_group, count(*) AS rows FROM loans GROUP BY borrower_group HAVING count(*) > 1")
def r11_group_overlap(t: Tables):
    return contracts.group_overlap(loans.eligible(judged_loans(t)), "borrower_group")


@query("raw_loans stages", f"{AUDIT} SELECT * FROM audit")
def a17_exclusion_audit(t: Tables):
    judged = stored(judged_loans(t), "judged")
    return loans.exclusion_audit(judged, loans.firsts(loans.eligible(judged)))


@query(
    "raw_loans stages",
    f"""{JUDGE} SELECT stage, count(*) AS records, CAST(sum(chargeoff_24m) AS BIGINT) AS events, round(avg(chargeoff_24m), 8) AS event_rate, min(funded_at) AS first_funded, max(funded_at) AS last_funded, max(horizon_end) AS last_horizon,
    count(*) FILTER (WHERE rate IS NULL) AS missing_rate FROM firsts GROUP BY stage""",
)
def a18_loan_stage_summary(t: Tables):
    return loans.stage_summary(prepared(t))


@query("raw_loans stages", f"{JUDGE} SELECT CAST(year(funded_at) AS INTEGER) AS year, count(*) AS records, CAST(sum(chargeoff_24m) AS BIGINT) AS events, round(avg(chargeoff_24m), 8) AS event_rate FROM firsts GROUP BY 1")
def a19_year_slices(t: Tables):
    return prepared(t).groupBy(F.year("funded_at").alias("year")).agg(F.count("*").alias("records"), F.sum("chargeoff_24m").alias("events"), F.round(F.avg("chargeoff_24m"), 8).alias("event_rate"))


@query(
    "scores outcomes",
    """altered AS (SELECT s.method, s.application_id, CASE WHEN s.method = 'alt' AND label = 1 AND vintage = '1996-02' THEN 'x' ELSE segment END AS segment FROM scores s JOIN outcomes USING (application_id) WHERE NOT (s.method = 'rule' AND vintage = '1995-05'))
    SELECT application_id, count(*) AS rows, count(DISTINCT segment) AS versions FROM altered GROUP BY application_id HAVING count(*) <> 3 OR count(DISTINCT segment) <> 1""",
)
def r13_same_population(t: Tables):
    joined = t.scores.join(t.outcomes, "application_id")
    changed = joined.withColumn("segment", F.when((F.col("method") == "alt") & (F.col("label") == 1) & (F.col("vintage") == "1996-02"), "x").otherwise(F.col("segment")))
    return contracts.same_population(changed.filter(~((F.col("method") == "rule") & (F.col("vintage") == "1995-05"))), ("segment",))


PUBLISHED = "published AS (SELECT application_id, CASE WHEN principal_cents % 17 = 0 THEN label + 1 ELSE label END AS label, calibrated_pd + CASE WHEN principal_cents % 13 = 0 THEN 0.001 WHEN principal_cents % 5 = 0 THEN 0.0000000001 ELSE 0 END AS calibrated_pd FROM predictions WHERE vintage <> '1995-05')"


@query(
    "predictions",
    f"""{PUBLISHED}, both_sides AS (SELECT coalesce(a.application_id, e.application_id) AS application_id, a.application_id IS NULL AS no_a, e.application_id IS NULL AS no_e, a.label AS al, e.label AS el, a.calibrated_pd AS ap, e.calibrated_pd AS ep
      FROM published a FULL OUTER JOIN predictions e ON a.application_id = e.application_id)
    SELECT application_id, d AS difference FROM (SELECT application_id, unnest(CASE WHEN no_a THEN ['missing_row'] WHEN no_e THEN ['unexpected_row'] ELSE [CASE WHEN al IS DISTINCT FROM el THEN 'label' END, CASE WHEN abs(CAST(ap AS DOUBLE) - CAST(ep AS DOUBLE)) > 1e-6 THEN 'calibrated_pd' END] END) AS d FROM both_sides) WHERE d IS NOT NULL""",
)
def r14_reconcile(t: Tables):
    cents = F.col("principal_cents")
    expected = t.predictions.select("application_id", "label", "calibrated_pd")
    shift = F.when(cents % 13 == 0, 0.001).when(cents % 5 == 0, 0.0000000001).otherwise(0.0)
    actual = t.predictions.filter("vintage <> '1995-05'").select("application_id", (F.col("label") + F.when(cents % 17 == 0, 1).otherwise(0)).alias("label"), (F.col("calibrated_pd").cast("double") + shift).alias("calibrated_pd"))
    return reconcile.reconcile(actual, expected, ("application_id",), {"calibrated_pd": 1e-6})


@query(
    "predictions stages",
    """seen AS (SELECT vintage, segment, count(*) AS rows FROM (SELECT DISTINCT vintage, segment, review_selected FROM predictions WHERE segment = 'retail' OR vintage < '1996') GROUP BY ALL), wanted AS (SELECT DISTINCT vintage, segment FROM predictions)
    SELECT vintage, segment, coalesce(rows, 0) AS rows, true AS expected FROM wanted LEFT JOIN seen USING (vintage, segment) WHERE rows IS DISTINCT FROM 1""",
)
def r15_complete_group_coverage(t: Tables):
    seen = t.predictions.filter("segment = 'retail' or vintage < '1996'").select("vintage", "segment", "review_selected").distinct()
    return reconcile.group_coverage(seen, t.predictions, "vintage", "segment")


@query("scores", "SELECT method, application_id FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, application_id) AS r, row_number() OVER (PARTITION BY method ORDER BY round(score, 1) DESC, application_id) AS p FROM scores) WHERE r <> p")
def r16_rank_agrees_with_score(t: Tables):
    recomputed = ranking.global_rank(t.scores, "score", "application_id", ("method",)).select("method", "application_id", "rank")
    published = ranking.global_rank(t.scores.withColumn("score", F.round("score", 1)), "score", "application_id", ("method",)).select("method", "application_id", "rank")
    return reconcile.reconcile(published, recomputed, ("method", "application_id")).select("method", "application_id")


@query("predictions", "SELECT CAST(7 AS INTEGER) AS seed, application_id, CAST(2 AS BIGINT) AS stages FROM predictions WHERE label = 1")
def r17_split_disjoint(t: Tables):
    split = features.stratified_split(t.predictions, "label", "application_id", 7).select(F.lit(7).alias("seed"), "application_id", "label")
    return contracts.split_disjoint(split.unionByName(split.filter("label = 1")).drop("label"))


COMMAND = """CASE WHEN request_id IS NULL OR request_id = '' OR length(request_id) > 200 OR request_id <> trim(request_id) THEN 'invalid_request_id'
  WHEN application_id IS NULL OR application_id = '' OR length(application_id) > 200 OR application_id <> trim(application_id) THEN 'invalid_application_id'
  WHEN actor IS NULL OR actor = '' OR length(actor) > 200 OR actor <> trim(actor) THEN 'invalid_actor'
  WHEN length(note) > 2000 OR note <> trim(note) THEN 'invalid_note' WHEN length(evidence) > 2000 OR evidence <> trim(evidence) THEN 'invalid_evidence' WHEN length(outcome) > 2000 OR outcome <> trim(outcome) THEN 'invalid_outcome'
  WHEN expected_version IS NULL OR expected_version < 0 THEN 'invalid_version' WHEN action IS NULL OR action NOT IN ('claim', 'release', 'resolve', 'reopen') THEN 'invalid_action'
  WHEN action = 'claim' AND (coalesce(note, '') || coalesce(evidence, '') || coalesce(outcome, '')) <> '' THEN 'claim_with_text'
  WHEN action = 'resolve' AND (coalesce(note, '') = '' OR coalesce(evidence, '') = '') THEN 'incomplete_resolution'
  WHEN action = 'resolve' AND coalesce(outcome, '') NOT IN ('cleared', 'escalated') THEN 'unknown_outcome'
  WHEN action IN ('release', 'reopen') AND coalesce(note, '') = '' THEN 'missing_reason'
  WHEN action IN ('release', 'reopen') AND (coalesce(evidence, '') || coalesce(outcome, '')) <> '' THEN 'evidence_without_resolution' END"""
TRANSITIONS = f"""steps AS (SELECT *, {COMMAND} AS broken, lag(action) OVER w AS before, lag(actor) OVER w AS holder, row_number() OVER w - 1 AS place FROM journal WINDOW w AS (PARTITION BY application_id ORDER BY sequence)
), judged AS (SELECT *, CASE WHEN broken IS NOT NULL THEN broken WHEN expected_version <> place THEN 'stale_version' WHEN action = 'claim' AND NOT (before IS NULL OR before IN ('release', 'reopen')) THEN 'not_queued'
  WHEN action IN ('release', 'resolve') AND NOT coalesce(before = 'claim' AND holder = actor, false) THEN 'not_owner' WHEN action = 'reopen' AND NOT coalesce(before = 'resolve', false) THEN 'not_resolved' END AS issue FROM steps)"""
#: The journal's own rules come after those of single commands and before those of a case; nothing after the first violation counts.
WHOLE = f"""{TRANSITIONS}, ordered AS (
  SELECT j.*, row_number() OVER (ORDER BY sequence) AS position, row_number() OVER (PARTITION BY request_id ORDER BY sequence) AS times,
    application_id IN (SELECT application_id FROM queue) AS listed, regexp_matches(occurred_at, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}(\\.[0-9]{{1,6}})?)?(Z|[+-]00:00)$') AS utc FROM judged j
), ruled AS (
  SELECT *, CASE WHEN broken IS NOT NULL THEN broken WHEN sequence <> position THEN 'broken_sequence' WHEN times > 1 THEN 'repeated_request' WHEN NOT listed THEN 'unknown_case' WHEN NOT utc THEN 'time_not_utc' ELSE issue END AS rule FROM ordered
), violation AS (SELECT min(sequence) AS violation, arg_min(rule, sequence) AS issue FROM ruled WHERE rule IS NOT NULL)"""
STATES = f"""{WHOLE}, lasts AS (
  SELECT application_id, arg_max(action, sequence) AS a, arg_max(actor, sequence) AS who, arg_max(coalesce(outcome, ''), sequence) AS what, count(*) AS version
  FROM ruled, violation v WHERE v.violation IS NULL OR sequence < v.violation GROUP BY application_id
), states AS (SELECT q.application_id, CASE a WHEN 'claim' THEN 'in_review' WHEN 'resolve' THEN 'resolved' ELSE 'queued' END AS status, CASE WHEN a IN ('claim', 'resolve') THEN who END AS owner, CASE WHEN a = 'resolve' THEN nullif(what, '') END AS outcome,
  coalesce(version, 0) AS version, violation, issue FROM queue q LEFT JOIN lasts USING (application_id) CROSS JOIN violation)"""


BROKEN = """SELECT sequence, CASE WHEN sequence % 71 = 0 THEN '' WHEN sequence % 73 = 0 THEN NULL ELSE request_id END AS request_id, CASE WHEN sequence % 79 = 0 THEN application_id || ' ' ELSE application_id END AS application_id,
  CASE WHEN sequence % 17 = 0 THEN 'close' ELSE action END AS action, CASE WHEN sequence % 83 = 0 THEN repeat('x', 201) ELSE actor END AS actor, CAST(CASE WHEN sequence % 89 = 0 THEN -1 ELSE expected_version END AS INT) AS expected_version,
  CASE WHEN sequence % 97 = 0 THEN repeat('y', 2001) ELSE note END AS note, CASE WHEN sequence % 101 = 0 THEN ' file' ELSE evidence END AS evidence, outcome FROM {journal}"""


@query("journal", f"""broken AS ({BROKEN.format(journal='journal')}) SELECT sequence, {COMMAND} AS code FROM broken""")
def g01_validate_commands(t: Tables):
    return t.spark.sql(BROKEN, journal=t.journal).select("sequence", journal.command_issue().alias("code"))


@query("journal queue", f"{STATES} SELECT * FROM states")
def g02_replay_journal(t: Tables):
    return journal.replay(t.queue, t.journal)


@query(
    "journal queue",
    f"""{WHOLE}, requests AS (SELECT request_id, count(*) AS n FROM journal GROUP BY request_id)
    SELECT (SELECT count(*) FROM journal) AS events, (SELECT min(sequence) = 1 AND max(sequence) = count(*) AND count(DISTINCT sequence) = count(*) FROM journal) AS dense, (SELECT count(*) FROM requests WHERE n > 1) AS repeated_requests,
      (SELECT count(*) FROM ordered WHERE NOT listed) AS unknown_cases, (SELECT count(*) FROM ordered WHERE NOT utc) AS not_utc, violation, issue FROM violation""",
)
def g03_journal_integrity(t: Tables):
    return journal.integrity(t.journal, t.queue)


@query(
    "journal",
    """twice AS (SELECT request_id, actor FROM journal UNION ALL SELECT request_id, CASE WHEN expected_version > 5 THEN 'other' ELSE actor END FROM journal WHERE action = 'claim')
    SELECT request_id, count(*) AS times, CASE WHEN count(DISTINCT actor) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'replayed' ELSE 'new' END AS result FROM twice GROUP BY request_id""",
)
def g04_idempotent_requests(t: Tables):
    again = t.journal.filter("action = 'claim'").withColumn("actor", F.when(F.col("expected_version") > 5, "other").otherwise(F.col("actor")))
    return journal.idempotent(t.journal.unionByName(again))


STATUS = """SELECT count(*) AS cases, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'in_review') AS in_review, count(*) FILTER (WHERE status = 'resolved') AS resolved,
  count(*) FILTER (WHERE outcome = 'cleared') AS cleared, count(*) FILTER (WHERE outcome = 'escalated') AS escalated, round(count(*) FILTER (WHERE status = 'resolved') / nullif(count(*), 0), 8) AS completion_rate FROM states"""


@query("journal queue", f"{STATES} {STATUS}")
def g05_review_status(t: Tables):
    return journal.review_status(journal.replay(t.queue, t.journal))


@query("journal queue", f"{STATES} {STATUS}")
def a20_review_status(t: Tables):
    return journal.review_status(journal.replay(t.queue, t.journal))


WORDS = ", ".join(f"CAST(sum(CAST(CAST('0x' || substring(h, {8 * i + 1}, 8) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS word_{i}" for i in range(4))


def at_cut(states: str, n: int) -> str:
    """The states' SQL over the events up to ``n``."""
    return f"cut AS (SELECT * FROM journal WHERE sequence <= {n}), " + states.replace("FROM journal WINDOW", "FROM cut WINDOW")


@query(
    "journal queue",
    f"""{at_cut(STATES, 700)}, hashed AS (SELECT sha256('{{"sequence":' || sequence || ',"request_id":"' || request_id || '","action":"' || action || '"}}') AS h FROM cut), identity AS (SELECT count(*) AS rows, {WORDS} FROM hashed)
    SELECT application_id, status, version, identity.* FROM states CROSS JOIN identity""",
)
def g06_journal_bundle(t: Tables):
    return journal.bundle(t.queue, t.journal, 700, "sequence", "request_id", "action").drop("owner", "outcome", "violation", "issue")


@query("predictions", f"""hashed AS (SELECT sha256('{{"application_id":"' || application_id || '","label":' || label || ',"vintage":"' || vintage || '"}}') AS h FROM predictions) SELECT count(*) AS rows, {WORDS} FROM hashed""")
def s10_fingerprint(t: Tables):
    return reconcile.fingerprint(t.predictions, "application_id", "label", "vintage")


@query("policy_rules applications", f"""{RULES}, hashed AS (SELECT sha256('{{"id":"' || id || '","vintage":"' || vintage || '"}}') AS h FROM rules) SELECT count(*) AS rows, {WORDS} FROM hashed""")
def q07_policy_fingerprint(t: Tables):
    n = F.col("n")
    rules = t.applications.select(F.col("c").alias("n")).distinct().select(F.when(n % 7 == 1, "bad id").otherwise(F.concat(F.lit("r"), n.cast("string"))).alias("id"), F.when(n % 5 == 1, "1998-13").otherwise("1998-08").alias("vintage"))
    return reconcile.fingerprint(rules, "id", "vintage")


@query("predictions", "SELECT 'all' AS cohort, application_id FROM predictions UNION ALL SELECT vintage, application_id FROM predictions")
def u01_union_all_scopes(t: Tables):
    return t.predictions.select(F.lit("all").alias("cohort"), "application_id").unionByName(t.predictions.select(F.col("vintage").alias("cohort"), "application_id"))


@query(
    "predictions",
    """a AS (SELECT vintage, segment FROM predictions WHERE review_selected = 1), b AS (SELECT vintage, segment FROM predictions WHERE label = 1)
    SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def u02_symmetric_difference(t: Tables):
    keys = lambda flag: t.predictions.filter(F.col(flag) == 1).select("vintage", "segment")
    return reconcile.symmetric_difference(keys("review_selected"), keys("label"))


@query("predictions", "SELECT raw_pd AS value FROM predictions UNION SELECT calibrated_pd FROM predictions")
def u03_distinct_union(t: Tables):
    return t.predictions.select(F.col("raw_pd").alias("value")).union(t.predictions.select("calibrated_pd")).distinct()


@query("predictions", "SELECT DISTINCT vintage, segment, label FROM predictions")
def u04_distinct(t: Tables):
    return t.predictions.select("vintage", "segment", "label").distinct()


@query("predictions", "SELECT vintage, count(*) AS loans, CAST(sum(label) AS BIGINT) AS events FROM predictions GROUP BY vintage ORDER BY vintage")
def w11_canonical_ordering(t: Tables):
    return rollup.vintage_metrics(t.predictions).select("vintage", "loans", "events").orderBy("vintage")


@query(COHORT_TABLES, f"{COHORTS}, {A01}, {A02} SELECT 'evaluation' AS section, * FROM ready UNION ALL BY NAME SELECT 'monitoring' AS section, * FROM monitor")
def e02_preflight_monitoring(t: Tables):
    """What an evaluation and a monitor would find, from the same labelled cohorts, without a model."""
    staged = stored(cohorts(t), "cohorts")
    evaluation = rollup.preflight(staged, more_stages(t), t.applications).withColumn("section", F.lit("evaluation"))
    return evaluation.unionByName(rollup.preflight_monitor(staged, more_stages(t), t.applications, day()).withColumn("section", F.lit("monitoring")), allowMissingColumns=True)


@query(
    LEDGER_TABLES,
    f"""{FINDINGS}, head AS (SELECT * FROM ledger ORDER BY "table", "check", code, locator LIMIT {SHOWN_FINDINGS})
    SELECT 'gate' AS section, * FROM statuses UNION ALL BY NAME SELECT 'finding' AS section, * FROM head
    UNION ALL BY NAME SELECT 'total' AS section, count(*) AS findings, CASE WHEN count(*) > 0 THEN 'invalid_inputs' ELSE 'ready_for_evaluation' END AS status, count(*) > {SHOWN_FINDINGS} AS truncated FROM ledger""",
)
def e03_diagnose_inputs(t: Tables):
    return diagnosis.diagnose(ledger(t), SHOWN_FINDINGS)
