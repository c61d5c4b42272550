"""Diagnosis of the three input tables as text: every row rule, every relationship, every cohort, and what blocks what.

Findings of all checks share one schema, ``(table, check, locator, code)``.  Row rules are judged in one scan a table;
relationships by one grouped pass of each table by its key; cohorts by the same joins as an evaluation.  Later checks read
only the rows that the row rules let pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import asof, contracts
from tidemark.operators.contracts import bad, day, finding, finite
from tidemark.sources.shared import stored

#: Checks in their order, each with those that have to pass before it.
GRAPH = {"configuration": (), "rows": (), "relationships": ("rows",), "cohorts": ("configuration", "rows", "relationships")}


def application_codes() -> Column:
    return F.array_compact(F.array(contracts.valid_id(F.col("application_id")), bad(F.col("decision_at_is").isNotNull(), "invalid_date"), contracts.valid_principal(F.col("principal_cents")), contracts.valid_member(F.col("segment"), contracts.SEGMENTS)))


def feature_codes() -> Column:
    return F.array_compact(F.array(contracts.valid_id(F.col("application_id")), contracts.valid_feature_value(F.col("name"), F.col("value_is")), _dates("observed_at", "available_at", "available_before_observed")))


def performance_codes() -> Column:
    whole = F.col("days_past_due").rlike(r"^[0-9]+\z") & F.col("days_past_due").try_cast("int").between(0, 365)
    return F.array_compact(F.array(contracts.valid_id(F.col("application_id")), _dates("as_of", "available_at", "available_before_report"), bad(whole, "invalid_days_past_due")))


def _dates(first: str, second: str, code: str) -> Column:
    return F.coalesce(*(bad(F.col(f"{c}_is").isNotNull(), "invalid_date") for c in (first, second)), contracts.valid_order(F.col(first), F.col(second), code))


def _rows(rows: DataFrame, table: str, locator: Column) -> DataFrame:
    return rows.select(F.lit(table).alias("table"), F.lit("rows").alias("check"), locator.alias("locator"), F.explode("codes").alias("code"))


def _related(rows: DataFrame, table: str, locator: Column, **broken: Column) -> DataFrame:
    """A finding for each rule that a row breaks, in one pass."""
    codes = F.array_compact(F.array(*(F.when(rule, code) for code, rule in broken.items())))
    return rows.select(F.lit(table).alias("table"), F.lit("relationships").alias("check"), locator.alias("locator"), F.explode(codes).alias("code"))


def window_findings(stages: DataFrame) -> DataFrame:
    """Stages whose window is empty, overlaps another one, or ends after its cutoff.  They are a few rows."""
    other = F.broadcast(stages.select(F.col("stage").alias("other"), F.col("start_at").alias("s"), F.col("end_at").alias("e")))
    met = stages.join(other, (F.col("stage") != F.col("other")) & (F.col("start_at") <= F.col("e")) & (F.col("s") <= F.col("end_at")) & (F.col("s") <= F.col("e")), "left").groupBy("stage", "start_at", "end_at", "cutoff").agg(F.count("other").alias("overlaps"))
    code = F.coalesce(bad(F.col("start_at") <= F.col("end_at"), "invalid_window"), bad(F.col("overlaps") == 0, "overlapping_window"), bad(F.col("end_at") <= F.col("cutoff"), "cutoff_before_end"))
    return finding(met, "stages", "configuration", code, F.col("stage"))


def _clean(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("codes") == 0).drop("codes")


def findings(applications: DataFrame, features: DataFrame, performance: DataFrame, stages: DataFrame, names: tuple[str, ...] = asof.FEATURES) -> DataFrame:
    """The whole ledger of the text tables, stored."""
    # Dates and numbers are read once, beside the codes, and stored as such for the later checks.
    date = lambda *columns: {f"{c}_is": day(F.col(c)) for c in columns}
    apps = stored(applications.withColumns(date("decision_at")).withColumn("codes", application_codes()), "diagnosed")
    feats = stored(features.withColumns(date("observed_at", "available_at")).withColumn("value_is", finite(F.col("value"))).withColumn("codes", feature_codes()), "diagnosed")
    reports = stored(performance.withColumns(date("as_of", "available_at")).withColumn("codes", performance_codes()), "diagnosed")
    read = lambda rows, *columns: _clean(rows).withColumns({c: F.col(f"{c}_is") for c in columns}).drop(*(f"{c}_is" for c in columns))
    path = lambda *c: F.concat_ws("/", *c)
    parts = [_rows(apps, "applications", F.col("application_id")), _rows(feats, "features", path("application_id", "name")), _rows(reports, "performance", path("application_id", "as_of"))]
    settings = window_findings(stages)

    known = stored(read(apps, "decision_at").groupBy("application_id").agg(F.count("*").alias("n"), F.min("decision_at").alias("decision_at")), "diagnosed")
    parts.append(finding(known, "applications", "relationships", F.when(F.col("n") > 1, "duplicate_application"), F.col("application_id")))
    about = known.select("application_id", "decision_at")
    revisions = read(feats, "observed_at", "available_at", "value")
    grouped = revisions.groupBy("application_id", "name", "available_at").agg(F.count("*").alias("n")).join(about, "application_id", "left")
    where = path("application_id", "name", F.col("available_at").cast("string"))
    parts.append(_related(grouped, "features", where, ambiguous_feature_revision=F.col("n") > 1, orphan=F.col("decision_at").isNull()))
    seen = read(reports, "as_of", "available_at").withColumn("days_past_due", F.col("days_past_due").cast("int"))
    grouped = seen.groupBy("application_id", "as_of", "available_at").agg(F.count("*").alias("n")).join(about, "application_id", "left")
    where = path("application_id", F.col("as_of").cast("string"), F.col("available_at").cast("string"))
    parts.append(_related(grouped, "performance", where, duplicate_report_revision=F.col("n") > 1, orphan=F.col("decision_at").isNull(), report_not_after_decision=F.col("as_of") <= F.col("decision_at")))

    # Cohorts are those of windows that are right.
    right = stages.join(F.broadcast(settings.select(F.col("locator").alias("stage"))), "stage", "left_anti")
    staged = stored(asof.in_stages(about, right), "diagnosed")
    listed = applications.sparkSession.createDataFrame([(n,) for n in names], "name string")
    lacking = contracts.missing_features(staged, listed, asof.asof_latest(staged, revisions))
    parts.append(finding(lacking, "features", "relationships", F.lit("missing_decision_feature"), path("application_id", "name")))
    outcomes = stored(asof.mature_outcomes(staged, seen, F.col("cutoff"), ("cutoff",)), "diagnosed")
    parts.append(finding(outcomes, "applications", "cohorts", F.when(F.col("label").isNull(), F.col("status")), path("stage", "application_id")))
    gate = contracts.stage_gate(outcomes, right)
    parts.append(finding(gate, "stages", "cohorts", F.when((F.col("unlabelled") == 0) & ~F.col("passed"), "cohort_contract"), F.col("stage")))
    return stored(contracts.issue_ledger(settings, *parts), "ledger")


def diagnose(ledger: DataFrame, limit: int = 100) -> DataFrame:
    """Gates, the first ``limit`` findings and their total, as one table by ``section``."""
    gates = contracts.gate_status(ledger, GRAPH).withColumn("section", F.lit("gate"))
    head = contracts.ledger_report(ledger, limit).withColumn("section", F.lit("finding"))
    total = ledger.agg(F.count("*").alias("findings")).select(F.lit("total").alias("section"), "findings", F.when(F.col("findings") > 0, "invalid_inputs").otherwise("ready_for_evaluation").alias("status"), (F.col("findings") > limit).alias("truncated"))
    return gates.unionByName(head, allowMissingColumns=True).unionByName(total, allowMissingColumns=True)
