"""Row contracts as columns that hold an issue code or null, and checks between tables.

A whole table is judged in one scan; findings of all checks share one schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the data contract.
ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
MONTH = r"^[0-9]{4}-(0[1-9]|1[0-2])\z"
THRESHOLD = r"^(0(\.[0-9]{1,18})?|1(\.0{1,18})?)\z"
SEGMENTS = ("retail", "small_business")
FEATURES = ("utilization", "debt_to_income", "prior_delinquencies")
POPULATIONS = ("train", "calibration", "test")


def bad(ok: Column, code: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(code))


def day(text: Column) -> Column:
    """The date of a canonical ``YYYY-MM-DD`` text, else null.

    The cast of such a text is much cheaper than a parse by pattern, and takes the same days.
    """
    return F.when(text.rlike(DAY), text.try_cast("date"))


def finite(text: Column) -> Column:
    """The finite number that a text holds, else null."""
    number = text.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def valid_id(value: Column) -> Column:
    return bad(value.rlike(ID), "invalid_id")


def valid_date(value: Column) -> Column:
    return bad(day(value).isNotNull(), "invalid_date")


def valid_principal(value: Column) -> Column:
    return bad(value.rlike(r"^[0-9]+\z") & (value.try_cast("bigint") > 0), "invalid_principal")


def valid_member(value: Column, allowed: tuple[str, ...], code: str = "invalid_segment") -> Column:
    return bad(value.isin(*allowed), code)


def valid_feature_value(name: Column, value: Column) -> Column:
    number = finite(value)
    rate = name.isin("utilization", "debt_to_income") & number.between(0, 1)
    count = (name == "prior_delinquencies") & number.between(0, 20) & (F.floor(number) == number)
    return F.when(~F.coalesce(name.isin(*FEATURES), F.lit(False)), "unknown_feature").when(number.isNull(), "not_finite").when(~(rate | count), "out_of_range")


def valid_order(first: Column, second: Column, code: str) -> Column:
    return bad(first <= second, code)


def valid_report(as_of: Column, available_at: Column, dpd: Column) -> Column:
    return F.coalesce(bad(as_of <= available_at, "available_before_report"), bad(dpd.between(0, 365), "invalid_days_past_due"))


def valid_prediction() -> Column:
    """Every rule of a published prediction row, the first that fails."""
    return F.coalesce(
        valid_id(F.col("application_id")),
        valid_member(F.col("segment"), SEGMENTS),
        bad(F.col("principal_cents") > 0, "invalid_principal"),
        bad(F.col("vintage") == F.date_format("decision_at", "yyyy-MM"), "wrong_vintage"),
        bad(F.col("label").isin(0, 1), "invalid_label"),
        bad(F.col("raw_pd").between(0, 1) & F.col("calibrated_pd").between(0, 1), "invalid_probability"),
    )


def valid_policy_rule() -> Column:
    return F.coalesce(
        valid_id(F.col("id")),
        valid_member(F.col("population"), POPULATIONS, "invalid_population"),
        bad((F.col("vintage") == "all") | F.col("vintage").rlike(MONTH), "invalid_vintage"),
        valid_member(F.col("feature"), FEATURES, "invalid_feature"),
        bad(F.col("min_applications") >= 1, "invalid_minimum"),
        bad(F.col("min_coverage").rlike(THRESHOLD), "invalid_threshold"),
    )


def month_in_window(rules: DataFrame, stages: DataFrame) -> DataFrame:
    """Rules whose month lies outside their population's window."""
    inside = F.col("vintage").between(F.date_format("start_at", "yyyy-MM"), F.date_format("end_at", "yyyy-MM"))
    joined = rules.join(F.broadcast(stages.withColumnRenamed("stage", "population")), "population", "left")
    return joined.filter((F.col("vintage") != "all") & ~F.coalesce(inside, F.lit(False))).select("ordinal", "id", "population", "vintage")


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row holds, with how many are too many."""
    return rows.groupBy(*keys).agg((F.count("*") - 1).alias("extra")).filter("extra > 0")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` without a row of ``parent``."""
    return child.join(parent.select(key), key, "left_anti")


def reports_not_after_decision(performance: DataFrame, apps: DataFrame) -> DataFrame:
    return performance.join(apps.select("application_id", "decision_at"), "application_id").filter("as_of <= decision_at").select("application_id", "decision_at", "as_of")


def missing_features(apps: DataFrame, features: DataFrame, known: DataFrame) -> DataFrame:
    """Slots of ``apps`` that ``known`` (application_id, name) lacks."""
    return apps.select("application_id").crossJoin(F.broadcast(features.select("name"))).join(known.select("application_id", "name"), ["application_id", "name"], "left_anti")


def incomplete_outcomes(staged: DataFrame) -> DataFrame:
    return staged.filter("label is null").groupBy("stage", "status").agg(F.count("*").alias("rows"))


def stage_gate(staged: DataFrame, stages: DataFrame, minimum: int = 20) -> DataFrame:
    """Whether each of ``stages`` has enough rows, a label for every one of them, and both classes; a stage without rows fails.

    Beside it are the rows by what they lack.
    """
    status = lambda s: F.count_if(F.col("status") == s)
    counts = staged.groupBy("stage").agg(
        F.count("label").alias("rows"),
        F.count_if(F.col("label") == 1).alias("events"),
        F.count_if(F.col("label").isNull()).alias("unlabelled"),
        status("not_mature").alias("not_mature"),
        status("missing_performance").alias("missing_performance"),
    )
    out = stages.select("stage").join(counts, "stage", "left").fillna(0)
    return out.withColumn("passed", (F.col("unlabelled") == 0) & (F.col("rows") >= minimum) & (F.col("events") > 0) & (F.col("events") < F.col("rows")))


def finding(rows: DataFrame, table: str, check: str, code: Column, locator: Column) -> DataFrame:
    """Findings in the ledger's schema: rows whose ``code`` isn't null."""
    return rows.select(F.lit(table).alias("table"), F.lit(check).alias("check"), locator.alias("locator"), code.alias("code")).filter("code is not null")


def issue_ledger(*findings: DataFrame) -> DataFrame:
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out


def ledger_report(ledger: DataFrame, limit: int = 50) -> DataFrame:
    """The first findings in a fixed order: a report of ``limit`` rows at most, beside the total of ``gate_status``."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit has to be between 1 and 1000")
    return ledger.orderBy("table", "check", "code", "locator").limit(limit)


def gate_status(ledger: DataFrame, graph: dict[str, tuple[str, ...]]) -> DataFrame:
    """Each check's findings and status: one that found nothing is ``blocked`` if any that ``graph`` puts before it failed."""
    spark = ledger.sparkSession
    listed = spark.createDataFrame([(i, c) for i, c in enumerate(graph)], "ordinal int, check string")
    counted = listed.join(ledger.groupBy("check").agg(F.count("*").alias("findings")), "check", "left").fillna(0, ["findings"])
    # As many rows as checks.
    before = spark.createDataFrame([(c, b) for c, blockers in graph.items() for b in blockers], "check string, blocker string")
    failed = before.join(counted.filter("findings > 0").select(F.col("check").alias("blocker")), "blocker", "left_semi").select("check").distinct().withColumn("stopped", F.lit(True))
    status = F.when(F.col("findings") > 0, "failed").when(F.col("stopped"), "blocked").otherwise("passed")
    return counted.join(failed, "check", "left").select("ordinal", "check", "findings", status.alias("status"))


def group_overlap(rows: DataFrame, group: str) -> DataFrame:
    """Groups that occur more than once over all stages."""
    return rows.groupBy(group).agg(F.count("*").alias("rows")).filter("rows > 1")


def horizon_overlap(loans: DataFrame, stages: DataFrame) -> DataFrame:
    """Per stage: its rows, its last outcome horizon, and whether that precedes the next stage."""
    own = loans.groupBy("stage").agg(F.count("*").alias("rows"), F.max("horizon_end").alias("last_horizon"))
    following = stages.select("stage", F.lead("start_at").over(Window.orderBy("start_at")).alias("next_start"))
    return own.join(F.broadcast(following), "stage").withColumn("separate", F.coalesce(F.col("last_horizon") < F.col("next_start"), F.lit(True)))


def same_population(scores: DataFrame, attributes: tuple[str, ...], among: DataFrame | None = None) -> DataFrame:
    """Ids that some method doesn't score once, or scores with other attributes; of the ids ``among`` others only, if given."""
    methods = scores.agg(F.count_distinct("method").alias("methods"))
    some = scores if among is None else scores.join(among, scores["application_id"].eqNullSafe(among["application_id"]), "left_semi")
    per_id = some.groupBy("application_id").agg(F.count("*").alias("rows"), F.count_distinct(F.struct(*attributes)).alias("versions"))
    return per_id.crossJoin(F.broadcast(methods)).filter("rows <> methods or versions <> 1").select("application_id", "rows", "versions")


def split_disjoint(assignment: DataFrame) -> DataFrame:
    """Rows that a seed's split puts into more than one stage."""
    return assignment.groupBy("seed", "application_id").agg(F.count("*").alias("stages")).filter("stages <> 1")
