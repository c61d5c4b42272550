"""Preparation of raw dated loans: first exclusion reason, borrower identity, labels and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.contracts import day
from tidemark.operators.ranking import earliest_per_group, hash_sample
from tidemark.sources.shared import stored

USABLE_STATUS = ("PIF", "CHGOFF", "EXEMPT")


def money(text: Column, positive: bool = False) -> Column:
    """A finite amount of at least 0 with at most two places, else null."""
    value = F.trim(text).try_cast("decimal(28,10)")
    exact = value == value.cast("decimal(28,2)").cast("decimal(28,10)")  # of one type, or the comparison would round
    return F.when(exact & ((value > 0) if positive else (value >= 0)), value.cast("decimal(18,2)"))


def rate(text: Column) -> Column:
    number = F.trim(text).try_cast("double")
    return F.when(~F.isnan(number) & number.between(0, 100), number)


def borrower_key(name: Column, state: Column, zip_code: Column) -> Column:
    """SHA-256 of the cleaned parts joined by a bar; null if nothing is left."""
    parts = [F.regexp_replace(F.upper(c), "[^A-Z0-9]", "") for c in (name, state, zip_code)]
    return F.when(F.length(F.concat(*parts)) > 0, F.sha2(F.concat_ws("|", *parts), 256))


def anniversary(funded: Column, months: int = 24) -> Column:
    return F.add_months(funded, months)


def label_chargeoff(charged: Column, horizon_end: Column) -> Column:
    return F.coalesce((charged <= horizon_end).cast("int"), F.lit(0))


def snapshot_version(raw: DataFrame, as_of: str, program: str) -> DataFrame:
    """Rows of another snapshot or program."""
    return raw.agg(F.count_if((F.trim("AsOfDate") != as_of) | (F.trim("Program") != program)).alias("other_version"))


def judge(raw: DataFrame, stages: DataFrame, as_of: str) -> DataFrame:
    """Raw rows with parsed columns and ``reason``, the first rule that excludes them, or null."""
    dates = {"approved": "ApprovalDate", "funded_at": "FirstDisbursementDate", "paid_at": "PaidInFullDate", "charged_off_at": "ChargeOffDate"}
    parsed = raw.select("*", *(day(F.trim(c)).alias(n) for n, c in dates.items()))
    broken = F.lit(False)
    for n, c in dates.items():
        broken = broken | ((F.trim(c) != "") & F.col(n).isNull())
    windows = F.broadcast(stages.select("stage", "start_at", "end_at"))
    staged = parsed.join(windows, F.col("funded_at").between(F.col("start_at"), F.col("end_at")), "left").drop("start_at", "end_at")
    today = F.lit(as_of).cast("date")
    rows = staged.select(
        "*",
        anniversary(F.col("funded_at")).alias("horizon_end"),
        F.regexp_replace("LoanStatus", r"\s+", "").alias("status"),
        money(F.col("GrossApproval"), True).alias("gross"),
        money(F.col("SBAGuaranteedApproval")).alias("guaranteed"),
        rate(F.col("InitialInterestRate")).alias("rate"),
        F.trim("ProcessingMethod").alias("method"),
        borrower_key(F.col("BorrName"), F.col("BorrState"), F.col("BorrZip")).alias("borrower_group"),
    )
    outside = lambda c: F.coalesce((F.col(c) < F.col("funded_at")) | (F.col(c) > today), F.lit(False))
    rules = [
        (broken, "invalid_date"),
        (F.col("funded_at").isNull() | F.col("approved").isNull(), "missing_funding_or_approval"),
        ((F.col("funded_at") > today) | (F.col("approved") > F.col("funded_at")), "invalid_date_order"),
        (F.col("stage").isNull(), "outside_frozen_windows"),
        (F.col("horizon_end") > today, "immature_horizon"),
        (~F.col("status").isin(*USABLE_STATUS), "unusable_loan_status"),
        ((F.col("status") == "CHGOFF") & F.col("charged_off_at").isNull(), "chargeoff_date_missing"),
        (outside("paid_at") | outside("charged_off_at"), "invalid_outcome_date"),
        (F.col("gross").isNull() | F.col("guaranteed").isNull(), "invalid_money"),
        (F.col("guaranteed") > F.col("gross"), "guarantee_exceeds_gross"),
        ((F.trim("InitialInterestRate") != "") & F.col("rate").isNull(), "invalid_initial_rate"),
        (F.col("method") == "", "missing_processing_method"),
        (F.col("borrower_group").isNull(), "missing_borrower_identity"),
    ]
    return rows.withColumn("reason", F.coalesce(*(F.when(condition, F.lit(code)) for condition, code in rules)))


def eligible(judged: DataFrame) -> DataFrame:
    record = F.format_string("L%s-%07d", F.col("source"), F.col("ordinal"))
    kept = judged.filter("reason is null")
    return kept.select(
        record.alias("record_id"), "borrower_group", "source", "ordinal", "stage", F.col("approved").alias("approval_date"), "funded_at", "horizon_end", "gross", "guaranteed", "rate", "method", "status", "paid_at", "charged_off_at",
        label_chargeoff(F.col("charged_off_at"), F.col("horizon_end")).alias("chargeoff_24m"),
    )


def firsts(loans: DataFrame) -> DataFrame:
    """The first funded loan of each borrower."""
    return earliest_per_group(loans, "borrower_group", "funded_at", "record_id")


def prepare(raw: DataFrame, stages: DataFrame, as_of: str) -> DataFrame:
    """The first funded loan of each borrower among the eligible ones."""
    return firsts(eligible(judge(raw, stages, as_of)))


def sample(first: DataFrame, sizes: dict[str, int], seed: str = "loans") -> DataFrame:
    """An outcome-blind sample of each stage, by the hash of source and ordinal."""
    return hash_sample(first, "stage", F.concat_ws(":", "source", F.col("ordinal").cast("string")), sizes, seed).drop("sample_hash")


def exclusion_audit(judged: DataFrame, first: DataFrame) -> DataFrame:
    """``(section, reason, stage, rows)``: rows by the first rule that excludes them, and by stage those that are eligible and those that are their borrower's first."""
    count = lambda rows, name, *by: rows.groupBy(*by).agg(F.count("*").alias("rows")).withColumn("section", F.lit(name))
    parts = [count(judged.filter("reason is not null"), "excluded", "reason"), count(judged.filter("reason is null"), "eligible", "stage"), count(first, "earliest", "stage")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def preparation(raw: DataFrame, stages: DataFrame, as_of: str, program: str, sizes: dict[str, int], seed: str = "loans") -> DataFrame:
    """The whole job as one table by ``section``: the gate on the snapshot, the audit, what is selected of each stage, and the loans.

    Raw rows are judged once.  If any row is of another snapshot or program, the
    gate's row is all there is.  A stage with less than it should have is not ``enough``.
    """
    judged = stored(judge(raw, stages, as_of), "judged")
    gate = snapshot_version(judged, as_of, program).withColumn("passed", F.col("other_version") == 0)
    first = stored(firsts(eligible(judged)), "firsts")
    chosen = stored(sample(first, sizes, seed), "sample")
    asked = raw.sparkSession.createDataFrame(list(sizes.items()), "stage string, asked int")
    selected = asked.join(chosen.groupBy("stage").agg(F.count("*").alias("rows")), "stage", "left").fillna(0, ["rows"])
    selected = selected.select(F.lit("selected").alias("section"), "stage", "rows", (F.col("rows") == F.col("asked")).alias("enough"))
    parts = exclusion_audit(judged, first).unionByName(selected, allowMissingColumns=True).unionByName(chosen.withColumn("section", F.lit("loan")), allowMissingColumns=True)
    passed = gate.filter("passed").select("passed")
    return parts.crossJoin(F.broadcast(passed)).drop("passed").unionByName(gate.select(F.lit("gate").alias("section"), "other_version", "passed"), allowMissingColumns=True)


def loan_features(loans: DataFrame) -> DataFrame:
    return loans.select("record_id", F.round(F.log1p(F.col("gross").cast("double")), 8).alias("log_gross"), F.round(F.col("guaranteed").cast("double") / F.col("gross").cast("double"), 8).alias("guaranteed_share"), "rate", "method")


def stage_summary(loans: DataFrame) -> DataFrame:
    return loans.groupBy("stage").agg(
        F.count("*").alias("records"), F.sum("chargeoff_24m").cast("long").alias("events"), F.round(F.avg("chargeoff_24m"), 8).alias("event_rate"), F.min("funded_at").alias("first_funded"), F.max("funded_at").alias("last_funded"),
        F.max("horizon_end").alias("last_horizon"), F.count_if(F.col("rate").isNull()).alias("missing_rate"),
    )
