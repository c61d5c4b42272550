"""Which expected inputs were there at the decision, and explicit coverage rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

#: The statuses of a slot, and of a population.
STATUSES = ("available", "late_for_decision", "observed_after_decision", "no_visible_event")
POPULATION_STATUSES = ("no_visible_applications", "incomplete_coverage", "complete_coverage")


def expected_slots(populations: DataFrame, features: DataFrame) -> DataFrame:
    """A slot for each row of ``populations`` (population, application_id, decision_at) and feature."""
    return populations.crossJoin(F.broadcast(features.select("name")))


def slot_status(slots: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """Slots with status, value and timing, from events visible at ``as_of``."""
    one = F.struct("value", "observed_at", "available_at")
    seen = slots.select("application_id", "decision_at", "name").distinct().join(events, ["application_id", "name"]).filter(F.col("available_at") <= as_of)
    before = F.col("observed_at") <= F.col("decision_at")
    timely = before & (F.col("available_at") <= F.col("decision_at"))
    found = seen.groupBy("application_id", "name").agg(
        F.max_by(F.when(timely, one), F.when(timely, F.col("available_at"))).alias("timely"),
        F.min_by(F.when(before, one), F.when(before, F.col("available_at"))).alias("late"),
        F.min_by(one, "available_at").alias("post"),
    )
    status = F.when(F.col("timely").isNotNull(), STATUSES[0]).when(F.col("late").isNotNull(), STATUSES[1]).when(F.col("post").isNotNull(), STATUSES[2]).otherwise(STATUSES[3])
    out = slots.join(found, ["application_id", "name"], "left").withColumn("status", status).withColumn("x", F.coalesce("timely", "late", "post"))
    return out.select(
        "population",
        "application_id",
        "decision_at",
        F.date_format("decision_at", "yyyy-MM").alias("vintage"),
        F.col("name").alias("feature"),
        "status",
        "x.value",
        "x.observed_at",
        "x.available_at",
        F.when(F.col("status") == STATUSES[0], F.datediff("decision_at", "x.observed_at")).alias("observation_age_days"),
        F.datediff("x.available_at", "x.observed_at").alias("availability_lag_days"),
        F.when(F.col("status") == STATUSES[1], F.datediff("x.available_at", "decision_at")).alias("late_days"),
    )


def coverage_rollup(slots: DataFrame) -> DataFrame:
    """Counts by status, coverage and delays, by population, feature and month, and over all months."""
    on_time = F.col("status") == STATUSES[0]
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    median = lambda c: F.percentile(c, F.lit(0.5))
    lag = F.when(on_time, F.col("availability_lag_days"))
    grouped = slots.groupingSets([["population", "vintage", "feature"], ["population", "feature"]], "population", "vintage", "feature").agg(
        F.count("*").alias("applications"),
        *counts,
        F.round(F.count_if(on_time) / F.count("*"), 8).alias("coverage_rate"),
        median(F.col("observation_age_days")).alias("median_observation_age_days"),
        median(lag).alias("median_availability_lag_days"),
        F.max(lag).alias("max_availability_lag_days"),
        median(F.col("late_days")).alias("median_late_days"),
        F.max("late_days").alias("max_late_days"),
    )
    return grouped.withColumn("vintage", F.coalesce("vintage", F.lit("all")))


def population_completeness(window: DataFrame, names: DataFrame, slots: DataFrame, as_of: Column) -> DataFrame:
    """A row for each population of ``names``: its applications that are visible at ``as_of``, those with all their inputs and those without, those not yet visible, and a status.

    ``window`` (population, application_id, decision_at) holds all applications
    of the populations' windows, ``slots`` those of the visible ones.
    """
    seen = window.groupBy("population").agg(F.count_if(F.col("decision_at") <= as_of).alias("applications"), F.count_if(F.col("decision_at") > as_of).alias("not_yet_visible"))
    per_app = slots.groupBy("population", "application_id").agg(F.min(F.col("status") == STATUSES[0]).alias("complete"))
    complete = per_app.groupBy("population").agg(F.count_if("complete").alias("complete"))
    out = names.select("population").distinct().join(seen, "population", "left").join(complete, "population", "left").fillna(0, ["applications", "not_yet_visible", "complete"])
    status = F.when(F.col("applications") == 0, POPULATION_STATUSES[0]).when(F.col("complete") < F.col("applications"), POPULATION_STATUSES[1]).otherwise(POPULATION_STATUSES[2])
    return out.select("population", "applications", "complete", (F.col("applications") - F.col("complete")).alias("incomplete"), "not_yet_visible", status.alias("status"))


def threshold_numerator(text: Column) -> Column:
    """A decimal string in [0, 1] with at most 18 places, as a whole number over 10^18."""
    fraction = F.rpad(F.when(F.instr(text, ".") > 0, F.substring_index(text, ".", -1)).otherwise(""), 18, "0")
    return F.concat(F.substring_index(text, ".", 1), fraction).cast("decimal(19,0)")


def policy_check(rules: DataFrame, coverage: DataFrame) -> DataFrame:
    """Each rule's result: insufficient, fail or pass, by exact integer products."""
    seen = coverage.select("population", "vintage", "feature", "applications", "available", F.round(F.col("available") / F.col("applications"), 8).alias("coverage_rate"))
    joined = rules.join(seen, ["population", "vintage", "feature"], "left")
    n = F.coalesce("applications", F.lit(0))
    short = F.col("available").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") < F.col("applications").cast("decimal(19,0)") * threshold_numerator(F.col("min_coverage"))
    result = F.when(n < F.col("min_applications"), "insufficient").when(short, "fail").otherwise("pass")
    return joined.select("ordinal", "id", "population", "vintage", "feature", n.cast("long").alias("applications"), F.coalesce("available", F.lit(0)).cast("long").alias("available"), "coverage_rate", result.alias("result"))


def policy_verdict(checks: DataFrame) -> DataFrame:
    """Counts by result and the verdict: fail, then insufficient, then pass."""
    of = lambda r: F.count_if(F.col("result") == r)
    return checks.agg(of("pass").alias("passed"), of("fail").alias("failed"), of("insufficient").alias("insufficient"), F.when(of("fail") > 0, "fail").when(of("insufficient") > 0, "insufficient").otherwise("pass").alias("verdict"))


def missing_slots(slots: DataFrame) -> DataFrame:
    """Every slot without a value at the decision, beside their total."""
    lacking = slots.filter(F.col("status") != STATUSES[0]).select("population", "application_id", "decision_at", "feature", "status", "observed_at", "available_at")
    lacking = stored(lacking, "missing")
    return lacking.crossJoin(F.broadcast(lacking.agg(F.count("*").alias("total"))))
