"""Point-in-time joins: what was known at a decision, and which outcomes are mature at a cutoff.

An entity of few decisions and records is joined: each record meets each of its
decisions, FEW_DECISIONS at most, and one shuffle by entity serves the join and its
groups.  Crowded entities are merged: their decisions and records lie in one order
by entity and time, laid by range, and what was best so far is carried from record
to decision, so that n decisions and m records cost n + m rows, in as many tasks
as they fill.  Everything is by decision, an entity and a time: an entity may have
several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import carried
from tidemark.sources.shared import stored

HORIZON_DAYS = 180
REPORT_STEP = 30
REPORTING_LAG = 2
DEFAULT_DPD = 90
FEATURES = ("utilization", "debt_to_income", "prior_delinquencies")
#: Decisions and records of an entity up to which it is joined in one task; beyond either it is merged.
FEW_DECISIONS, FEW_RECORDS = 16, 1_000_000
#: Buckets by which records are counted before those of single entities are.
BUCKETS = 1 << 16


def _crowded(decisions: DataFrame, records: DataFrame, key: str) -> DataFrame | None:
    """The entities of more than FEW_DECISIONS decisions or FEW_RECORDS records, stored; None if there are none.

    Records are counted by bucket of their entity first, which shuffles BUCKETS
    counts a task; only entities of a bucket that holds too many are counted.
    """
    over = lambda rows, most: rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(key)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    full = [r["bucket"] for r in records.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).filter(F.col("n") > FEW_RECORDS).collect()]
    found = over(decisions, FEW_DECISIONS)
    if full:
        # A table that fills most buckets has its entities counted without them.
        found = found.unionByName(over(records.filter(bucket.isin(full)) if len(full) < 1000 else records, FEW_RECORDS)).distinct()
    found = stored(found.filter(F.col(key).isNotNull()), "crowded")
    return None if found.isEmpty() else found


def _parted(crowded: DataFrame | None, key: str, *tables: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """``tables`` without the rows of the crowded entities, and with those alone."""
    if crowded is None:
        return list(tables), []
    return [rows.join(crowded, key, "left_anti") for rows in tables], [rows.join(crowded, key, "left_semi") for rows in tables]


def _merged(decisions: DataFrame, records: DataFrame, by: tuple[str, ...], name: str, summed: bool = False) -> DataFrame:
    """``decisions`` (by, time, ..) with the greatest or summed ``best`` of the ``records`` (by, time, best) of the same ``by`` up to their time."""
    extra = [c for c in decisions.columns if c not in (*by, "time")]
    kind = records.schema["best"].dataType
    first = records.select(*by, "time", F.lit(0).alias("kind"), "best", *(F.lit(None).cast(decisions.schema[c].dataType).alias(c) for c in extra))
    then = decisions.select(*by, "time", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("best"), *extra)
    return carried(first.unionByName(then), by, ("time", "kind"), **{name: ("sum" if summed else "max", "best")}).filter("kind = 1").select(*by, "time", *extra, name)


def asof_latest(left: DataFrame, events: DataFrame, key: str = "application_id", left_time: str = "decision_at", by: tuple[str, ...] = ("name",)) -> DataFrame:
    """For each decision of ``left`` and group ``by`` of its events: the value last available, and observed, by ``left_time``.

    Of events that became available at one time the one observed last counts, then
    the greatest value; events without either time are never known.
    """
    keys = (key, *by)
    asked = left.select(key, F.col(left_time).alias("time")).filter("time is not null")
    known = events.filter("available_at is not null and observed_at is not null").select(*keys, "available_at", "observed_at", "value")
    # Stored, since entities are counted before they are joined.
    known = stored(known.join(asked.select(key), key, "left_semi"), "known")
    (asked, known), crowds = _parted(_crowded(asked, known, key), key, asked, known)
    found = F.struct("available_at", "observed_at", "value")
    seen = asked.join(known, key).filter((F.col("available_at") <= F.col("time")) & (F.col("observed_at") <= F.col("time")))
    latest = seen.groupBy(key, "time", *by).agg(F.max(found).alias("x"))
    if crowds:
        asked, known = crowds
        # A decision is asked for the groups that its entity has.
        asked = asked.distinct().join(known.select(*keys).distinct(), key)
        merged = _merged(asked, known.select(*keys, F.greatest("available_at", "observed_at").alias("time"), found.alias("best")), keys, "x")
        latest = latest.unionByName(merged.filter("x is not null"))
    return latest.select(key, F.col("time").alias(left_time), *by, "x.value", "x.observed_at", "x.available_at")


def feature_pivot(tall: DataFrame, keys: tuple[str, ...] = ("application_id", "decision_at"), names: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row a key with a column for each feature."""
    return tall.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))


def latest_reports(apps: DataFrame, performance: DataFrame, cutoff: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """The last revision, visible at ``cutoff``, of each report inside the horizon."""
    seen = apps.join(performance, "application_id").filter((F.col("available_at") <= cutoff) & (F.col("as_of") > F.col("decision_at")) & (F.datediff("as_of", "decision_at") <= HORIZON_DAYS))
    return seen.groupBy("application_id", "decision_at", "as_of", *extra).agg(F.max_by("days_past_due", "available_at").alias("days_past_due"))


def mature_outcomes(apps: DataFrame, performance: DataFrame, cutoff: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """``status`` and nullable ``label`` of every row of ``apps`` at ``cutoff``; ``extra`` are columns that the cutoff needs."""
    reports = latest_reports(apps.select("application_id", "decision_at", *extra), performance, cutoff, extra)
    step = F.datediff("as_of", "decision_at")
    scheduled = (step % REPORT_STEP == 0) & step.between(REPORT_STEP, HORIZON_DAYS)
    seen = reports.groupBy("application_id", "decision_at", *extra).agg(F.max(F.col("days_past_due") >= DEFAULT_DPD).alias("bad"), F.count_if(scheduled).alias("reports"))
    mature = F.datediff(cutoff, F.col("decision_at")) >= HORIZON_DAYS + REPORTING_LAG
    bad, full = F.coalesce("bad", F.lit(False)), F.coalesce("reports", F.lit(0)) >= HORIZON_DAYS // REPORT_STEP
    status = F.when(~mature, "not_mature").when(bad, "default").when(full, "observed_nondefault").otherwise("missing_performance")
    out = apps.join(seen, ["application_id", "decision_at", *extra], "left").withColumn("status", status).drop("bad", "reports")
    return out.withColumn("label", F.when(F.col("status") == "default", 1).when(F.col("status") == "observed_nondefault", 0))


def snapshot(apps: DataFrame, events: DataFrame, performance: DataFrame, as_of: Column, strict: bool = False, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Visible applications with their decision-time features, status and label; features not known are null.

    ``strict``: a feature that was not known ends the job that reads the snapshot, with the first decision that lacks it.
    """
    visible = apps.filter(F.col("decision_at") <= as_of)
    wide = feature_pivot(asof_latest(visible, events), names=names)
    out = mature_outcomes(visible, performance, as_of).join(wide, ["application_id", "decision_at"], "left")
    if not strict:
        return out
    told = lambda n: F.concat(F.lit("feature not known at the decision: "), F.concat_ws("/", "application_id", F.col("decision_at").cast("string"), F.lit(n)))
    return out.withColumns({n: F.when(F.col(n).isNull(), F.raise_error(told(n))).otherwise(F.col(n)) for n in names})


def in_stages(apps: DataFrame, stages: DataFrame) -> DataFrame:
    """Applications with the stage that their decision falls in.  The stages are a few rows."""
    return apps.join(F.broadcast(stages), F.col("decision_at").between(F.col("start_at"), F.col("end_at"))).drop("start_at", "end_at")


def stage_cohorts(apps: DataFrame, events: DataFrame, performance: DataFrame, stages: DataFrame) -> DataFrame:
    """Every stage's snapshot at its own cutoff, in one pass."""
    staged = in_stages(apps, stages)
    wide = feature_pivot(asof_latest(staged, events))
    return mature_outcomes(staged, performance, F.col("cutoff"), ("cutoff",)).join(wide, ["application_id", "decision_at"], "left")


def bitemporal(decisions: DataFrame, observations: DataFrame, features: DataFrame, max_age_days: int = 7) -> DataFrame:
    """Per decision and feature: ``selected``, ``stale``, ``deleted`` or ``no_history``, and the source record behind it.

    An observation counts once it is published and ingested, up to the end of the
    decision's day; the latest event wins, then the highest revision, then the
    record id.
    """
    keys = ("application_id", "feature")
    available = F.greatest("published_at", "ingested_at")
    found = F.struct("event_at", "revision", "record_id", "value", "deleted", "source", "published_at", "ingested_at", available.alias("available_at"))
    named = observations.withColumnRenamed("entity_id", "application_id")
    end_of_day = F.expr("cast(date_add(decision_at, 1) as timestamp) - interval 1 microsecond")
    asked = decisions.select("application_id", "decision_at")
    (few, some), crowds = _parted(_crowded(asked, named, "application_id"), "application_id", asked, named)
    slots = lambda rows: rows.withColumn("time", end_of_day).crossJoin(F.broadcast(features.select(F.col("name").alias("feature"))))
    records = lambda rows: rows.filter("published_at is not null and ingested_at is not null").select(*keys, available.alias("time"), found.alias("best"))
    # Equal decisions are one until their best record is known.
    once = slots(few.groupBy("application_id", "decision_at").agg(F.count("*").alias("copies")))
    known = records(some).select(F.col("application_id").alias("entity"), F.col("feature").alias("of"), F.col("time").alias("since"), "best")
    met = once.join(known, (F.col("application_id") == F.col("entity")) & (F.col("feature") == F.col("of")) & (F.col("since") <= F.col("time")), "left")
    best = met.groupBy(*keys, "decision_at", "time", "copies").agg(F.max("best").alias("x"))
    best = best.select(*keys, "decision_at", "time", "x", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("col")
    if crowds:
        best = best.unionByName(_merged(slots(crowds[0]), records(crowds[1]), keys, "x"))
    fresh = F.col("x.event_at") >= F.col("time") - F.expr(f"interval {max_age_days} days")
    status = F.when(F.col("x").isNull(), "no_history").when(F.col("x.deleted"), "deleted").when(fresh, "selected").otherwise("stale")
    return best.select("application_id", "decision_at", "feature", status.alias("status"), "x.*")


def feature_lineage(slots: DataFrame) -> DataFrame:
    """The record, revision and times behind each selected value."""
    return slots.filter("status = 'selected'").select("application_id", "decision_at", "feature", "value", "source", "record_id", "revision", "event_at", "published_at", "ingested_at", "available_at")


def future_observations(decisions: DataFrame, observations: DataFrame) -> DataFrame:
    """How many observations of each decision's entity there are, and how many were not yet available at the end of its day.

    Decisions whose entity has none are left out.
    """
    known = observations.select(F.col("entity_id").alias("application_id"), F.greatest("published_at", "ingested_at").alias("time"))
    end_of_day = F.expr("cast(date_add(decision_at, 1) as timestamp) - interval 1 microsecond")
    asked = decisions.select("application_id", "decision_at")
    (few, some), crowds = _parted(_crowded(asked, known, "application_id"), "application_id", asked, known)
    once = few.groupBy("application_id", "decision_at").agg(F.count("*").alias("copies"))
    # A record without a time is never available.
    late = F.count_if(~F.coalesce(F.col("time") <= end_of_day, F.lit(False))).alias("future")
    met = once.join(some, "application_id").groupBy("application_id", "decision_at", "copies").agg(F.count("*").alias("observations"), late)
    out = met.select("application_id", "decision_at", "observations", "future", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("col")
    if crowds:
        asked, known = crowds
        totals = known.groupBy("application_id").agg(F.count("*").alias("observations"))
        records = known.filter("time is not null").select("application_id", "time", F.lit(1).cast("long").alias("best"))
        seen = _merged(asked.withColumn("time", end_of_day), records, ("application_id",), "seen", summed=True)
        future = (F.col("observations") - F.coalesce("seen", F.lit(0))).alias("future")
        out = out.unionByName(seen.join(totals, "application_id").select("application_id", "decision_at", "observations", future))
    return out


def first_late_arrival(apps: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """Per decision and feature without a decision-time value: the earliest late arrival of a pre-decision observation, else of a later one."""
    seen = apps.select("application_id", "decision_at").join(events, "application_id").filter(F.col("available_at") <= as_of)
    before = F.col("observed_at") <= F.col("decision_at")
    timely = before & (F.col("available_at") <= F.col("decision_at"))
    out = seen.groupBy("application_id", "decision_at", "name").agg(F.max(timely).alias("timely"), F.min(F.when(before, F.col("available_at"))).alias("late"), F.min("available_at").alias("any"))
    return out.filter("not timely").select("application_id", "decision_at", "name", F.coalesce("late", "any").alias("available_at"), F.col("late").isNotNull().alias("observed_before"))


def compare_naive(apps: DataFrame, events: DataFrame) -> DataFrame:
    """Slots of each decision whose latest value of all differs from the value known at the decision."""
    events = stored(events.select("application_id", "name", "value", "observed_at", "available_at"), "events")
    asked = apps.select("application_id", "decision_at")
    (few, some), crowds = _parted(_crowded(asked, events, "application_id"), "application_id", asked, events)
    timely = (F.col("available_at") <= F.col("decision_at")) & (F.col("observed_at") <= F.col("decision_at"))
    naive = F.max_by("value", "available_at").alias("naive_value")
    known = F.max(F.when(timely, F.struct("available_at", "observed_at", "value")))["value"].alias("known_value")
    both = few.join(some, "application_id").groupBy("application_id", "decision_at", "name").agg(naive, known)
    if crowds:
        asked, events = crowds
        late = asof_latest(asked, events).select("application_id", "decision_at", "name", F.col("value").alias("known_value"))
        slots = asked.distinct().join(events.groupBy("application_id", "name").agg(naive), "application_id")
        both = both.unionByName(slots.join(late, ["application_id", "decision_at", "name"], "left").select(*both.columns))
    return both.filter(~F.col("naive_value").eqNullSafe(F.col("known_value")))
