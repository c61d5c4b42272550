"""Aggregates of cohorts: portfolio rows, grouping scopes, policies and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import global_rank, rank_buckets, with_total

#: Groups of the policy table.
GROUPS = ("vintage", "segment")


def _exposure() -> Column:
    """Cents times probability, exact."""
    return F.col("principal_cents").cast("decimal(24,0)") * F.col("calibrated_pd")


def portfolio_columns(lgd: str) -> list[Column]:
    events = F.sum("label")
    scale = F.lit(lgd).cast("double") / 100
    lost = F.sum(F.when(F.col("label") == 1, F.col("principal_cents")).otherwise(0)).cast("double")
    return [
        F.count("*").alias("loans"),
        events.cast("long").alias("events"),
        F.round(events.cast("double") / F.count("*"), 8).alias("event_rate"),
        F.round(F.sum("calibrated_pd").cast("double") / F.count("*"), 8).alias("mean_pd"),
        F.sum("principal_cents").cast("long").alias("principal_cents"),
        F.round(F.sum(_exposure()).cast("double") * scale, 2).alias("scenario_expected_loss_usd"),
        F.round(lost * scale, 2).alias("scenario_event_loss_proxy_usd"),
    ]


def portfolio_aggregate(predictions: DataFrame, lgd: str = "0.45") -> DataFrame:
    return predictions.agg(*portfolio_columns(lgd))


def vintage_metrics(predictions: DataFrame, lgd: str = "0.45") -> DataFrame:
    return predictions.groupBy("vintage").agg(*portfolio_columns(lgd))


def risk_deciles(predictions: DataFrame, lgd: str = "0.45", n: int = 10) -> DataFrame:
    ranked = rank_buckets(predictions, n, "calibrated_pd", "application_id", "decile")
    return ranked.groupBy("decile").agg(*portfolio_columns(lgd))


def cohort_rollup(predictions: DataFrame, lgd: str = "0.45") -> DataFrame:
    """Portfolio, month, segment and month by segment in one pass, with the change against the month before."""
    hit = F.sum(F.col("review_selected") * F.col("label")).cast("long")
    grouped = predictions.groupingSets([[], ["vintage"], ["segment"], ["vintage", "segment"]], "vintage", "segment").agg(
        *portfolio_columns(lgd),
        F.round(F.sum(_exposure()).cast("double") / F.sum("principal_cents").cast("double"), 8).alias("exposure_weighted_pd"),
        (F.sum("label").cast("double") / F.count("*")).alias("rate"),
        (F.sum("calibrated_pd").cast("double") / F.count("*")).alias("pd"),
        F.sum("review_selected").cast("long").alias("reviewed"),
        hit.alias("reviewed_events"),
        F.grouping_id("vintage", "segment").alias("g"),
    )
    scope = F.when(F.col("g") == 3, "portfolio").when(F.col("g") == 1, "vintage").when(F.col("g") == 2, "segment").otherwise("vintage_segment")
    named = grouped.withColumn("scope", scope).withColumn("vintage", F.coalesce("vintage", F.lit("all"))).withColumn("segment", F.coalesce("segment", F.lit("all")))
    previous = F.lag("rate").over(Window.partitionBy("scope", "segment").orderBy("vintage"))
    out = named.withColumn("previous", F.when(F.col("scope").isin("vintage", "vintage_segment"), previous))
    ratio = lambda a, b: F.round(F.col(a).cast("double") / F.nullif(F.col(b), F.lit(0)), 8)
    return out.select(
        "scope", "vintage", "segment", "loans", "events", "event_rate", "mean_pd", F.round(F.col("rate") - F.col("pd"), 8).alias("event_pd_gap"), "principal_cents", "exposure_weighted_pd", "reviewed", "reviewed_events",
        ratio("reviewed", "loans").alias("review_share"), ratio("reviewed_events", "reviewed").alias("review_precision"), ratio("reviewed_events", "events").alias("event_capture"),
        F.round("previous", 8).alias("previous_event_rate"), F.round(F.col("rate") - F.col("previous"), 8).alias("event_rate_change"), "scenario_expected_loss_usd", "scenario_event_loss_proxy_usd",
    )


def budget_bands(scores: DataFrame, outcomes: DataFrame, each: tuple[str, ...] = (), groups: tuple[str, ...] = ()) -> DataFrame:
    """Rows, events and the events' cents of each method, group and ``band``: the least whole percent whose budget takes the row.

    Labels are joined after ranking.  A hundred bands a group at most, so what is taken at any capacity follows from a few rows, and all tables of budgets from one order.
    """
    keys = (*each, "method")
    columns = [*each, "application_id", "label", *groups, *(["principal_cents"] if "principal_cents" in outcomes.columns else [])]
    ranked = with_total(global_rank(scores, "score", "application_id", keys), keys)
    # A budget takes rank <= (n * percent + 99) div 100, which is percent >= (100 * rank - 99) / n.
    band = F.expr("(100 * rank - 100 + __n) div __n").cast("int").alias("band")
    rows = ranked.select(*keys, "application_id", band).join(outcomes.select(*columns), [*each, "application_id"])
    cents = [F.sum(F.col("label") * F.col("principal_cents")).alias("event_cents")] if "principal_cents" in columns else []
    return rows.groupBy(*keys, *groups, "band").agg(F.count("*").alias("rows"), F.sum("label").cast("long").alias("events"), *cents)


def budget_table(scores: DataFrame, outcomes: DataFrame, capacities: DataFrame, each: tuple[str, ...] = (), bands: DataFrame | None = None) -> DataFrame:
    """Method by capacity (whole percents): reviewed, captured, precision and capture.

    ``each`` are columns of scores and outcomes, such as the seed of a repeat, that have budgets of their own; ``bands`` are those of ``budget_bands``, if they are there already.
    """
    bands = budget_bands(scores, outcomes, each) if bands is None else bands
    chosen = bands.crossJoin(F.broadcast(capacities)).filter("band <= percent")
    total = outcomes.groupBy(*each).agg(F.sum("label").cast("long").alias("total_events"))
    out = chosen.groupBy(*each, "method", "percent").agg(F.sum("rows").alias("reviewed"), F.sum("events").cast("long").alias("captured"))
    out = out.join(total, list(each)) if each else out.crossJoin(F.broadcast(total))
    return out.select(
        *each, "method", "percent", "reviewed", "captured", "total_events", F.round(F.col("captured") / F.nullif(F.col("reviewed"), F.lit(0)), 8).alias("precision"), F.round(F.col("captured") / F.nullif(F.col("total_events"), F.lit(0)), 8).alias("capture")
    )


def capacity_policy_table(scores: DataFrame, outcomes: DataFrame, capacities: DataFrame, review_cost_cents: int = 2500, bands: DataFrame | None = None) -> DataFrame:
    """Method by capacity (whole percents) by group (all, month, segment), with what the review finds, misses and costs.

    ``bands`` are those of ``budget_bands`` by ``GROUPS``, if they are there already.
    """
    bands = budget_bands(scores, outcomes, (), GROUPS) if bands is None else bands
    rows = bands.crossJoin(F.broadcast(capacities)).withColumn("taken", (F.col("band") <= F.col("percent")).cast("int"))
    caught = F.sum(F.col("taken") * F.col("events")).cast("long")
    taken, events = F.sum(F.col("taken") * F.col("rows")).cast("long"), F.sum("events").cast("long")
    sums = rows.groupingSets([["method", "percent"], ["method", "percent", "vintage"], ["method", "percent", "segment"]], "method", "percent", "vintage", "segment").agg(
        F.sum("rows").alias("applications"),
        events.alias("events"),
        taken.alias("reviewed"),
        caught.alias("captured_events"),
        (taken - caught).alias("false_positives"),
        (events - caught).alias("missed_events"),
        F.round(caught / F.nullif(taken, F.lit(0)), 8).alias("precision"),
        F.round(caught / F.nullif(events, F.lit(0)), 8).alias("capture"),
        (taken * review_cost_cents).alias("review_cost_cents"),
        F.sum(F.col("taken") * F.col("event_cents")).cast("long").alias("captured_exposure_cents"),
        F.grouping_id("method", "percent", "vintage", "segment").alias("g"),
    )
    kind = F.when(F.col("g") == 3, "portfolio").when(F.col("g") == 1, "vintage").otherwise("segment")
    return sums.withColumn("group_type", kind).withColumn("group", F.coalesce("vintage", "segment", F.lit("all"))).drop("vintage", "segment", "g")


def preflight(staged: DataFrame, stages: DataFrame, apps: DataFrame) -> DataFrame:
    """Applications and outcomes of each of ``stages``, from labelled snapshots, and how many of ``apps`` lie in no window."""
    counts = staged.groupBy("stage").agg(
        F.count("*").alias("applications"),
        F.count_if(F.col("label") == 1).alias("events"),
        F.count_if(F.col("label") == 0).alias("non_events"),
        F.count_if(F.col("label").isNull()).alias("unlabelled"),
    )
    # Stages are a few rows.
    windows = F.broadcast(stages.select("start_at", "end_at"))
    outside = apps.join(windows, F.col("decision_at").between(F.col("start_at"), F.col("end_at")), "left_anti").agg(F.count("*").alias("outside_windows"))
    return stages.select("stage").join(counts, "stage", "left").fillna(0).crossJoin(F.broadcast(outside))


def preflight_monitor(staged: DataFrame, stages: DataFrame, apps: DataFrame, as_of: Column, current: str = "test") -> DataFrame:
    """``preflight`` of all stages but the ``current`` one, and that one's applications by whether they are visible; its outcomes are not read."""
    of_others = preflight(staged, stages, apps).filter(F.col("stage") != current)
    window = F.broadcast(stages.filter(F.col("stage") == current).select("stage", "start_at", "end_at"))
    inside = apps.join(window, F.col("decision_at").between(F.col("start_at"), F.col("end_at")))
    visible = inside.groupBy("stage").agg(F.count_if(F.col("decision_at") <= as_of).alias("applications"), F.count_if(F.col("decision_at") > as_of).alias("not_yet_visible"))
    own = stages.filter(F.col("stage") == current).select("stage").join(visible, "stage", "left").fillna(0)
    return of_others.unionByName(own, allowMissingColumns=True)


def describe_numeric(tall: DataFrame) -> DataFrame:
    return tall.groupBy("name").agg(F.count("value").alias("count"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.round(F.avg("value"), 6).alias("mean"))


def repeat_summary(results: DataFrame, by: str | tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    """Mean, least and greatest of each metric over repeats."""
    return results.groupBy(*([by] if isinstance(by, str) else by)).agg(*(f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", lambda c: F.round(F.avg(c), 8)), ("min", F.min), ("max", F.max))))


def distinct_counts(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.count_distinct("vintage").alias("vintages"), F.count_distinct("application_id").alias("applications"), F.min("vintage").alias("first"), F.max("vintage").alias("last"))
