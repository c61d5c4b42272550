"""Whole evaluations of scored rows, each as one wide table whose ``section`` tells what a row holds."""

from __future__ import annotations

from contextlib import AbstractContextManager, nullcontext
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import drift, features, metrics, models, ranking, rollup
from tidemark.sources.shared import stored

#: What the composed studies compare others with.
BASELINE = "constant"


def sections(**parts: DataFrame) -> DataFrame:
    """The parts under each other by column name; what a part doesn't have is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (rows.withColumn("section", F.lit(name)) for name, rows in parts.items()))


def evaluate(predictions: DataFrame, percent: int, replicates: int, seed: int, lgd: str = "0.45") -> DataFrame:
    """Quality with bootstrap intervals, queue, portfolio, months and deciles of labelled predictions.

    The queue takes the first ``percent`` by calibrated score.  ``predictions`` are read by every section: hand over a stored table.
    """
    score = lambda c, name: predictions.select("label", "vintage", F.lit(name).alias("method"), F.col(c).alias("score"))
    both = score("raw_pd", "logistic").unionByName(score("calibrated_pd", "isotonic"))
    draws = metrics.bootstrap_draws(predictions, replicates, seed)
    resampled = metrics.block_bootstrap(both, draws, "score", "label", ("method",))
    quality = metrics.quality(both, "score", "label", ("method",)).join(metrics.quantile_interval(resampled, "auc", ("method",)), "method")
    return sections(
        quality=quality,
        queue=metrics.precision_capture(predictions, percent, "calibrated_pd", "application_id"),
        portfolio=rollup.portfolio_aggregate(predictions, lgd),
        vintage=rollup.vintage_metrics(predictions, lgd),
        decile=rollup.risk_deciles(predictions, lgd),
    )


def compare(scores: DataFrame, outcomes: DataFrame, capacities: DataFrame, replicates: int, seed: int, reference: str) -> DataFrame:
    """Every method at every capacity over all rows, months and segments; whole-portfolio rows carry the paired interval against ``reference``."""
    ranked = ranking.global_rank(scores, "score", "application_id", ("method",)).join(outcomes.select("application_id", "label", "vintage"), "application_id")
    captured = metrics.capture_bootstrap(ranked, metrics.bootstrap_draws(outcomes, replicates, seed), capacities)
    gaps = metrics.quantile_interval(metrics.paired_difference(captured, reference), "difference", ("method", "percent")).withColumn("group_type", F.lit("portfolio"))
    return rollup.capacity_policy_table(scores, outcomes, capacities).join(gaps, ["method", "percent", "group_type"], "left")


def quality_and_budgets(scores: DataFrame, outcomes: DataFrame, capacities: DataFrame, each: tuple[str, ...] = ()) -> DataFrame:
    """Each method's quality beside what it captures at each capacity; ``each`` are repeats, as in ``rollup.budget_table``."""
    keys = [*each, "method"]
    quality = metrics.quality(scores.join(outcomes.select(*each, "application_id", "label"), [*each, "application_id"]), "score", "label", tuple(keys))
    return rollup.budget_table(scores, outcomes, capacities, each).join(quality, keys)


def drift_report(reference: DataFrame, current: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Distance of every input from its reference, over all current rows (``all``) and by month.

    Both sides are ``(application_id, vintage, segment, name, value)``, a row a known number.  Shares of segments count each application once.
    """
    months = current.withColumn("vintage", F.explode(F.array(F.lit("all"), F.col("vintage"))))
    ks = drift.ks_distance(reference, months, "value", ("vintage",), ("name",)).select(F.col("name").alias("feature"), "vintage", F.lit("empirical_ks_distance").alias("method"), "distance", "at_value", "status")
    means = months.groupBy(F.col("name").alias("feature"), "vintage").agg(F.count("*").alias("current_count"), F.round(F.avg("value"), 6).alias("current_mean"))
    base = reference.groupBy(F.col("name").alias("feature")).agg(F.count("*").alias("reference_count"), F.round(F.avg("value"), 6).alias("reference_mean"))
    numbers = ks.join(means, ["feature", "vintage"]).join(base, "feature")
    once = lambda rows: rows.select("application_id", "vintage", "segment").distinct()
    shares = drift.total_variation(once(reference), once(months), "segment", kinds, ("vintage",))
    sizes = once(months).groupBy("vintage").agg(F.count("*").alias("current_count")).crossJoin(F.broadcast(once(reference).agg(F.count("*").alias("reference_count"))))
    enough = F.col("current_count") >= drift.MINIMUM_ROWS
    kept = shares.join(sizes, "vintage").select(
        F.lit("segment").alias("feature"), "vintage", F.lit("total_variation_distance").alias("method"), F.when(enough, F.col("distance")).alias("distance"), F.when(enough, "ok").otherwise("insufficient_sample").alias("status"),
        "current_count", "reference_count",
    )
    return numbers.unionByName(kept, allowMissingColumns=True)


def score_drift(reference: DataFrame, current: DataFrame, score: str) -> DataFrame:
    """PSI over all current rows (``all``) and by month, and beside the whole its bins."""
    months = current.withColumn("vintage", F.explode(F.array(F.lit("all"), F.col("vintage"))))
    bins = drift.psi_bins(reference, current, score).select("bin", "reference_loans", "current_loans", "reference_share", "current_share", F.round("component", 8).alias("psi_component"))
    return sections(psi=drift.psi(reference, months, score, ("vintage",)), bin=bins)


def fitted(train: DataFrame, calibration: DataFrame, rows: DataFrame, numbers: tuple[str, ...], kinds: tuple[str, ...] = (), trees: bool = True, seed: int = 7, leaf: int = 20, turn: AbstractContextManager | None = None) -> DataFrame:
    """``(application_id, method, score)`` of ``rows`` by the constant, logistic, isotonic and, if asked for, boosted-tree methods.

    ``numbers`` are complete numeric columns, standardised by the training rows;
    ``kinds`` are categories, one-hot by those of the training rows.  Every table has ``application_id`` and ``label`` and is read several times:
    hand over stored tables.  Only the training rows' moments are stored here, not the rows again.  Fits side by side take turns by ``turn`` to read rows.
    """
    from pyspark.ml.feature import VectorAssembler

    turn = turn or nullcontext()
    with turn:
        encoder = models.one_hot(train, kinds) if kinds else None
        stats = stored(features.moments(train, numbers), "moments")
    assembler = VectorAssembler(inputCols=[*numbers, *(f"{k}_vector" for k in kinds)], outputCol="features")

    def ready(part: DataFrame) -> DataFrame:
        scaled = features.standardize(train, part, numbers, stats)
        return assembler.transform(encoder.transform(scaled) if encoder else scaled).select("application_id", "label", "features")

    learned = ready(train)
    with turn:
        logistic = models.fit_logistic(learned)
        isotonic = models.fit_isotonic(models.raw_scores(logistic, ready(calibration)))
    raw = models.raw_scores(logistic, ready(rows))
    found = {BASELINE: models.constant(train, rows.select("application_id")), "logistic": raw, "isotonic": models.calibrated(isotonic, raw).drop("raw_pd").withColumnRenamed("calibrated_pd", "raw_pd")}
    if trees:
        found["boosted_trees"] = models.raw_scores(models.fit_trees(learned, leaf=leaf, seed=seed, turn=turn), ready(rows))
    return named(found)


def explained(train: DataFrame, rows: DataFrame, scores: DataFrame) -> DataFrame:
    """What each input adds to the log odds of ``rows`` by the logistic model of ``train``, and how far the sums are from its ``scores``.

    Section ``explanation`` has a row for each row and input, with the baseline's
    log odds; section ``rebuild`` counts the rows and has the greatest distance.
    """
    model = models.fit_logistic(stored(models.matrix(train, train), "learned"))
    *weights, (_, baseline) = models.fit_audit(model)
    inputs = features.design_matrix(train)
    moments = inputs.agg(*(x for i, (n, _) in enumerate(weights) for x in (F.avg(n).alias(f"mean_{i}"), F.stddev_pop(n).alias(f"scale_{i}"))))
    listed = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("coef"), F.col(f"mean_{i}").alias("mean"), F.when(F.col(f"scale_{i}") == 0, 1.0).otherwise(F.col(f"scale_{i}")).alias("scale"), F.lit(i).alias("ord")) for i, (n, w) in enumerate(weights)))
    # One row an input.
    coefficients = stored(moments.select(F.explode(listed).alias("x")).select("x.*"), "coefficients")
    parts = stored(features.contributions(features.design_matrix(rows), coefficients, tuple(n for n, _ in weights)), "contributions")
    again = features.rebuilt_probability(parts, baseline).join(scores.select("application_id", F.col("score").cast("double").alias("score")), "application_id")
    gap = again.agg(F.count("*").alias("applications"), F.max(F.abs(F.col("probability") - F.col("score"))).alias("greatest_gap"))
    return sections(explanation=parts.withColumnRenamed("name", "feature").withColumn("baseline_log_odds", F.lit(baseline)), rebuild=gap)


def named(found: dict[str, DataFrame]) -> DataFrame:
    """The methods' ``raw_pd`` as one table of scores."""
    each = (rows.select("application_id", F.lit(name).alias("method"), F.col("raw_pd").cast("decimal(12,10)").alias("score")) for name, rows in found.items())
    return reduce(DataFrame.unionByName, each)


def scorecard(train: DataFrame, rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``rows`` scored by a logistic model on the weights of evidence of ``names``."""
    from pyspark.ml.feature import VectorAssembler

    cuts = stored(features.woe_cuts(train, names), "cuts")
    bins = stored(features.woe_bins(train, cuts, names), "bins")
    assembler = VectorAssembler(inputCols=list(names), outputCol="features")

    def moved(part: DataFrame) -> DataFrame:
        tall = features.woe_transform(part, cuts, bins, names)
        return tall.groupBy("application_id").agg(*(F.max(F.when(F.col("name") == n, F.col("woe"))).alias(n) for n in names))

    own = moved(train)
    learned = assembler.transform(features.standardize(own, own, names)).join(train.select("application_id", "label"), "application_id")
    return models.raw_scores(models.fit_logistic(stored(learned, "learned")), assembler.transform(features.standardize(own, moved(rows), names)))
