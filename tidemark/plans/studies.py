"""Composed jobs: evaluation, monitoring, comparisons, split studies, lineage and the recheck of published tables.

Each job chains the operators that its users would call in turn, and returns one wide table.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import AbstractContextManager, nullcontext
from functools import reduce
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import asof, contracts, coverage, drift, features, loans, metrics, models, published, ranking, reconcile, rollup, study
from tidemark.plans import known_then as K
from tidemark.plans import records as R
from tidemark.plans import scores as S
from tidemark.plans.jobs import SEEDS, complete, monitored, of_stage
from tidemark.plans.registry import Tables, query
from tidemark.sources import tables
from tidemark.sources.shared import shared_path, step, stored

KINDS = ("retail", "small_business")
PERCENT = 10


@query("")
def e01_evaluate(t: Tables):
    """Stage cohorts, the stage gate, the frozen models, and the evaluation of their test rows."""
    gate = contracts.stage_gate(K.cohorts(t), t.stages)
    test = stored(models.frozen_stages(complete(t)), "frozen")
    return study.evaluate(test, PERCENT, S.REPLICATES, S.SEED).unionByName(gate.withColumn("section", F.lit("gate")), allowMissingColumns=True)


@query("")
def e04_score_monitor(t: Tables):
    """A model of the training rows scores the calibration stage and the visible current cohort: PSI of the whole with its bins, and by month."""
    reference, current = monitored(t)
    return study.score_drift(reference, current, "raw_pd")


INPUTS = f"""{K.ASOF}, seen AS (SELECT application_id, principal_cents, segment, stage, strftime(decision_at, '%Y-%m') AS vintage FROM applications JOIN stages ON decision_at BETWEEN start_at AND end_at WHERE stage <> 'train' AND decision_at <= {K.CUT}
), inputs AS (SELECT s.*, name, value FROM seen s JOIN asof_values USING (application_id) UNION ALL SELECT s.*, 'principal_usd', principal_cents / 100 FROM seen s
), ref AS (SELECT * FROM inputs WHERE stage = 'calibration'), cur AS (SELECT * REPLACE (unnest([vintage, 'all']) AS vintage) FROM inputs WHERE stage = 'test'
), pts AS (SELECT name, vintage, value, sum(r) AS r, sum(c) AS c FROM (
    SELECT g.name, g.vintage, value, 1 AS r, 0 AS c FROM (SELECT DISTINCT name, vintage FROM cur) g JOIN ref ON ref.name = g.name UNION ALL SELECT name, vintage, value, 0, 1 FROM cur) GROUP BY ALL
), cum AS (SELECT name, vintage, value, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER (PARTITION BY name, vintage) AS n, sum(c) OVER (PARTITION BY name, vintage) AS m FROM pts WINDOW w AS (PARTITION BY name, vintage ORDER BY value)
), best AS (SELECT *, row_number() OVER (PARTITION BY name, vintage ORDER BY abs(cr * m - cc * n) DESC, value) AS place FROM cum
), kinds AS (SELECT unnest(['retail', 'small_business']) AS segment), apps AS (SELECT segment, vintage, stage FROM seen WHERE stage = 'calibration' UNION ALL SELECT segment, unnest([vintage, 'all']), stage FROM seen WHERE stage = 'test'
), sizes AS (SELECT vintage, count(*) AS m, (SELECT count(*) FROM apps WHERE stage = 'calibration') AS n FROM apps WHERE stage = 'test' GROUP BY vintage
), gaps AS (SELECT vintage, m, n, abs((SELECT count(*) FROM apps a WHERE a.stage = 'calibration' AND a.segment = kinds.segment) * m - (SELECT count(*) FROM apps a WHERE a.stage = 'test' AND a.segment = kinds.segment AND a.vintage = sizes.vintage) * n) AS gap FROM sizes CROSS JOIN kinds)"""


@query(
    "applications feature_events stages",
    f"""{INPUTS} SELECT b.name AS feature, b.vintage, 'empirical_ks_distance' AS method, CASE WHEN m >= 20 THEN round(CAST(abs(cr * m - cc * n) AS DOUBLE) / (CAST(n AS DOUBLE) * m), 6) END AS distance, b.value AS at_value,
      CASE WHEN m >= 20 THEN 'ok' ELSE 'insufficient_sample' END AS status, CAST(m AS BIGINT) AS current_count, current_mean, CAST(n AS BIGINT) AS reference_count, reference_mean
    FROM best b JOIN (SELECT name, vintage, round(avg(value), 6) AS current_mean FROM cur GROUP BY ALL) c ON c.name = b.name AND c.vintage = b.vintage JOIN (SELECT name, round(avg(value), 6) AS reference_mean FROM ref GROUP BY name) r ON r.name = b.name WHERE place = 1
    UNION ALL SELECT 'segment', vintage, 'total_variation_distance', CASE WHEN max(m) >= 20 THEN round(CAST(sum(gap) AS DOUBLE) / (2 * CAST(max(n) AS DOUBLE) * max(m)), 6) END, NULL, CASE WHEN max(m) >= 20 THEN 'ok' ELSE 'insufficient_sample' END, max(m), NULL, max(n), NULL FROM gaps GROUP BY vintage""",
)
def e05_input_drift(t: Tables):
    """Inputs known at the decisions of the visible current cohort against the calibration stage's; no labels, no model."""
    visible = asof.in_stages(t.applications.select(*K.APPS), t.stages).filter((F.col("stage") != "train") & (F.col("decision_at") <= K.day()))
    about = visible.select("application_id", "stage", "segment", "principal_cents", F.date_format("decision_at", "yyyy-MM").alias("vintage"))
    known = about.join(asof.asof_latest(visible, t.feature_events).select("application_id", "name", "value"), "application_id")
    inputs = stored(known.unionByName(about.withColumns({"name": F.lit("principal_usd"), "value": F.col("principal_cents") / 100})).drop("principal_cents"), "inputs")
    return study.drift_report(of_stage(inputs, "calibration"), of_stage(inputs, "test"), KINDS)


COHORT_COLUMNS = """scope, v AS vintage, g AS segment, loans, events, event_rate, mean_pd, round(rate - pd, 8) AS event_pd_gap, principal_cents, exposure_weighted_pd, reviewed, reviewed_events,
    round(CAST(reviewed AS DOUBLE) / loans, 8) AS review_share, round(CAST(reviewed_events AS DOUBLE) / nullif(reviewed, 0), 8) AS review_precision, round(CAST(reviewed_events AS DOUBLE) / nullif(events, 0), 8) AS event_capture,
    round(previous, 8) AS previous_event_rate, round(rate - previous, 8) AS event_rate_change, scenario_expected_loss_usd, scenario_event_loss_proxy_usd"""


def review_queue(predictions: DataFrame) -> DataFrame:
    return ranking.global_rank(predictions.filter("review_selected = 1").drop("label", "review_selected"), "calibrated_pd", "application_id", name="review_rank")


@query(
    "predictions",
    f"""{S.COHORT_SQL}, cohort AS (SELECT {COHORT_COLUMNS} FROM changed), queue AS (SELECT row_number() OVER (ORDER BY calibrated_pd DESC, application_id) AS review_rank, * FROM predictions WHERE review_selected = 1
    ), queued AS (SELECT scope, CASE WHEN scope LIKE 'vintage%' THEN vintage ELSE 'all' END AS vintage, CASE WHEN scope LIKE '%segment' THEN segment ELSE 'all' END AS segment, count(*) AS queue_rows, CAST(sum(principal_cents) AS BIGINT) AS queue_cents, min(review_rank) AS first_rank, max(review_rank) AS last_rank
      FROM queue, (SELECT unnest(['portfolio', 'vintage', 'segment', 'vintage_segment']) AS scope) GROUP BY ALL)
    SELECT c.*, coalesce(queue_rows, 0) AS queue_rows, coalesce(queue_cents, 0) AS queue_cents, first_rank, last_rank, CAST(0 AS BIGINT) AS differences FROM cohort c LEFT JOIN queued q ON q.scope = c.scope AND q.vintage = c.vintage AND q.segment = c.segment""",
)
def e08_cohorts_and_queue(t: Tables):
    """Every cohort beside its part of the review queue, and how many cohorts the queue's own counts contradict."""
    cohorts, queue = stored(rollup.cohort_rollup(t.predictions), "cohorts"), stored(review_queue(t.predictions), "queue")
    parts = queue.groupingSets([[], ["vintage"], ["segment"], ["vintage", "segment"]], "vintage", "segment").agg(
        F.grouping_id("vintage", "segment").alias("g"), F.count("*").alias("queue_rows"), F.sum("principal_cents").cast("long").alias("queue_cents"), F.min("review_rank").alias("first_rank"), F.max("review_rank").alias("last_rank")
    )
    scope = F.when(F.col("g") == 3, "portfolio").when(F.col("g") == 1, "vintage").when(F.col("g") == 2, "segment").otherwise("vintage_segment")
    named = parts.select(scope.alias("scope"), F.coalesce("vintage", F.lit("all")).alias("vintage"), F.coalesce("segment", F.lit("all")).alias("segment"), "queue_rows", "queue_cents", "first_rank", "last_rank")
    keys = ("scope", "vintage", "segment")
    off = reconcile.reconcile(named.select(*keys, F.col("queue_rows").alias("reviewed")), cohorts.filter("reviewed > 0").select(*keys, "reviewed"), keys)
    return cohorts.join(named, list(keys), "left").fillna(0, ["queue_rows", "queue_cents"]).crossJoin(F.broadcast(off.agg(F.count("*").alias("differences"))))


@query("")
def e09_same_budget_comparison(t: Tables):
    """Six methods fitted on the training stage meet the same test rows and budgets; intervals are against the business rule.

    Beside the policies are what each input adds to the raw logistic score, and that these parts rebuild it.
    """
    known = stored(features.design_matrix(complete(t)), "known")
    train, calibration, test = (of_stage(known, s) for s in ("train", "calibration", "test"))
    rule = test.select("application_id", features.business_rule(*map(F.col, S.NAMES)).alias("raw_pd"))
    found = study.named({"business_rule": rule, "woe_scorecard": study.scorecard(train, test, models.INPUTS)})
    scores = stored(study.fitted(train, calibration, test, models.INPUTS, leaf=30).unionByName(found), "scores")
    outcomes = test.select("application_id", "label", F.date_format("decision_at", "yyyy-MM").alias("vintage"), "segment", "principal_cents")
    policies = study.compare(scores, outcomes, t.capacities, S.REPLICATES, S.SEED, "business_rule")
    quality = metrics.quality(scores.join(outcomes.select("application_id", "label"), "application_id"), "score", "label", ("method",))
    reasons = study.explained(train, test, scores.filter("method = 'logistic'"))
    return policies.join(quality.select("method", "brier", "auc", "average_precision"), "method").withColumn("section", F.lit("policy")).unionByName(reasons, allowMissingColumns=True)


SPLIT_NUMBERS = ("utilization", "debt_to_income", "prior_delinquencies", "log_principal")


def labelled_risk(t: Tables, seeds: tuple[int, ...]) -> DataFrame:
    """What the split studies read, with each seed's stage: one stored table, however many seeds."""
    with step(t.spark):
        t = t.kept("risk")
        rows = features.design_matrix(t.risk.join(t.predictions.select("application_id", "label"), "application_id"))
        base = stored(rows.select("application_id", "label", "segment", *SPLIT_NUMBERS), "labelled")
        return stored(features.seeded_stages(base, "label", "application_id", seeds), "split", outlive=True)


def split_results(t: Tables, base: DataFrame, seed: int, turn: AbstractContextManager | None = None) -> DataFrame:
    """One seed's quality and budgets, a row a method and capacity.  What its fits and orders stored is deleted once they are there."""
    with step(t.spark):
        rows = base.select("application_id", "label", "segment", *SPLIT_NUMBERS, F.col(f"stage_{seed}").alias("stage"))
        train, calibration, test = (of_stage(rows, s) for s in ("train", "calibration", "test"))
        scores = study.fitted(train, calibration, test, SPLIT_NUMBERS, ("segment",), True, seed, turn=turn)
        with turn or nullcontext():
            found = study.quality_and_budgets(stored(scores, "scores"), test.select("application_id", "label"), t.capacities)
            return stored(found, "results", outlive=True)


@query("")
def e10_static_split_study(t: Tables):
    """One seeded split of decided applications: four methods' quality, and what each captures at each budget."""
    return split_results(t, labelled_risk(t, (20,)), 20)


@query("")
def e11_repeated_split_study(t: Tables):
    """The frozen seeds of the repeated study, four methods each, every result kept; rows without a seed have their mean, least and greatest."""
    base, turn = labelled_risk(t, SEEDS), Lock()
    # A fit is some hundreds of short jobs on cells, and the seeds' fill the cluster side by side; rows are read and ordered for one seed at a time.
    one = inheritable_thread_target(t.spark)(lambda seed: split_results(t, base, seed, turn).select(F.lit(seed).alias("seed"), "*"))
    with ThreadPoolExecutor(len(SEEDS)) as pool:
        every = stored(reduce(DataFrame.unionByName, pool.map(one, SEEDS)), "results")
    summary = rollup.repeat_summary(every, ("method", "percent"), ("auc", "average_precision", "brier", "captured", "capture"))
    return every.unionByName(summary, allowMissingColumns=True)


@query("")
def e12_dated_loan_study(t: Tables):
    """Charge-off scores of the prepared loans' test stage by four methods: quality, budgets, years, paired intervals, stages and exclusions."""
    judged = stored(R.judged_loans(t), "judged")
    base = stored(loans.firsts(loans.eligible(judged)), "loans")
    rows = base.join(loans.loan_features(base).select("record_id", "log_gross", "guaranteed_share"), "record_id").withColumnsRenamed({"record_id": "application_id", "chargeoff_24m": "label"})
    rows = stored(features.impute_median(of_stage(rows, "train"), rows, "rate"), "ready")
    train, calibration, test = (of_stage(rows, s) for s in ("train", "calibration", "test"))
    scores = stored(study.fitted(train, calibration, test, ("log_gross", "guaranteed_share", "rate", "rate_missing"), ("method",)), "scores")
    outcomes = stored(test.select("application_id", "label", F.date_format("funded_at", "yyyy-MM").alias("vintage"), F.year("funded_at").alias("year")), "outcomes")
    labelled = scores.join(outcomes, "application_id")
    draws = metrics.bootstrap_draws(outcomes, S.REPLICATES, S.SEED)
    paired = metrics.paired_metric(metrics.block_bootstrap(labelled, draws, "score", "label", ("method",)), "brier", study.BASELINE)
    return study.sections(
        budget=study.quality_and_budgets(scores, outcomes.select("application_id", "label"), t.capacities),
        year=metrics.quality(labelled, "score", "label", ("method", "year")),
        paired_brier=metrics.quantile_interval(paired, "difference", ("method",)),
        stage=loans.stage_summary(base),
        exclusion=loans.exclusion_audit(judged, base).withColumnRenamed("section", "audit"),
    )


@query(
    "scores outcomes capacities",
    f"""{S.BUDGET}, total AS (SELECT CAST(sum(label) AS BIGINT) AS total_events FROM outcomes)
    SELECT method, percent, count(*) AS reviewed, CAST(sum(label) AS BIGINT) AS captured, max(total_events) AS total_events, round(sum(label) / count(*), 8) AS precision, round(sum(label) / max(total_events), 8) AS capture, CAST(0 AS BIGINT) AS differences
    FROM chosen JOIN outcomes USING (application_id) CROSS JOIN total GROUP BY method, percent""",
)
def e13_budget_replay(t: Tables):
    """Budgets from saved scores, held against the sums of the saved queue that the same budgets select."""
    path = shared_path(t.spark, "queue")
    chosen = ranking.multi_budget(t.scores, t.capacities, "score", "application_id").select("method", "percent", "application_id")
    tables.write_table(chosen.join(t.outcomes.select("application_id", "label"), "application_id"), path, ("method", "percent", "application_id", "label"))
    saved = t.spark.read.parquet(path).groupBy("method", "percent").agg(F.count("*").alias("reviewed"), F.sum("label").cast("long").alias("captured"))
    table = stored(rollup.budget_table(t.scores, t.outcomes, t.capacities), "budgets")
    off = reconcile.reconcile(saved, table.select("method", "percent", "reviewed", "captured"), ("method", "percent"))
    return table.crossJoin(F.broadcast(off.agg(F.count("*").alias("differences"))))


@query("")
def e14_lineage_job(t: Tables):
    """From source records to evaluated predictions: slots by status, records not yet available, records behind the predictions, and their evaluation.

    Values come from the bitemporal slots; where a slot has none, the training
    median stands in, beside its flag.
    """
    t = t.kept("applications")
    slots = stored(asof.bitemporal(t.applications, t.observations, t.features), "slots")
    wide = asof.feature_pivot(slots.filter("status = 'selected'").select("application_id", "decision_at", F.col("feature").alias("name"), F.col("value").cast("double").alias("value")))
    staged = asof.in_stages(t.applications.select(*K.APPS), t.stages)
    known = asof.mature_outcomes(staged, t.of(staged).performance, F.col("cutoff"), ("cutoff",)).filter("label is not null").join(wide, ["application_id", "decision_at"], "left")
    known = stored(features.design_matrix(known), "known")
    for name in asof.FEATURES:
        known = features.impute_median(of_stage(known, "train"), known, name)
    known = stored(known.fillna(0.0, list(asof.FEATURES)), "filled")
    train, calibration, test = (of_stage(known, s) for s in ("train", "calibration", "test"))
    inputs = (*models.INPUTS, *(f"{n}_missing" for n in asof.FEATURES))
    scores = study.fitted(train, calibration, test, inputs, trees=False).groupBy("application_id").agg(*(F.max(F.when(F.col("method") == m, F.col("score"))).alias(c) for m, c in (("logistic", "raw_pd"), ("isotonic", "calibrated_pd"))))
    predictions = stored(test.select("application_id", "decision_at", F.date_format("decision_at", "yyyy-MM").alias("vintage"), "segment", "principal_cents", "label").join(scores, "application_id"), "predictions")
    behind = asof.feature_lineage(slots).join(predictions.select("application_id"), "application_id", "left_semi")
    future = asof.future_observations(t.applications, t.observations)
    return study.sections(
        slots=slots.groupBy("status", "feature").agg(F.count("*").alias("slots"), F.count("record_id").alias("records")),
        lineage=behind.groupBy("feature").agg(F.count("*").alias("slots"), F.count_distinct("record_id").alias("records"), F.max("available_at").alias("last_available")),
        future=future.agg(F.sum("observations").alias("records"), F.sum("future").alias("future_records")),
    ).unionByName(study.evaluate(predictions, PERCENT, S.REPLICATES, S.SEED), allowMissingColumns=True)


def coverage_part(read: dict[str, DataFrame]) -> DataFrame:
    return coverage.coverage_rollup(read["slots"])


def score_psi(read: dict[str, DataFrame]) -> DataFrame:
    rows = read["predictions"]
    return drift.psi(rows.filter("vintage < '1996-01'"), rows.filter("vintage >= '1997-06'"), "calibrated_pd", ("vintage",))


def uneven_scores(scores: DataFrame) -> DataFrame:
    """Ids that aren't scored three times.  What their scores are is looked at for these alone, which are few if any."""
    odd = scores.groupBy("application_id").agg(F.count("*").alias("rows")).filter("rows <> 3").select("application_id")
    return contracts.same_population(scores, ("score",), odd)


def bands(read: dict[str, DataFrame]) -> DataFrame:
    """What both tables of budgets follow from, made once for each set of tables."""
    if "budget bands" not in read:
        read["budget bands"] = stored(rollup.budget_bands(read["scores"], read["outcomes"], groups=rollup.GROUPS), "bands")
    return read["budget bands"]


#: Published tables by the published ones that they follow from, with their keys.
AGAIN = {
    "queue": (lambda r: review_queue(r["predictions"]), ("application_id",)),
    "portfolio": (lambda r: rollup.portfolio_aggregate(r["predictions"]).withColumn("scope", F.lit("portfolio")), ("scope",)),
    "vintages": (lambda r: rollup.vintage_metrics(r["predictions"]), ("vintage",)),
    "deciles": (lambda r: rollup.risk_deciles(r["predictions"]), ("decile",)),
    "cohorts": (lambda r: rollup.cohort_rollup(r["predictions"]), ("scope", "vintage", "segment")),
    "score_psi": (score_psi, ("vintage",)),
    "budgets": (lambda r: rollup.budget_table(r["scores"], r["outcomes"], r["capacities"], bands=bands(r)), ("method", "percent")),
    "policies": (lambda r: rollup.capacity_policy_table(r["scores"], r["outcomes"], r["capacities"], bands=bands(r)), ("method", "percent", "group_type", "group")),
    "coverage": (coverage_part, ("population", "vintage", "feature")),
}
EVIDENCE = {"predictions": ("application_id",), "scores": ("method", "application_id"), "outcomes": ("application_id",), "capacities": ("percent",), "slots": ("population", "application_id", "feature")}
RULES = {"predictions": lambda rows: rows.filter(contracts.valid_prediction().isNotNull()), "scores": uneven_scores}


def published_tables(t: Tables) -> published.Made:
    """The evidence, and what follows from it.  The evidence is stored, since nine tables are built from it, and so are the rows that it is derived from."""
    risk = t.kept("risk").kept("predictions")
    evidence = {"predictions": risk.predictions} | {n: stored(getattr(risk, n), "evidence") for n in ("scores", "outcomes", "capacities")} | {"slots": K.slots(t)}
    made: published.Made = {name: (rows, EVIDENCE[name]) for name, rows in evidence.items()}
    return made | {name: (build(evidence), keys) for name, (build, keys) in AGAIN.items()}


def recheck_folder(spark, path: str) -> DataFrame:
    """The recheck of a folder with the tables of ``published_tables``, whoever wrote it."""
    return published.recheck(spark, path, {name: build for name, (build, _) in AGAIN.items()}, RULES)


@query(
    "predictions scores outcomes capacities applications feature_events features stages",
    f"""{K.ROLLUP}, counts AS (SELECT 'predictions' AS name, count(*) AS rows FROM predictions UNION ALL SELECT 'scores', count(*) FROM scores UNION ALL SELECT 'outcomes', count(*) FROM outcomes UNION ALL SELECT 'capacities', count(*) FROM capacities
    UNION ALL SELECT 'slots', count(*) FROM slots UNION ALL SELECT 'coverage', count(*) FROM coverage UNION ALL SELECT 'score_psi', count(DISTINCT vintage) FROM predictions WHERE vintage >= '1997-06'
    UNION ALL SELECT 'queue', count(*) FILTER (WHERE review_selected = 1) FROM predictions UNION ALL SELECT 'portfolio', 1 UNION ALL SELECT 'vintages', count(DISTINCT vintage) FROM predictions
    UNION ALL SELECT 'deciles', least(count(*), 10) FROM predictions UNION ALL SELECT 'cohorts', 1 + count(DISTINCT vintage) + count(DISTINCT segment) + count(DISTINCT (vintage, segment)) FROM predictions
    UNION ALL SELECT 'budgets', (SELECT count(DISTINCT method) FROM scores) * (SELECT count(*) FROM capacities)
    UNION ALL SELECT 'policies', (SELECT count(DISTINCT method) FROM scores) * (SELECT count(*) FROM capacities) * (SELECT 1 + count(DISTINCT vintage) + count(DISTINCT segment) FROM outcomes))
    SELECT name, rows, true AS as_published, CAST(0 AS BIGINT) AS invalid_rows, CAST(0 AS BIGINT) AS differences FROM counts""",
)
def e16_recheck_published(t: Tables):
    """A folder is published, and rechecked from its manifest and tables alone."""
    path = shared_path(t.spark, "published")
    published.publish(published_tables(t), path)
    return recheck_folder(t.spark, path).drop("joined")


@query(
    "predictions scores outcomes capacities",
    f"""{S.BUDGET}, budgets AS (SELECT method, percent, count(*) AS reviewed, CAST(sum(label) AS BIGINT) AS captured FROM chosen JOIN outcomes USING (application_id) GROUP BY method, percent), {S.COHORT_SQL}
    SELECT 'budget' AS section, method, percent, NULL AS scope, NULL AS cohort, CAST(NULL AS BIGINT) AS loans, (SELECT CAST(sum(label) AS BIGINT) FROM outcomes) AS events, CAST(NULL AS BIGINT) AS principal_cents, reviewed, captured, round(captured / reviewed, 8) AS precision FROM budgets
    UNION ALL SELECT 'cohort', NULL, NULL, scope, CASE scope WHEN 'vintage' THEN v WHEN 'segment' THEN g ELSE 'all' END, loans, events, principal_cents, reviewed, reviewed_events, round(CAST(reviewed_events AS DOUBLE) / nullif(reviewed, 0), 8) FROM changed WHERE scope <> 'vintage_segment'""",
)
def e17_aggregate_brief(t: Tables):
    """Budgets of every method and totals of every cohort of one kind; no row of a single case."""
    budgets = rollup.budget_table(t.scores, t.outcomes, t.capacities).select("method", "percent", F.col("total_events").alias("events"), "reviewed", "captured", "precision")
    cohort = F.when(F.col("scope") == "vintage", F.col("vintage")).when(F.col("scope") == "segment", F.col("segment")).otherwise("all")
    totals = rollup.cohort_rollup(t.predictions).filter("scope <> 'vintage_segment'").select("scope", cohort.alias("cohort"), "loans", "events", "principal_cents", "reviewed", F.col("reviewed_events").alias("captured"), F.col("review_precision").alias("precision"))
    return study.sections(budget=budgets, cohort=totals)
