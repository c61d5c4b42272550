"""Sources and sinks, fitted models, coverage jobs and the review stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import asof, coverage, drift, features, journal, loans, metrics, models, ranking, reconcile, rollup
from tidemark.plans import known_then as K
from tidemark.plans import records as R
from tidemark.plans import scores as S
from tidemark.plans.registry import Tables, query
from tidemark.sources import tables
from tidemark.sources.shared import shared_path, stored
from tidemark.streaming.review import stream_review


#: The seeds of the repeated study.
SEEDS = (7, 23, 41, 59, 83)


def _text(rows):
    return rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns))


def _as_csv(t: Tables, rows, name: str) -> str:
    path = shared_path(t.spark, name)
    _text(rows).write.option("header", True).csv(path)
    return path


@query("applications feature_events performance", "SELECT (SELECT count(*) FROM applications) AS applications, (SELECT CAST(sum(principal_cents) AS BIGINT) FROM applications) AS cents, (SELECT count(*) FROM feature_events) AS features, (SELECT CAST(sum(days_past_due) AS BIGINT) FROM performance) AS days")
def s01_read_events(t: Tables):
    paths = [_as_csv(t, rows.select(*cols), "csv") for rows, cols in ((t.applications, tables.APPLICATIONS), (t.feature_events, tables.FEATURE_EVENTS), (t.performance, tables.PERFORMANCE))]
    apps, feats, perf = tables.read_events(t.spark, *paths)
    return apps.agg(F.count("*").alias("applications"), F.sum("principal_cents").alias("cents")).crossJoin(feats.agg(F.count("*").alias("features"))).crossJoin(perf.agg(F.sum("days_past_due").alias("days")))


@query("applications feature_events", "SELECT application_id, name, value, observed_at, available_at FROM feature_events")
def s02_read_features(t: Tables):
    paths = [_as_csv(t, rows.select(*cols), "csv") for rows, cols in ((t.applications, tables.APPLICATIONS), (t.feature_events, tables.FEATURE_EVENTS))]
    return tables.read_features(t.spark, *paths)[1]


@query("applications", "SELECT application_id, principal_cents, segment FROM applications")
def s03_read_coded_table(t: Tables):
    path = shared_path(t.spark, "coded")
    rows = t.applications.select("application_id", F.col("principal_cents").cast("string").alias("principal_cents"), "segment", F.lit("1").alias("class"))
    rows.write.option("sep", " ").csv(path)
    return tables.read_coded_table(t.spark, path, ("application_id", "principal_cents", "segment", "class")).select("application_id", F.col("principal_cents").cast("long").alias("principal_cents"), "segment")


@query("applications", "SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS id, CAST(c AS INTEGER) AS customer FROM applications")
def s04_read_wide_int_table(t: Tables):
    path = shared_path(t.spark, "wide")
    ranked = ranking.global_rank(t.applications.select("application_id", "c", F.lit(0.0).alias("score")), "score", "application_id", name="id")
    ranked.orderBy("id").select("id", F.col("c").alias("customer")).write.option("header", True).option("compression", "gzip").csv(path)
    return tables.read_wide_int_table(t.spark, path, ("id", "customer"))


@query("raw_loans", "SELECT source, count(*) AS rows, max(row_number) AS last FROM (SELECT source, row_number() OVER (PARTITION BY source) AS row_number FROM raw_loans) GROUP BY source")
def s05_read_raw_loans(t: Tables):
    columns = tuple(c for c in t.raw_loans.columns if c not in ("source", "ordinal"))
    paths = {s: _as_csv(t, t.raw_loans.filter(F.col("source") == s).select(*columns), "raw") for s in ("A", "B")}
    return tables.read_raw_loans(t.spark, paths, columns).groupBy("source").agg(F.count("*").alias("rows"), F.max("ordinal").alias("last"))


@query("raw_loans stages", f"{R.JUDGE} SELECT record_id, stage, CAST(funded_at AS VARCHAR) AS funded_at, CAST(gross AS VARCHAR) AS gross, CAST(charged_off_at AS VARCHAR) AS charged_off_at FROM firsts")
def s06_write_read_loans(t: Tables):
    columns = ("record_id", "stage", "funded_at", "gross", "charged_off_at")
    path = shared_path(t.spark, "loans")
    tables.write_table(R.prepared(t), path, columns, "csv")
    return tables.read_report_table(t.spark, path, columns, "csv")


@query("predictions", "SELECT application_id, vintage, label FROM predictions")
def s07_read_report_table(t: Tables):
    columns = ("application_id", "vintage", "label")
    path = shared_path(t.spark, "report")
    tables.write_table(t.predictions, path, columns)
    return tables.read_report_table(t.spark, path, columns)


@query("predictions", "SELECT vintage, count(*) AS loans FROM predictions GROUP BY vintage")
def s08_write_table(t: Tables):
    path = shared_path(t.spark, "table")
    tables.write_table(rollup.vintage_metrics(t.predictions), path, ("vintage", "loans"))
    return t.spark.read.parquet(path)


@query("applications feature_events", f"{K.ASOF} SELECT * FROM asof_values")
def s09_evidence(t: Tables):
    path = shared_path(t.spark, "evidence")
    tables.write_evidence(t.applications, t.feature_events, {"as_of": K.AS_OF}, path)
    apps, feats, _ = tables.read_evidence(t.spark, path)
    return asof.asof_latest(apps, feats)


@query("applications", "SELECT count(*) AS rows, count(*) FILTER (WHERE k % 10 = 4) AS misshapen FROM applications")
def p11_row_shape(t: Tables):
    """Rows with a cell too few among the lines of a text table."""
    path = shared_path(t.spark, "lines")
    cells = F.when(F.col("k") % 10 == 4, F.concat_ws(",", "application_id", "segment")).otherwise(F.concat_ws(",", "application_id", "segment", F.col("principal_cents")))
    t.applications.select(cells.alias("value")).write.text(path)
    shape = "application_id string, segment string, principal_cents string, _corrupt string"
    rows = t.spark.read.schema(shape).option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    return rows.select("application_id", "_corrupt").agg(F.count("application_id").alias("rows"), F.count("_corrupt").alias("misshapen"))


def with_inputs(t: Tables):
    """Rows of all stages whose inputs are known, with or without a label."""
    return stored(K.cohorts(t).dropna(subset=["utilization", "debt_to_income", "prior_delinquencies"]), "cohorts")


def complete(t: Tables):
    return with_inputs(t).dropna(subset=["label"])


def of_stage(rows, stage: str):
    return rows.filter(F.col("stage") == stage)


def logistic_scores(t: Tables):
    known = complete(t)
    train = of_stage(known, "train")
    return models.raw_scores(models.fit_logistic(models.matrix(train, train)), models.matrix(train, known))


@query("")
def l03_fit_logistic(t: Tables):
    return logistic_scores(t).select("application_id", "stage", "label", F.round("raw_pd", 6).alias("raw_pd"))


@query("")
def l04_fit_isotonic(t: Tables):
    scored = logistic_scores(t)
    return models.calibrated(models.fit_isotonic(of_stage(scored, "calibration")), of_stage(scored, "test")).select("application_id", "label", F.round("raw_pd", 6).alias("raw_pd"), F.round("calibrated_pd", 6).alias("calibrated_pd"))


@query("")
def l06_fit_boosted_trees(t: Tables):
    known = complete(t)
    train = of_stage(known, "train")
    return models.raw_scores(models.fit_trees(models.matrix(train, train)), models.matrix(train, of_stage(known, "test"))).select("application_id", "label", F.round("raw_pd", 6).alias("raw_pd"))


@query("raw_loans stages", f"{R.JUDGE}, known AS (SELECT DISTINCT method FROM firsts WHERE stage = 'train' AND method <> 'Preferred 2') SELECT record_id, CAST(method IN (SELECT method FROM known) AS INTEGER) AS ones FROM firsts WHERE stage = 'test'")
def l07_one_hot_ignore_unknown(t: Tables):
    rows = R.prepared(t)
    encoder = models.one_hot(of_stage(rows, "train").filter("method <> 'Preferred 2'"), ("method",))
    from pyspark.ml.functions import vector_to_array

    encoded = encoder.transform(of_stage(rows, "test"))
    return encoded.select("record_id", F.aggregate(vector_to_array("method_vector"), F.lit(0.0), lambda a, x: a + x).cast("int").alias("ones"))


@query("predictions", " UNION ALL ".join(f"SELECT {s} AS seed, stage, count(*) AS rows, CAST(sum(label) AS BIGINT) AS events FROM (SELECT label, CASE WHEN place <= (n * 20 + 50) // 100 THEN 'test' WHEN place <= (n * 40 + 50) // 100 THEN 'calibration' ELSE 'train' END AS stage FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY application_id) AS place, count(*) OVER (PARTITION BY label) AS n FROM predictions)) GROUP BY stage" for s in (7, 23, 41, 59, 83)))
def l19_repeat_splits(t: Tables):
    splits = (features.stratified_split(t.predictions.select("application_id", "label"), "label", "application_id", s).withColumn("seed", F.lit(s)) for s in SEEDS)
    return reduce(DataFrame.unionByName, splits).groupBy("seed", "stage").agg(F.count("*").alias("rows"), F.sum("label").alias("events"))


@query("")
def l20_frozen_stages(t: Tables):
    return models.frozen_stages(complete(t))


@query("")
def l21_fit_audit(t: Tables):
    train = of_stage(complete(t), "train")
    return t.spark.createDataFrame([(n, round(v, 6)) for n, v in models.fit_audit(models.fit_logistic(models.matrix(train, train)))], "name string, value double")


def monitored(t: Tables):
    """Scores of the calibration stage and of the visible current cohort, by the model of the training rows; labels of neither are read."""
    rows = with_inputs(t)
    known = rows.dropna(subset=["label"])
    train = of_stage(known, "train")
    model = models.fit_logistic(models.matrix(train, train))
    # Inputs are those of the decision whatever the outcome, so the current rows are the test stage's, without their outcomes.
    current = of_stage(rows, "test").filter(F.col("decision_at") <= K.day()).drop("status", "label")
    scored = lambda part: models.raw_scores(model, models.matrix(train, part)).select(F.date_format("decision_at", "yyyy-MM").alias("vintage"), "raw_pd")
    return stored(scored(of_stage(known, "calibration")), "reference"), stored(scored(current), "current")


@query("")
def d09_monitor_scores(t: Tables):
    """PSI by month of the visible current cohort's scores against those of the calibration stage."""
    return drift.psi(*monitored(t), "raw_pd", ("vintage",))


@query(K.SLOT_TABLES, f"{K.REPORT} UNION ALL BY NAME SELECT population, 'missing' AS status, feature, vintage, count(*) AS feature_applications FROM slots WHERE slots.status <> 'available' GROUP BY population, feature, vintage")
def e06_coverage_job(t: Tables):
    """The coverage report, and beside it the missing slots by population, feature and month."""
    own = K.slots(t)
    report = K.completeness(t, own).join(coverage.coverage_rollup(own).withColumnRenamed("applications", "feature_applications"), "population", "left")
    gaps = own.filter(F.col("status") != coverage.STATUSES[0]).groupBy("population", "feature", "vintage").agg(F.count("*").alias("feature_applications"))
    return report.unionByName(gaps.withColumn("status", F.lit("missing")), allowMissingColumns=True)


POLICY_WORDS = ", ".join(f"(SELECT CAST(sum(CAST(CAST('0x' || substring(h, {8 * i + 1}, 8) AS BIGINT) AS HUGEINT)) AS VARCHAR) FROM hashed) AS word_{i}" for i in range(4))


@query(
    K.SLOT_TABLES + " policy_rules",
    f"""{K.CHECKS}, hashed AS (SELECT sha256('{{"feature":"' || feature || '","id":"' || id || '","min_applications":' || min_applications || ',"min_coverage":"' || min_coverage || '","population":"' || population || '","vintage":"' || vintage || '"}}') AS h FROM policy_rules
    ), verdict AS (SELECT CASE WHEN bool_or(result = 'fail') THEN 'fail' WHEN bool_or(result = 'insufficient') THEN 'insufficient' ELSE 'pass' END AS verdict FROM checks
    ), missing AS (SELECT population, feature, vintage, count(*) AS missing_slots FROM (SELECT population, feature, vintage FROM slots WHERE status <> 'available' UNION ALL SELECT population, feature, 'all' FROM slots WHERE status <> 'available') GROUP BY ALL)
    SELECT ordinal, id, c.population, c.vintage, c.feature, applications, available, coverage_rate, result, verdict, coalesce(missing_slots, 0) AS missing_slots, {POLICY_WORDS}
    FROM checks c CROSS JOIN verdict LEFT JOIN missing m ON m.population = c.population AND m.feature = c.feature AND m.vintage = c.vintage""",
)
def e07_policy_job(t: Tables):
    """Each rule's result beside the verdict, the policy's fingerprint and the slots that the rule misses."""
    own = K.slots(t)
    checks = stored(coverage.policy_check(t.policy_rules, coverage.coverage_rollup(own)), "checks")
    gaps = own.filter(F.col("status") != coverage.STATUSES[0]).select("population", "feature", F.explode(F.array("vintage", F.lit("all"))).alias("vintage"))
    missing = gaps.groupBy("population", "feature", "vintage").agg(F.count("*").alias("missing_slots"))
    identity = reconcile.fingerprint(t.policy_rules, "feature", "id", "min_applications", "min_coverage", "population", "vintage").drop("rows")
    whole = coverage.policy_verdict(checks).select("verdict").crossJoin(identity)
    return checks.crossJoin(F.broadcast(whole)).join(missing, ["population", "feature", "vintage"], "left").fillna(0, ["missing_slots"])


@query("journal queue", f"{R.STATES}, requests AS (SELECT request_id, count(*) AS n FROM journal GROUP BY request_id) SELECT 'replay' AS section, status, count(*) AS cases, CAST(sum(version) AS BIGINT) AS events, NULL AS violation, NULL AS issue FROM states GROUP BY status"
  " UNION ALL SELECT 'integrity', NULL, (SELECT count(*) FROM requests WHERE n > 1), (SELECT count(*) FROM journal), violation, issue FROM violation")
def e15_review_workflow(t: Tables):
    """Cases by their replayed status, and beside them the journal's events, repeated requests and first violation; ``g07`` has the stream."""
    counts = journal.replay(t.queue, t.journal).groupBy("status").agg(F.count("*").alias("cases"), F.sum("version").alias("events"))
    whole = journal.integrity(t.journal, t.queue).select(F.lit("integrity").alias("section"), F.col("repeated_requests").alias("cases"), "events", "violation", "issue")
    return counts.withColumn("section", F.lit("replay")).unionByName(whole, allowMissingColumns=True)


@query("journal queue", f"""{R.TRANSITIONS}, firsts AS (SELECT application_id, min(sequence) AS violation FROM judged WHERE issue IS NOT NULL GROUP BY application_id)
SELECT application_id, count(*) FILTER (WHERE violation IS NULL OR sequence < violation) AS accepted FROM journal LEFT JOIN firsts USING (application_id) GROUP BY application_id""")
def g07_stream_review(t: Tables):
    """Commands accepted by the stream, from the journal as files.  After a case's first violation all versions are stale."""
    commands, out, state = (shared_path(t.spark, n) for n in ("commands", "accepted", "stream"))
    t.journal.write.parquet(commands)
    live = stream_review(t.spark.readStream.schema(t.journal.schema).parquet(commands), t.queue)
    live.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).groupBy("application_id").agg(F.count_if(F.col("result") == "accepted").alias("accepted"))
