"""Queries on frozen scores: ranks, capacities, rollups, quality, resampling, drift and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import drift, features, metrics, ranking, rollup
from tidemark.plans.registry import Tables, query

RANKED = """ranked AS (SELECT method, application_id, score, row_number() OVER (PARTITION BY method ORDER BY score DESC, application_id) AS rank, count(*) OVER (PARTITION BY method) AS n FROM scores)"""


@query("scores", f"{RANKED} SELECT method, application_id, score, rank FROM ranked")
def w01_priority_rank(t: Tables):
    return ranking.global_rank(t.scores, "score", "application_id", ("method",))


@query("predictions", "SELECT application_id, calibrated_pd, rank FROM (SELECT *, row_number() OVER (ORDER BY calibrated_pd DESC, application_id) AS rank, count(*) OVER () AS n FROM predictions) WHERE rank <= (n * 10 + 99) // 100")
def w02_select_capacity(t: Tables):
    return ranking.select_capacity(t.predictions, 10, "calibrated_pd", "application_id").select("application_id", "calibrated_pd", "rank")


@query(
    "predictions",
    "SELECT row_number() OVER (ORDER BY calibrated_pd DESC, application_id) AS review_rank, application_id, decision_at, vintage, segment, principal_cents, raw_pd, calibrated_pd FROM predictions WHERE review_selected = 1",
)
def w03_review_queue(t: Tables):
    return ranking.global_rank(t.predictions.filter("review_selected = 1").drop("label", "review_selected"), "calibrated_pd", "application_id", name="review_rank")


@query("predictions", "SELECT application_id, CAST(ntile(10) OVER (ORDER BY calibrated_pd DESC, application_id) AS INTEGER) AS bucket FROM predictions")
def w04_ntile(t: Tables):
    return ranking.rank_buckets(t.predictions, 10, "calibrated_pd", "application_id").select("application_id", "bucket")


@query("scores capacities", f"{RANKED} SELECT method, percent, application_id, score, rank FROM ranked CROSS JOIN capacities WHERE rank <= (n * percent + 99) // 100")
def w07_multi_budget_select(t: Tables):
    return ranking.multi_budget(t.scores, t.capacities, "score", "application_id").select("method", "percent", "application_id", "score", "rank")


@query("risk", "SELECT application_id, segment, decision_at FROM (SELECT *, row_number() OVER (PARTITION BY segment || CAST(c % 500 AS VARCHAR) ORDER BY decision_at, application_id) AS n FROM risk) WHERE n = 1")
def w09_earliest_per_group(t: Tables):
    grouped = t.risk.withColumn("g", F.concat("segment", (F.col("c") % 500).cast("string")))
    return ranking.earliest_per_group(grouped, "g", "decision_at", "application_id").select("application_id", "segment", "decision_at")


#: Rows of each stage that the sample takes.
SAMPLE = {"train": 20_000, "calibration": 5_000, "test": 10_000}


@query(
    "applications stages",
    """staged AS (SELECT application_id, stage FROM applications LEFT JOIN stages ON decision_at BETWEEN start_at AND end_at)
    SELECT application_id, stage FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY sha256('s1:' || application_id)) AS n FROM staged) WHERE n <= CASE stage WHEN 'train' THEN 20000 WHEN 'calibration' THEN 5000 WHEN 'test' THEN 10000 ELSE 0 END""",
)
def w10_hash_sample(t: Tables):
    staged = t.applications.join(F.broadcast(t.stages), F.col("decision_at").between(F.col("start_at"), F.col("end_at")), "left").select("application_id", "stage")
    return ranking.hash_sample(staged, "stage", F.col("application_id"), SAMPLE, "s1").select("application_id", "stage")


@query("scores", f"{RANKED} SELECT method, score, min(rank) AS first_rank, max(rank) AS last_rank FROM ranked GROUP BY method, score")
def w12_global_rank_of_ties(t: Tables):
    ranked = ranking.global_rank(t.scores, "score", "application_id", ("method",))
    return ranked.groupBy("method", "score").agg(F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"))


def portfolio(group: str = "") -> str:
    return f"""SELECT {group + ',' if group else ''} count(*) AS loans, CAST(sum(label) AS BIGINT) AS events, round(CAST(sum(label) AS DOUBLE) / count(*), 8) AS event_rate,
    round(CAST(sum(calibrated_pd) AS DOUBLE) / count(*), 8) AS mean_pd, CAST(sum(principal_cents) AS BIGINT) AS principal_cents,
    round(CAST(sum(CAST(principal_cents AS DECIMAL(18, 0)) * CAST(calibrated_pd AS DECIMAL(12, 10))) AS DOUBLE) * (0.45::DOUBLE / 100), 2) AS scenario_expected_loss_usd,
    round(CAST(sum(CASE WHEN label = 1 THEN principal_cents ELSE 0 END) AS DOUBLE) * (0.45::DOUBLE / 100), 2) AS scenario_event_loss_proxy_usd"""


@query("predictions", f"{portfolio()} FROM predictions")
def a03_portfolio_aggregate(t: Tables):
    return rollup.portfolio_aggregate(t.predictions)


@query("predictions", f"{portfolio('vintage')} FROM predictions GROUP BY vintage")
def a04_vintage_metrics(t: Tables):
    return rollup.vintage_metrics(t.predictions)


@query("predictions", f"deciles AS (SELECT *, CAST(ntile(10) OVER (ORDER BY calibrated_pd DESC, application_id) AS INTEGER) AS decile FROM predictions) {portfolio('decile')} FROM deciles GROUP BY decile")
def a05_risk_deciles(t: Tables):
    return rollup.risk_deciles(t.predictions)


#: Every cell of two grouping columns and of either and none, then beside each dated cell the one of the greatest month below it.
CELL = """CASE GROUPING_ID(vintage, segment) WHEN 0 THEN 'vintage_segment' WHEN 1 THEN 'vintage' WHEN 2 THEN 'segment' ELSE 'portfolio' END AS scope,
    CASE WHEN GROUPING(vintage) = 1 THEN 'all' ELSE vintage END AS v, CASE WHEN GROUPING(segment) = 1 THEN 'all' ELSE segment END AS g"""
COHORT_SQL = f"""cells AS ({portfolio(CELL)},
    round(CAST(sum(CAST(principal_cents AS DECIMAL(18, 0)) * CAST(calibrated_pd AS DECIMAL(12, 10))) AS DOUBLE) / CAST(sum(principal_cents) AS DOUBLE), 8) AS exposure_weighted_pd,
    avg(label) AS rate, CAST(sum(calibrated_pd) AS DOUBLE) / count(*) AS pd, count(*) FILTER (WHERE review_selected = 1) AS reviewed, count(*) FILTER (WHERE review_selected = 1 AND label = 1) AS reviewed_events
  FROM predictions GROUP BY GROUPING SETS ((vintage, segment), (vintage), (segment), ())
), month_before AS (
  SELECT scope, g, c.v, max(e.v) AS before FROM cells c JOIN cells e USING (scope, g) WHERE e.v < c.v GROUP BY scope, g, c.v
), changed AS (
  SELECT c.*, e.rate AS previous FROM cells c LEFT JOIN month_before m ON m.scope = c.scope AND m.g = c.g AND m.v = c.v LEFT JOIN cells e ON e.scope = c.scope AND e.g = c.g AND e.v = m.before)"""


@query(
    "predictions",
    f"""{COHORT_SQL} SELECT scope, v AS vintage, g AS segment, loans, events, event_rate, mean_pd, round(rate - pd, 8) AS event_pd_gap, principal_cents, exposure_weighted_pd, reviewed, reviewed_events,
    round(CAST(reviewed AS DOUBLE) / loans, 8) AS review_share, round(CAST(reviewed_events AS DOUBLE) / nullif(reviewed, 0), 8) AS review_precision, round(CAST(reviewed_events AS DOUBLE) / nullif(events, 0), 8) AS event_capture,
    round(previous, 8) AS previous_event_rate, round(rate - previous, 8) AS event_rate_change, scenario_expected_loss_usd, scenario_event_loss_proxy_usd FROM changed""",
)
def a06_cohort_rollup(t: Tables):
    return rollup.cohort_rollup(t.predictions)


@query("predictions", f"{COHORT_SQL} SELECT scope, v AS vintage, g AS segment, round(previous, 8) AS previous_event_rate FROM changed WHERE scope LIKE 'vintage%'")
def w05_previous_observed(t: Tables):
    return rollup.cohort_rollup(t.predictions).filter("scope like 'vintage%'").select("scope", "vintage", "segment", "previous_event_rate")


@query(
    "predictions",
    """SELECT segment, count(*) FILTER (WHERE review_selected = 1 AND label = 1) AS reviewed_events, CAST(sum(CASE WHEN label = 1 THEN principal_cents ELSE 0 END) AS BIGINT) AS event_cents,
    count(*) FILTER (WHERE label = 1) AS events FROM predictions GROUP BY segment""",
)
def a07_conditional_aggregates(t: Tables):
    hit = (F.col("review_selected") == 1) & (F.col("label") == 1)
    return t.predictions.groupBy("segment").agg(F.count_if(hit).alias("reviewed_events"), F.sum(F.when(F.col("label") == 1, F.col("principal_cents")).otherwise(0)).alias("event_cents"), F.count_if(F.col("label") == 1).alias("events"))


@query("predictions", f"{COHORT_SQL} SELECT scope, v AS vintage, g AS segment, exposure_weighted_pd FROM changed")
def a08_exposure_weighted_mean(t: Tables):
    return rollup.cohort_rollup(t.predictions).select("scope", "vintage", "segment", "exposure_weighted_pd")


@query("predictions", f"{COHORT_SQL} SELECT scope, v AS vintage, g AS segment, round(CAST(reviewed_events AS DOUBLE) / nullif(reviewed, 0), 8) AS review_precision, round(CAST(reviewed_events AS DOUBLE) / nullif(events, 0), 8) AS event_capture FROM changed")
def a09_guarded_rates(t: Tables):
    return rollup.cohort_rollup(t.predictions).select("scope", "vintage", "segment", "review_precision", "event_capture")


BUDGET = f"""{RANKED}, chosen AS (SELECT method, percent, application_id FROM ranked CROSS JOIN capacities WHERE rank <= (n * percent + 99) // 100)"""


@query(
    "scores outcomes capacities",
    f"""{BUDGET}, total AS (SELECT CAST(sum(label) AS BIGINT) AS total_events FROM outcomes)
    SELECT method, percent, count(*) AS reviewed, CAST(sum(label) AS BIGINT) AS captured, max(total_events) AS total_events, round(sum(label) / count(*), 8) AS precision, round(sum(label) / max(total_events), 8) AS capture
    FROM chosen JOIN outcomes USING (application_id) CROSS JOIN total GROUP BY method, percent""",
)
def a11_budget_table(t: Tables):
    return rollup.budget_table(t.scores, t.outcomes, t.capacities)


@query("scores outcomes capacities", f"{BUDGET} SELECT method, percent, application_id, label FROM chosen JOIN outcomes USING (application_id)")
def j12_attach_outcomes(t: Tables):
    chosen = ranking.multi_budget(t.scores, t.capacities, "score", "application_id").select("method", "percent", "application_id")
    return chosen.join(t.outcomes.select("application_id", "label"), "application_id")


@query(
    "scores outcomes capacities",
    f"""{BUDGET}, flagged AS (
      SELECT s.method, c.percent, o.*, CASE WHEN h.application_id IS NULL THEN 0 ELSE 1 END AS taken FROM scores s CROSS JOIN capacities c JOIN outcomes o USING (application_id)
      LEFT JOIN chosen h ON h.method = s.method AND h.percent = c.percent AND h.application_id = s.application_id
    ), grouped AS (SELECT 'portfolio' AS group_type, 'all' AS grp, * FROM flagged UNION ALL SELECT 'vintage', vintage, * FROM flagged UNION ALL SELECT 'segment', segment, * FROM flagged)
    SELECT method, percent, group_type, grp AS "group", count(*) AS applications, CAST(sum(label) AS BIGINT) AS events, CAST(sum(taken) AS BIGINT) AS reviewed, CAST(sum(taken * label) AS BIGINT) AS captured_events,
      CAST(sum(taken) - sum(taken * label) AS BIGINT) AS false_positives, CAST(sum(label) - sum(taken * label) AS BIGINT) AS missed_events, round(sum(taken * label) / nullif(sum(taken), 0), 8) AS precision,
      round(sum(taken * label) / nullif(sum(label), 0), 8) AS capture, CAST(sum(taken) * 2500 AS BIGINT) AS review_cost_cents, CAST(sum(taken * label * principal_cents) AS BIGINT) AS captured_exposure_cents
    FROM grouped GROUP BY method, percent, group_type, grp""",
)
def a10_capacity_policy_table(t: Tables):
    return rollup.capacity_policy_table(t.scores, t.outcomes, t.capacities)


@query("base_values", "SELECT name, count(value) AS count, min(value) AS minimum, max(value) AS maximum, round(avg(value), 6) AS mean FROM base_values GROUP BY name")
def a14_describe_numeric(t: Tables):
    return rollup.describe_numeric(t.base_values)


@query(
    "scores outcomes capacities",
    f"""{BUDGET}, hits AS (SELECT method, percent, CAST(sum(label) AS BIGINT) AS captured, count(*) AS reviewed FROM chosen JOIN outcomes USING (application_id) GROUP BY method, percent)
    SELECT method, round(avg(captured), 8) AS mean_captured, min(captured) AS min_captured, max(captured) AS max_captured, round(avg(reviewed), 8) AS mean_reviewed, min(reviewed) AS min_reviewed, max(reviewed) AS max_reviewed FROM hits GROUP BY method""",
)
def a16_repeat_summary(t: Tables):
    return rollup.repeat_summary(rollup.budget_table(t.scores, t.outcomes, t.capacities), "method", ("captured", "reviewed"))


@query("predictions", "SELECT count(DISTINCT vintage) AS vintages, count(DISTINCT application_id) AS applications, min(vintage) AS first, max(vintage) AS last FROM predictions")
def a21_distinct_counts(t: Tables):
    return rollup.distinct_counts(t.predictions)


def quality_sql(source: str, by: str = "", weight: str = "1") -> str:
    """AUC, average precision and Brier score of ``source`` (score, label, by...)."""
    keys = f"{by}," if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""counts AS (SELECT {keys} score, CAST(sum(CASE WHEN label = 1 THEN {weight} ELSE 0 END) AS BIGINT) AS pos, CAST(sum(CASE WHEN label = 1 THEN 0 ELSE {weight} END) AS BIGINT) AS neg FROM {source} GROUP BY {keys} score
    ), cum AS (SELECT *, sum(neg) OVER ({part} ORDER BY score) AS below, sum(pos) OVER ({part} ORDER BY score DESC) AS pos_above, sum(pos + neg) OVER ({part} ORDER BY score DESC) AS above FROM counts
    ), quality AS (SELECT {keys} CAST(sum(pos + neg) AS BIGINT) AS records, CAST(sum(pos) AS BIGINT) AS events,
      round(CAST(sum(CAST(pos AS HUGEINT) * (2 * below - neg)) AS DOUBLE) / 2 / nullif(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0), 8) AS auc,
      round(sum(CAST(pos AS DOUBLE) * pos_above / above) / nullif(sum(pos), 0), 8) AS average_precision,
      CASE WHEN min(score) >= 0 AND max(score) <= 1 THEN round(CAST(sum(CASE WHEN score BETWEEN 0 AND 1 THEN CAST(pos AS DECIMAL(10, 0)) * (CAST(1 - score AS DECIMAL(12, 10)) * CAST(1 - score AS DECIMAL(12, 10)))
        + CAST(neg AS DECIMAL(10, 0)) * (CAST(score AS DECIMAL(12, 10)) * CAST(score AS DECIMAL(12, 10))) END) AS DOUBLE) / CAST(sum(pos + neg) AS BIGINT), 8) END AS brier FROM cum {group})"""


LABELLED = "labelled AS (SELECT method, score, label, vintage FROM scores JOIN outcomes USING (application_id))"
#: Beside the methods' probabilities, one of them as points from -500 up.
POINTS = """labelled AS (SELECT method, CAST(score AS DECIMAL(20, 10)) AS score, label, vintage FROM scores JOIN outcomes USING (application_id)
  UNION ALL SELECT 'points', CAST(floor(score * 1500) - 500 AS DECIMAL(20, 10)), label, vintage FROM scores JOIN outcomes USING (application_id) WHERE method = 'rule')"""


def labelled(t: Tables):
    return t.scores.join(t.outcomes.select("application_id", "label", "vintage"), "application_id")


def with_points(t: Tables):
    rows = labelled(t).withColumn("score", F.col("score").cast("decimal(20,10)"))
    points = rows.filter("method = 'rule'").withColumns({"method": F.lit("points"), "score": (F.floor(F.col("score") * 1500) - 500).cast("decimal(20,10)")})
    return rows.unionByName(points)


@query("scores outcomes", f"{POINTS}, {quality_sql('labelled', 'method')} SELECT method, auc FROM quality")
def m01_roc_auc(t: Tables):
    return metrics.quality(with_points(t), "score", "label", ("method",)).select("method", "auc")


@query("scores outcomes", f"{POINTS}, {quality_sql('labelled', 'method')} SELECT method, average_precision FROM quality")
def m02_average_precision(t: Tables):
    return metrics.quality(with_points(t), "score", "label", ("method",)).select("method", "average_precision")


@query("scores outcomes", f"{LABELLED}, {quality_sql('labelled', 'method')} SELECT method, brier FROM quality")
def m03_brier(t: Tables):
    return metrics.quality(labelled(t), "score", "label", ("method",)).select("method", "brier")


@query(
    "predictions",
    """r AS (SELECT avg(label) AS rate FROM predictions WHERE decision_at < DATE '1996-01-01'), e AS (SELECT avg(label) AS event_rate FROM predictions WHERE decision_at >= DATE '1996-01-01')
    SELECT CAST(0.5 AS DOUBLE) AS auc, round(event_rate, 8) AS average_precision, round(event_rate * (1 - rate) * (1 - rate) + (1 - event_rate) * rate * rate, 8) AS brier, round(rate, 8) AS rate FROM r, e""",
)
def m04_constant_baseline(t: Tables):
    old = F.col("decision_at") < F.lit("1996-01-01").cast("date")
    return metrics.constant_baseline(t.predictions.filter(old), t.predictions.filter(~old))


@query(
    "predictions",
    """ranked AS (SELECT label, row_number() OVER (ORDER BY calibrated_pd DESC, application_id) AS rank, count(*) OVER () AS n FROM predictions)
    SELECT count(*) FILTER (WHERE rank <= (n * 10 + 99) // 100) AS reviewed, CAST(sum(label) FILTER (WHERE rank <= (n * 10 + 99) // 100) AS BIGINT) AS hits, CAST(sum(label) AS BIGINT) AS events,
    round(sum(label) FILTER (WHERE rank <= (n * 10 + 99) // 100) / count(*) FILTER (WHERE rank <= (n * 10 + 99) // 100), 8) AS precision, round(sum(label) FILTER (WHERE rank <= (n * 10 + 99) // 100) / sum(label), 8) AS capture FROM ranked""",
)
def m05_precision_capture_at_k(t: Tables):
    return metrics.precision_capture(t.predictions, 10, "calibrated_pd", "application_id")


@query("scores outcomes", f"{POINTS}, {quality_sql('labelled', 'method, vintage')} SELECT * FROM quality")
def m06_metrics_by(t: Tables):
    return metrics.quality(with_points(t), "score", "label", ("method", "vintage"))


REPLICATES, SEED = 300, 7
DRAWS = f"""months AS (SELECT list_sort(list(DISTINCT vintage)) AS every FROM outcomes), draws AS (
  SELECT CAST(rep AS INTEGER) AS replicate, every[1 + CAST(('0x' || substring(sha256('{SEED}:' || rep || ':' || slot), 1, 8)) AS BIGINT) % len(every)] AS vintage, CAST(count(*) AS INTEGER) AS weight
  FROM (SELECT every, rep, unnest(range(0, len(every))) AS slot FROM months, range(0, {REPLICATES}) r(rep)) GROUP BY ALL)"""
WEIGHTED = f"{DRAWS}, weighted AS (SELECT replicate, method, score, label, weight FROM scores JOIN outcomes USING (application_id) JOIN draws USING (vintage))"


def draws(t: Tables):
    return metrics.bootstrap_draws(t.outcomes, REPLICATES, SEED)


@query("outcomes", f"{DRAWS} SELECT * FROM draws")
def m11_bootstrap_draws(t: Tables):
    return draws(t)


@query("scores outcomes", f"{WEIGHTED}, {quality_sql('weighted', 'replicate, method', 'weight')} SELECT replicate, method, auc, brier FROM quality")
def m07_block_bootstrap(t: Tables):
    return metrics.block_bootstrap(labelled(t), draws(t), "score", "label", ("method",)).select("replicate", "method", "auc", "brier")


PLACES = f"""{DRAWS}, {RANKED}, placed AS (
  SELECT r.method, d.replicate, r.rank, o.label, d.weight, sum(d.weight) OVER (PARTITION BY r.method, d.replicate ORDER BY r.rank) AS upto, sum(d.weight) OVER (PARTITION BY r.method, d.replicate) AS total
  FROM ranked r JOIN outcomes o USING (application_id) JOIN draws d ON d.vintage = o.vintage
), captured AS (SELECT method, replicate, percent, CAST(sum(label * least(weight, greatest(0, (total * percent + 99) // 100 - (upto - weight)))) AS BIGINT) AS captured FROM placed CROSS JOIN capacities GROUP BY method, replicate, percent)"""


def captures(t: Tables):
    ranked = ranking.global_rank(t.scores, "score", "application_id", ("method",)).join(t.outcomes.select("application_id", "label", "vintage"), "application_id")
    return metrics.capture_bootstrap(ranked, draws(t), t.capacities)


@query("scores outcomes capacities", f"{PLACES} SELECT c.method, c.replicate, c.percent, c.captured - b.captured AS difference FROM captured c JOIN captured b ON b.method = 'rule' AND b.replicate = c.replicate AND b.percent = c.percent WHERE c.method <> 'rule'")
def m08_paired_capture_bootstrap(t: Tables):
    return metrics.paired_difference(captures(t), "rule")


@query(
    "scores outcomes",
    f"""{WEIGHTED}, {quality_sql('weighted', 'replicate, method', 'weight')} SELECT q.replicate, q.method, q.records, q.events, q.auc, q.average_precision, q.brier, CAST(round(CAST(q.brier AS DECIMAL(12, 8)) - CAST(b.brier AS DECIMAL(12, 8)), 7) AS DOUBLE) AS brier_difference
    FROM quality q JOIN quality b ON b.replicate = q.replicate AND b.method = 'rule'""",
)
def m09_paired_metric_bootstrap(t: Tables):
    rows = metrics.block_bootstrap(labelled(t), draws(t), "score", "label", ("method",), precision=True)
    base = rows.filter("method = 'rule'").select("replicate", F.col("brier").alias("base"))
    return rows.join(base, "replicate").withColumn("brier_difference", metrics.difference(F.col("brier"), F.col("base"))).drop("base")


@query(
    "scores outcomes",
    f"{WEIGHTED}, {quality_sql('weighted', 'replicate, method', 'weight')} SELECT method, round(quantile_cont(auc, 0.025), 8) AS low, round(quantile_cont(auc, 0.975), 8) AS high, count(auc) AS valid FROM quality GROUP BY method",
)
def m10_quantile_interval(t: Tables):
    return metrics.quantile_interval(metrics.block_bootstrap(labelled(t), draws(t), "score", "label", ("method",)), "auc", ("method",))


#: Rows of two spans; some have no month, some no score.
SIDES = "old AS (SELECT * FROM monitored_rows WHERE month < '1996-01'), new AS (SELECT * FROM monitored_rows WHERE month >= '1997-06')"
EDGES = f"""{SIDES}, edges AS (
  SELECT list_sort(list_distinct(list_filter(list_transform(q, lambda x: round(x, 10)), lambda x: x > lo AND x < hi))) AS e
  FROM (SELECT quantile_cont(CAST(calibrated_pd AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q, CAST(min(calibrated_pd) AS DOUBLE) AS lo, CAST(max(calibrated_pd) AS DOUBLE) AS hi FROM old))"""
PSI = f"""{EDGES}, bins AS (SELECT unnest(range(0, len(e) + 1)) AS b, len(e) + 1 AS k FROM edges
), o AS (SELECT len(list_filter(e, lambda x: x <= CAST(calibrated_pd AS DOUBLE))) AS b, count(*) AS c FROM old, edges WHERE calibrated_pd IS NOT NULL GROUP BY 1
), n AS (SELECT {{0}} len(list_filter(e, lambda x: x <= CAST(calibrated_pd AS DOUBLE))) AS b, count(*) AS c FROM new, edges WHERE calibrated_pd IS NOT NULL GROUP BY ALL)"""


def sides(t: Tables):
    return t.monitored_rows.filter("month < '1996-01'"), t.monitored_rows.filter("month >= '1997-06'")


@query("monitored_rows", f"{EDGES} SELECT unnest(e) AS edge FROM edges")
def d01_reference_edges(t: Tables):
    return drift.reference_edges(sides(t)[0], "calibrated_pd").select(F.explode("edges").alias("edge"))


@query("monitored_rows", f"{EDGES} SELECT application_id, CAST(len(list_filter(e, lambda x: x <= CAST(calibrated_pd AS DOUBLE))) AS INTEGER) AS bin FROM new, edges WHERE calibrated_pd IS NOT NULL")
def d02_assign_bins(t: Tables):
    old, new = sides(t)
    return drift.assign_bins(new.filter("calibrated_pd is not null"), drift.reference_edges(old, "calibrated_pd"), "calibrated_pd").select("application_id", "bin")


SHARES = "(coalesce(o.c, 0) + 0.5) / (ot + k * 0.5) AS os, (coalesce(n.c, 0) + 0.5) / (nt + k * 0.5) AS ns"


@query(
    "monitored_rows",
    f"""{PSI.format('')}, s AS (SELECT bins.b, coalesce(o.c, 0) AS oc, coalesce(n.c, 0) AS nc, {SHARES} FROM bins LEFT JOIN o USING (b) LEFT JOIN n USING (b), (SELECT count(calibrated_pd) AS ot FROM old), (SELECT count(calibrated_pd) AS nt FROM new))
    SELECT CAST(b + 1 AS INTEGER) AS bin, oc AS reference_loans, nc AS current_loans, round(os, 8) AS reference_share, round(ns, 8) AS current_share, round((ns - os) * ln(ns / os), 8) AS psi_component FROM s""",
)
def d03_psi(t: Tables):
    rows = drift.psi_bins(*sides(t), "calibrated_pd")
    return rows.select("bin", "reference_loans", "current_loans", "reference_share", "current_share", F.round("component", 8).alias("psi_component"))


@query(
    "monitored_rows",
    f"""{PSI.format('vintage,')}, s AS (
      SELECT g.vintage, nt, {SHARES} FROM bins CROSS JOIN (SELECT vintage, count(calibrated_pd) AS nt FROM new GROUP BY vintage) g LEFT JOIN o USING (b) LEFT JOIN n ON n.b = bins.b AND n.vintage IS NOT DISTINCT FROM g.vintage, (SELECT count(calibrated_pd) AS ot FROM old))
    SELECT vintage, max(nt) AS rows, CASE WHEN max(nt) >= 20 THEN round(sum((ns - os) * ln(ns / os)), 6) END AS psi FROM s GROUP BY vintage""",
)
def d04_psi_by_vintage(t: Tables):
    return drift.psi(*sides(t), "calibrated_pd", ("vintage",))


ECDF = f"""{SIDES}, ms AS (SELECT {{0}}), pts AS (
  SELECT ms.g, v, sum(r) AS r, sum(c) AS c FROM ms, LATERAL (SELECT raw_pd AS v, 1 AS r, 0 AS c FROM old UNION ALL SELECT raw_pd, 0, 1 FROM new WHERE {{1}}) WHERE v IS NOT NULL GROUP BY ms.g, v
), cum AS (SELECT g, v, CAST(sum(r) OVER w AS BIGINT) AS cr, CAST(sum(c) OVER w AS BIGINT) AS cc, CAST(sum(r) OVER (PARTITION BY g) AS BIGINT) AS n, CAST(sum(c) OVER (PARTITION BY g) AS BIGINT) AS m FROM pts WINDOW w AS (PARTITION BY g ORDER BY v)
), best AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(CAST(cr AS HUGEINT) * m - CAST(cc AS HUGEINT) * n) DESC, v) AS place FROM cum)"""


@query("monitored_rows", f"{ECDF.format(chr(39) + 'all' + chr(39) + ' AS g', 'true')} SELECT v AS value, cr AS cum_ref, cc AS cum_cur FROM cum")
def w08_ecdf_counts(t: Tables):
    return drift.ecdf_counts(*sides(t), "raw_pd").select("value", "cum_ref", "cum_cur")


KS = """round(CAST(abs(CAST(cr AS HUGEINT) * m - CAST(cc AS HUGEINT) * n) AS DOUBLE) / (CAST(n AS DOUBLE) * m), 6)"""


@query("monitored_rows", f"{ECDF.format(chr(39) + 'all' + chr(39) + ' AS g', 'true')} SELECT {KS} AS distance, v AS at_value, round(cr / n, 8) AS reference_cdf, round(cc / m, 8) AS current_cdf, 'ok' AS status, (SELECT count(*) FROM old WHERE raw_pd IS NULL) AS reference_missing, (SELECT count(*) FROM new WHERE raw_pd IS NULL) AS current_missing FROM best WHERE place = 1")
def d05_ks_distance(t: Tables):
    return drift.ks_distance(*sides(t), "raw_pd")


@query(
    "monitored_rows",
    f"""{ECDF.format('DISTINCT vintage AS g FROM new', 'vintage IS NOT DISTINCT FROM ms.g')} SELECT g AS vintage, CASE WHEN m >= 20 THEN {KS} END AS distance, v AS at_value, round(cr / n, 8) AS reference_cdf, round(cc / m, 8) AS current_cdf,
    CASE WHEN m >= 20 THEN 'ok' ELSE 'insufficient_sample' END AS status,
    (SELECT count(*) FROM old WHERE raw_pd IS NULL) AS reference_missing, (SELECT count(*) FROM new WHERE raw_pd IS NULL AND vintage IS NOT DISTINCT FROM best.g) AS current_missing FROM best WHERE place = 1""",
)
def d07_drift_by_vintage(t: Tables):
    return drift.ks_distance(*sides(t), "raw_pd", ("vintage",))


SHARE_SQL = f"""{SIDES}, kinds AS (SELECT unnest(['retail', 'small_business', 'corporate']) AS value), shares AS (
  SELECT value, count(*) FILTER (WHERE side = 'old') AS reference_count, count(*) FILTER (WHERE side = 'new') AS current_count
  FROM kinds LEFT JOIN (SELECT 'old' AS side, segment FROM old UNION ALL SELECT 'new', segment FROM new) s ON s.segment = value GROUP BY value), sizes AS (SELECT (SELECT count(*) FROM old) AS n, (SELECT count(*) FROM new) AS m)"""
KINDS = ("retail", "small_business", "corporate")


@query("monitored_rows", f"{SHARE_SQL} SELECT value, reference_count, current_count, round(reference_count / n, 8) AS reference_share, round(current_count / m, 8) AS current_share FROM shares, sizes")
def a15_category_shares(t: Tables):
    return drift.category_shares(*sides(t), "segment", KINDS).drop("n", "m")


@query(
    "monitored_rows",
    f"""{SIDES}, months AS (SELECT vintage, count(*) AS m FROM new GROUP BY vintage), cells AS (
      SELECT vintage, m, (SELECT count(*) FROM old) AS n, (SELECT count(*) FROM old WHERE segment = value) AS r, (SELECT count(*) FROM new WHERE segment = value AND new.vintage IS NOT DISTINCT FROM months.vintage) AS c
      FROM months, (SELECT unnest(['retail', 'small_business', 'corporate']) AS value))
    SELECT vintage, round(CAST(sum(abs(r * m - c * n)) AS DOUBLE) / (2 * max(CAST(n AS DOUBLE) * m)), 6) AS distance FROM cells GROUP BY vintage""",
)
def d06_total_variation(t: Tables):
    return drift.total_variation(*sides(t), "segment", KINDS, ("vintage",))


@query(
    "monitored_rows",
    f"""{ECDF.format(chr(39) + 'all' + chr(39) + ' AS g', 'true')}, {SHARE_SQL.split('), kinds', 1)[1].join(['kinds', ''])}
    SELECT 'raw_pd' AS feature, 'empirical_ks_distance' AS method, {KS} AS distance FROM best WHERE place = 1
    UNION ALL SELECT 'segment', 'total_variation_distance', round(CAST(sum(abs(reference_count * m - current_count * n)) AS DOUBLE) / (2 * max(CAST(n AS DOUBLE) * m)), 6) FROM shares, sizes""",
)
def d08_monitor_features(t: Tables):
    old, new = sides(t)
    numeric = drift.ks_distance(old, new, "raw_pd").select(F.lit("raw_pd").alias("feature"), F.lit("empirical_ks_distance").alias("method"), "distance")
    return numeric.unionByName(drift.total_variation(old, new, "segment", KINDS).select(F.lit("segment").alias("feature"), F.lit("total_variation_distance").alias("method"), "distance"))


NAMES = ("utilization", "debt_to_income", "prior_delinquencies")
PARTS = "SELECT application_id, name, ord, round((value - mean) * coef / scale, 10) AS contribution FROM base_values JOIN coefficients USING (name)"


@query("base_values risk coefficients", f"SELECT application_id, name, contribution, CAST(row_number() OVER (PARTITION BY application_id ORDER BY contribution DESC, ord) AS INTEGER) AS reason_rank FROM ({PARTS})")
def l15_log_odds_contributions(t: Tables):
    return features.contributions(t.risk, t.coefficients, NAMES)


@query("base_values coefficients", f"SELECT application_id, CAST(row_number() OVER (PARTITION BY application_id ORDER BY contribution DESC, ord) AS INTEGER) AS reason_rank, name FROM ({PARTS})")
def w06_reason_rank(t: Tables):
    return features.contributions(t.risk, t.coefficients, NAMES).select("application_id", "reason_rank", "name")


@query("base_values coefficients", f"SELECT application_id, round(1 / (1 + exp(-(sum(contribution) - 1.2::DOUBLE))), 8) AS probability FROM ({PARTS}) GROUP BY application_id")
def l16_contributions_rebuild_probability(t: Tables):
    return features.rebuilt_probability(features.contributions(t.risk, t.coefficients, NAMES), -1.2)


@query("risk", "SELECT application_id, utilization, debt_to_income, prior_delinquencies, round(ln(1 + principal_cents / 100), 8) AS log_principal, CASE WHEN segment = 'small_business' THEN 1::DOUBLE ELSE 0::DOUBLE END AS small_business FROM risk")
def l01_design_matrix(t: Tables):
    rows = features.design_matrix(t.risk)
    return rows.select("application_id", *NAMES, F.round("log_principal", 8).alias("log_principal"), "small_business")


@query(
    "risk",
    """s AS (SELECT avg(utilization) AS m, stddev_pop(utilization) AS d, avg(debt_to_income) AS m2, stddev_pop(debt_to_income) AS d2 FROM risk WHERE decision_at < DATE '1997-01-01')
    SELECT application_id, round((utilization - m) / d, 7) AS utilization, round((debt_to_income - m2) / d2, 7) AS debt_to_income FROM risk, s""",
)
def l02_standardize(t: Tables):
    out = features.standardize(t.risk.filter(F.col("decision_at") < F.lit("1997-01-01").cast("date")), t.risk, ("utilization", "debt_to_income"))
    return out.select("application_id", F.round("utilization", 7).alias("utilization"), F.round("debt_to_income", 7).alias("debt_to_income"))


@query("predictions", "SELECT application_id, round(CAST(raw_pd AS DOUBLE), 6) AS grid FROM predictions")
def l05_calibration_grid(t: Tables):
    return t.predictions.select("application_id", features.calibration_grid(F.col("raw_pd").cast("double")).alias("grid"))


@query(
    "risk",
    """holes AS (SELECT application_id, decision_at, CASE WHEN k % 11 <> 0 THEN utilization END AS u FROM risk), m AS (SELECT quantile_cont(u, 0.5) AS med FROM holes WHERE decision_at < DATE '1997-01-01')
    SELECT application_id, coalesce(u, med) AS utilization, CAST(u IS NULL AS INTEGER) AS utilization_missing FROM holes, m""",
)
def l08_impute_median(t: Tables):
    holes = t.risk.withColumn("utilization", F.when(F.col("k") % 11 != 0, F.col("utilization")))
    out = features.impute_median(holes.filter(F.col("decision_at") < F.lit("1997-01-01").cast("date")), holes, "utilization")
    return out.select("application_id", "utilization", "utilization_missing")


@query("predictions", "SELECT segment, round(avg(label), 8) AS rate FROM predictions WHERE decision_at < DATE '1997-01-01' GROUP BY segment")
def l09_constant_model(t: Tables):
    return t.predictions.filter(F.col("decision_at") < F.lit("1997-01-01").cast("date")).groupBy("segment").agg(F.round(F.avg("label"), 8).alias("rate"))


@query("risk", "SELECT application_id, round(0.5::DOUBLE * utilization + 0.3::DOUBLE * debt_to_income + 0.2::DOUBLE * least(prior_delinquencies, 5) / 5, 8) AS score FROM risk")
def l10_business_rule_score(t: Tables):
    return t.risk.select("application_id", F.round(features.business_rule(*map(F.col, NAMES)), 8).alias("score"))


TRAIN = "train AS (SELECT r.*, p.label FROM risk r JOIN predictions p USING (application_id) WHERE r.decision_at < DATE '1997-01-01')"
QUINT = "list_sort(list_distinct(quantile_cont({0}, [0.2, 0.4, 0.6, 0.8])))"
FEW = "(SELECT list((v + nxt) / 2 ORDER BY v) FROM (SELECT v, lead(v) OVER (ORDER BY v) AS nxt FROM (SELECT DISTINCT prior_delinquencies AS v FROM train)) WHERE nxt IS NOT NULL)"
CUTS = f"""{TRAIN}, cuts AS (SELECT 'utilization' AS name, {QUINT.format('utilization')} AS cuts FROM train UNION ALL SELECT 'debt_to_income', {QUINT.format('debt_to_income')} FROM train UNION ALL SELECT 'prior_delinquencies', {FEW})"""
TALL = "SELECT application_id, {0} 'utilization' AS name, utilization AS value FROM {1} UNION ALL SELECT application_id, {0} 'debt_to_income', debt_to_income FROM {1} UNION ALL SELECT application_id, {0} 'prior_delinquencies', prior_delinquencies FROM {1}"
BINS = f"""{CUTS}, tall AS ({TALL.format('label,', 'train')}), bins AS (
  SELECT name, len(list_filter(cuts, lambda c: c <= value)) AS bin, count(*) FILTER (WHERE label = 1) AS events, count(*) FILTER (WHERE label = 0) AS non_events, max(len(cuts)) + 1 AS b FROM tall JOIN cuts USING (name) GROUP BY name, bin
), totals AS (SELECT count(*) FILTER (WHERE label = 1) AS e, count(*) FILTER (WHERE label = 0) AS n FROM train
), woe AS (SELECT name, CAST(bin AS INTEGER) AS bin, events, non_events, ln(((events + 0.5) / (e + 0.5 * b)) / ((non_events + 0.5) / (n + 0.5 * b))) AS woe FROM bins, totals)"""
MOVED = f"{BINS}, moved AS (SELECT application_id, x.name, value, coalesce(woe, 0) AS woe FROM ({TALL.format('', 'risk')}) x JOIN cuts USING (name) LEFT JOIN woe w ON w.name = x.name AND w.bin = len(list_filter(cuts, lambda c: c <= value)))"


def woe_parts(t: Tables):
    train = t.risk.join(t.predictions.select("application_id", "label"), "application_id").filter(F.col("decision_at") < F.lit("1997-01-01").cast("date"))
    cuts = features.woe_cuts(train, NAMES)
    return cuts, features.woe_bins(train, cuts, NAMES)


@query("risk predictions", f"{CUTS} SELECT name, unnest(cuts) AS cut FROM cuts")
def l11_woe_cuts(t: Tables):
    return woe_parts(t)[0].select("name", F.explode("cuts").alias("cut"))


@query("risk predictions", f"{BINS} SELECT name, bin, events, non_events, round(woe, 8) AS woe FROM woe")
def l12_woe_bins(t: Tables):
    return woe_parts(t)[1].withColumn("woe", F.round("woe", 8))


@query("risk predictions", f"{MOVED} SELECT application_id, name, value, round(woe, 8) AS woe FROM moved")
def l13_woe_transform(t: Tables):
    cuts, bins = woe_parts(t)
    return features.woe_transform(t.risk, cuts, bins, NAMES).select("application_id", "name", "value", F.round("woe", 8).alias("woe"))


@query(
    "risk predictions coefficients",
    f"{MOVED} SELECT application_id, name, round(-coef * woe * (20 / ln(2)), 6) AS points, round(round(600 - 20 / ln(2) * ln(50) + 20 / ln(2) * 1.2::DOUBLE, 6), 6) AS base_points FROM moved JOIN coefficients USING (name)",
)
def l14_scorecard_points(t: Tables):
    cuts, bins = woe_parts(t)
    return features.scorecard_points(features.woe_transform(t.risk, cuts, bins, NAMES), t.coefficients, -1.2)


@query("scores", "SELECT application_id, method, round(CAST(score AS DOUBLE) / 3, 10) AS published FROM scores")
def l17_published_rounding(t: Tables):
    return t.scores.select("application_id", "method", features.published_rounding(F.col("score").cast("double") / 3).alias("published"))


UNIT = "CAST(CAST(('0x' || substring(sha256('7:' || application_id), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296"


@query(
    "predictions",
    f"""places AS (SELECT application_id, label, row_number() OVER (PARTITION BY label ORDER BY {UNIT} DESC, application_id) AS place, count(*) OVER (PARTITION BY label) AS n FROM predictions)
    SELECT application_id, label, CASE WHEN place <= (n * 20 + 50) // 100 THEN 'test' WHEN place <= (n * 40 + 50) // 100 THEN 'calibration' ELSE 'train' END AS stage FROM places""",
)
def l18_stratified_split(t: Tables):
    return features.stratified_split(t.predictions, "label", "application_id", 7).select("application_id", "label", "stage")
