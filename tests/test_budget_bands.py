"""All tables of budgets follow from one order of the scores, and row hashes are summed without decimals."""

import random

from pyspark.sql import functions as F

from tidemark.operators import contracts, ranking, reconcile, rollup
from tidemark.plans import studies
from tidemark.plans.registry import Tables


def test_bands_take_what_ranks_take(spark):
    rng = random.Random(3)
    ids = [f"A{i:04d}" for i in range(371)]
    scores = spark.createDataFrame([(m, i, s) for m, of in (("flat", lambda: 0.5), ("few", lambda: rng.choice([0.1, 0.2, None, float("nan")])), ("any", rng.random)) for i in ids for s in (of(),)], "method string, application_id string, score double")
    labels = {i: int(rng.random() < 0.3) for i in ids}
    outcomes = spark.createDataFrame([(i, labels[i], rng.choice(["1996-01", "1996-02", None]), rng.choice(["retail", "small_business"]), rng.randrange(10**6)) for i in ids[:-5]], "application_id string, label int, vintage string, segment string, principal_cents long")
    capacities = spark.createDataFrame([(p,) for p in (0, 1, 5, 10, 33, 100)], "percent int")
    chosen = ranking.multi_budget(scores, capacities, "score", "application_id").join(outcomes, "application_id").collect()
    table = {(r["method"], r["percent"]): r for r in rollup.budget_table(scores, outcomes, capacities).collect()}
    policies = rollup.capacity_policy_table(scores, outcomes, capacities).collect()
    assert set(table) == {(m, p) for m in ("flat", "few", "any") for p in (1, 5, 10, 33, 100)}
    for (m, p), r in table.items():
        own = [c for c in chosen if (c["method"], c["percent"]) == (m, p)]
        assert (r["reviewed"], r["captured"], r["total_events"]) == (len(own), sum(c["label"] for c in own), sum(labels[i] for i in ids[:-5]))
    for r in policies:
        own = [c for c in chosen if (c["method"], c["percent"]) == (r["method"], r["percent"]) and (r["group_type"] != "segment" or c["segment"] == r["group"]) and (r["group_type"] != "vintage" or (c["vintage"] or "all") == r["group"])]
        assert (r["reviewed"], r["captured_events"], r["captured_exposure_cents"]) == (len(own), sum(c["label"] for c in own), sum(c["label"] * c["principal_cents"] for c in own))
    assert len(policies) == 3 * 6 * (1 + 3 + 2)


def test_a_recheck_orders_the_scores_once(spark, monkeypatch):
    own, orders = ranking.global_rank, []
    monkeypatch.setattr(rollup, "global_rank", lambda rows, *args, **kwargs: orders.append(rows.columns) or own(rows, *args, **kwargs))
    studies.published_tables(Tables(spark, "/root/testdata/sf0.001"))
    assert sum("method" in columns for columns in orders) == 1


def test_word_sums_are_exact_and_no_decimals_are_summed(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("v"))
    words = [[int(x) for x in r] for r in rows.select(*reconcile.row_words("id", "v")).collect()]
    found = reconcile.fingerprint(rows, "id", "v").first()
    assert tuple(found) == (1000, *(str(sum(w[i] for w in words)) for i in range(4)))
    assert all(t == "bigint" for _, t in rows.select(*reconcile.row_words("id", "v")).dtypes)
    big = spark.range(3).select(F.lit(2**32 - 1).cast("long").alias("w"))
    assert int(big.agg(reconcile.word_sum(F.col("w"))).first()[0]) == 3 * (2**32 - 1)
    assert tuple(reconcile.fingerprint(rows.limit(0), "id", "v").first()) == (0, None, None, None, None)


def test_only_uneven_ids_are_looked_at(spark):
    rows = [(m, i, 0.1 * k) for k, m in enumerate(("a", "b", "c")) for i in ("x", "y", "z")]
    rows = [r for r in rows if r[:2] != ("b", "y")] + [("a", None, 0.5), ("c", "z", 0.9)]
    scores = spark.createDataFrame(rows, "method string, application_id string, score double")
    key = lambda r: (r["application_id"] or "", r["rows"], r["versions"])
    whole = contracts.same_population(scores, ("score",)).filter("rows <> 3")
    assert sorted(map(key, studies.uneven_scores(scores).collect())) == sorted(map(key, whole.collect())) == [("", 1, 1), ("y", 2, 2), ("z", 4, 4)]
