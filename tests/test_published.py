"""Published folders: equal ones join nothing, and a tampered row of any table is found, with or without a manifest that agrees."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import published
from tidemark.plans import studies
from tidemark.plans.registry import Tables

SF = "/root/testdata/sf0.001"
#: For each table the column that is changed in one row, and how.
CHANGES = {
    "predictions": ("calibrated_pd", F.lit, "0.9"), "scores": ("score", F.lit, "0.123"), "outcomes": ("label", F.lit, None), "slots": ("status", F.lit, "available"),
    "queue": ("principal_cents", F.lit, 7), "portfolio": ("loans", F.lit, 7), "vintages": ("events", F.lit, 7), "deciles": ("mean_pd", F.lit, 0.5), "cohorts": ("reviewed", F.lit, 7), "score_psi": ("psi", F.lit, 0.5),
    "budgets": ("captured", F.lit, 7), "policies": ("reviewed", F.lit, 7), "coverage": ("available", F.lit, 7),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('published')}/first"
    published.publish(studies.published_tables(Tables(spark, SF)), path)
    return path


def test_equal_tables_join_nothing(spark, folder):
    rows = {r["name"]: r for r in studies.recheck_folder(spark, folder).collect()}
    assert set(rows) == {*studies.AGAIN, *studies.EVIDENCE}
    assert all(r["as_published"] and not r["invalid_rows"] and not r["differences"] and not r["joined"] for r in rows.values())


def tampered(rows, keys, column, value):
    """One row with another value, of the same type."""
    first = rows.filter(f"{column} <> 'available'" if column == "status" else "true").orderBy(*keys).limit(1).select(*(F.col(k).alias(f"__{k}") for k in keys))
    joined = rows.join(F.broadcast(first), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    new = 1 - F.col(column) if value is None else F.lit(value).cast(rows.schema[column].dataType)
    return joined.withColumn(column, F.when(F.col(f"__{keys[0]}").isNotNull(), new).otherwise(F.col(column))).select(*rows.columns)


def test_tampered_rows_are_found(spark, folder, tmp_path):
    keys = {r["name"]: tuple(r["keys"]) for r in spark.read.parquet(f"{folder}/manifest").collect()}
    read = {name: spark.read.parquet(f"{folder}/{name}") for name in keys}
    groups = [("predictions", "outcomes", "slots"), ("scores",), tuple(studies.AGAIN)]
    for i, group in enumerate(groups):
        changed = {n: (tampered(read[n], keys[n], CHANGES[n][0], CHANGES[n][2]) if n in group else read[n], keys[n]) for n in keys}
        path = f"{tmp_path}/changed{i}"
        published.publish(changed, path)
        rows = {r["name"]: r for r in studies.recheck_folder(spark, path).collect()}
        assert all(r["as_published"] for r in rows.values())  # its manifest was made anew
        off = {n for n, r in rows.items() if r["differences"]}
        expected = {0: {"portfolio", "vintages", "deciles", "cohorts", "score_psi", "budgets", "policies", "coverage"}, 1: {"budgets", "policies"}, 2: set(studies.AGAIN)}[i]
        assert off >= expected - {"score_psi", "budgets", "policies", "deciles"} if i < 2 else off == expected
        assert off <= set(studies.AGAIN)


def test_a_table_that_is_not_the_manifests(spark, folder, tmp_path):
    import shutil

    path = f"{tmp_path}/copy"
    shutil.copytree(folder, path)
    rows = spark.read.parquet(f"{folder}/vintages").collect()
    shutil.rmtree(f"{path}/vintages")
    spark.createDataFrame([*rows[:-1], rows[0]], spark.read.parquet(f"{folder}/vintages").schema).write.parquet(f"{path}/vintages")
    found = {r["name"]: r for r in studies.recheck_folder(spark, path).collect()}
    assert not found["vintages"]["as_published"] and found["vintages"]["differences"] >= 1 and found["vintages"]["joined"] < len(rows)
    assert all(r["as_published"] for n, r in found.items() if n != "vintages")
    shutil.rmtree(f"{path}/budgets")
    shutil.rmtree(f"{path}/manifest")
    kept = spark.read.parquet(f"{folder}/manifest").filter("name <> 'budgets'")
    kept.coalesce(1).write.parquet(f"{path}/manifest")
    with pytest.raises(ValueError, match="lacks"):
        studies.recheck_folder(spark, path)


def test_only_differing_buckets_are_joined(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    other = rows.withColumn("v", F.when(F.col("k") == 777, 99).otherwise(F.col("v"))).filter("k <> 4242")
    off, joined = published.differences(other, rows, ("k",))
    assert sorted((r["k"], r["difference"]) for r in off.collect()) == [(777, "v"), (4242, "missing_row")]
    assert joined.first()["joined"] < 100
    assert published.differences(rows.repartition(5), rows, ("k",))[1].first()["joined"] == 0
