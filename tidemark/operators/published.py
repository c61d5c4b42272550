"""Published folders: tables beside a manifest of their identities, and the recheck of a folder that someone else published.

Tables are compared by a tree of fingerprints.  Rows fall into buckets by a hash of their key; a bucket's fingerprint is the
sum of its rows' SHA-256 words, so it takes one pass and no order.  Buckets are summed into groups of FAN, and two trees are
compared from the root down.  Only rows of buckets that differ are joined.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.reconcile import fingerprint, reconcile, row_words, word_sum
from tidemark.sources import tables
from tidemark.sources.shared import stored, unused

#: Children of a node of the tree, and its levels below the root: FAN^LEVELS buckets.
FAN, LEVELS = 64, 2
WORDS = tuple(f"word_{i}" for i in range(4))

Made = dict[str, tuple[DataFrame, tuple[str, ...]]]


def _bucketed(rows: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    return rows.withColumn(name, F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(FAN**LEVELS)))


def tree(rows: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """``(level, bucket, rows, word_0, ..)`` of every node that has rows; level 0 is the root."""
    bucket, *words = unused(rows.columns, "bucket", *WORDS)
    hashed = _bucketed(rows, keys, bucket).select(bucket, *(w.alias(n) for w, n in zip(row_words(*columns), words, strict=True)))
    leaves = hashed.groupBy(F.col(bucket).alias("bucket")).agg(F.count("*").alias("rows"), *(word_sum(F.col(w)).alias(n) for w, n in zip(words, WORDS, strict=True)))
    # FAN^LEVELS rows at most from here on.
    levels = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"), "*")
    node = F.floor(F.col("bucket") / F.pow(F.lit(FAN), F.lit(LEVELS) - F.col("level"))).cast("long")
    return levels.groupBy("level", node.alias("bucket")).agg(F.sum("rows").alias("rows"), *(F.sum(w).alias(w) for w in WORDS))


def differing_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets in which two trees differ, found from the root down."""
    same = reduce(lambda x, y: x & y, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("rows", *WORDS)))
    both = a.alias("a").join(b.alias("b"), (F.col("a.level") == F.col("b.level")) & (F.col("a.bucket") == F.col("b.bucket")), "full_outer")
    off = both.filter(~same).select(F.coalesce("a.level", "b.level").alias("level"), F.coalesce("a.bucket", "b.bucket").alias("bucket"))
    off = stored(off, "differing")
    at = off.filter("level = 0").select("bucket")
    for level in range(1, LEVELS + 1):
        below = off.filter(F.col("level") == level).select("bucket", F.floor(F.col("bucket") / FAN).cast("long").alias("up"))
        at = below.join(at.withColumnRenamed("bucket", "up"), "up", "left_semi").select("bucket")
    return at


def differences(actual: DataFrame, expected: DataFrame, keys: tuple[str, ...], tolerance: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """``reconcile`` of the rows in buckets that differ, and how many rows those are."""
    columns = tuple(actual.columns)
    expected = expected.select(*columns)
    off = stored(differing_buckets(tree(actual, keys, columns), tree(expected, keys, columns)), "differing")
    if off.isEmpty():
        # Equal trees leave no row to join, so neither side is made once more.
        actual, expected = actual.limit(0), expected.limit(0)
    name = unused(list(columns), "bucket")[0]
    some = lambda rows: _bucketed(rows, keys, name).join(F.broadcast(off.withColumnRenamed("bucket", name)), name, "left_semi").drop(name)
    a, e = some(actual), some(expected)
    return reconcile(a, e, keys, tolerance), a.agg(F.count("*").alias("joined"))


def publish(made: Made, path: str) -> None:
    """Write each table with its columns, and the manifest of their keys and identities last."""
    entries = []
    for name, (rows, keys) in made.items():
        tables.write_table(rows, f"{path}/{name}", tuple(rows.columns))
        back = rows.sparkSession.read.parquet(f"{path}/{name}")
        entry = fingerprint(back, *back.columns)
        entries.append(entry.select(F.lit(name).alias("name"), F.array(*map(F.lit, keys)).alias("keys"), F.array(*map(F.lit, rows.columns)).alias("columns"), "rows", *WORDS))
    reduce(DataFrame.unionByName, entries).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")


def recheck(spark: SparkSession, path: str, again: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], rules: dict[str, Callable[[DataFrame], DataFrame]] | None = None, tolerance: float = 2e-6) -> DataFrame:
    """One row for each table of the folder: whether it is what the manifest says, rows that break its rules, and differences.

    ``again`` computes a table from the folder's own tables before it; one that it
    doesn't name is evidence, and ``rules`` give the rows of it that may not be.
    A table that the manifest lacks, or ``again`` names and the folder hasn't, is
    an error, as are other columns than the manifest's.
    """
    # One row a table: the list of the folder.
    entries = {r["name"]: r for r in spark.read.parquet(f"{path}/manifest").collect()}
    missing = sorted({*again, *(rules or {})} - set(entries))
    if missing:
        raise ValueError(f"the folder lacks {missing}")
    read = {name: tables.read_report_table(spark, f"{path}/{name}", tuple(r["columns"])) for name, r in entries.items()}
    out = []
    for name, entry in entries.items():
        own = fingerprint(read[name], *entry["columns"])
        as_said = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.lit(entry[c])) for c in ("rows", *WORDS)))
        row = own.select(F.lit(name).alias("name"), "rows", as_said.alias("as_published"))
        none = spark.range(1).select(F.lit(0).cast("long").alias("n"))
        broken = (rules or {}).get(name)
        row = row.crossJoin(broken(read[name]).agg(F.count("*").alias("invalid_rows")) if broken else none.withColumnRenamed("n", "invalid_rows"))
        if name in again:
            wanted = again[name](read)
            close = {c: tolerance for c, kind in wanted.dtypes if kind == "double"}
            off, joined = differences(read[name], wanted, tuple(entry["keys"]), close)
            row = row.crossJoin(off.agg(F.count("*").alias("differences"))).crossJoin(joined)
        else:
            row = row.crossJoin(none.select(F.col("n").alias("differences"), F.col("n").alias("joined")))
        out.append(row)
    return reduce(DataFrame.unionByName, out)
