"""Comparison of a recomputed table with a published one, and order-free table identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(actual: DataFrame, expected: DataFrame, keys: tuple[str, ...], tolerance: dict[str, float] | None = None) -> DataFrame:
    """Differences: a row for each key and column that isn't the same, and for each key on one side only.

    Columns named in ``tolerance`` may differ by that much; null equals only null.
    """
    tolerance = tolerance or {}
    columns = [c for c in expected.columns if c not in keys]
    a = actual.select(*keys, F.struct(*columns).alias("a"), F.lit(True).alias("has_a"))
    e = expected.select(*(F.col(k).alias(f"__{k}") for k in keys), F.struct(*columns).alias("e"), F.lit(True).alias("has_e"))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    both = a.join(e, on, "full_outer")
    checks = []
    for c in columns:
        x, y = F.col(f"a.{c}"), F.col(f"e.{c}")
        same = x.eqNullSafe(y)
        if c in tolerance:
            same = same | F.coalesce(F.abs(x.cast("double") - y.cast("double")) <= tolerance[c], F.lit(False))
        checks.append(F.when(~same, F.lit(c)))
    found = F.when(F.col("has_a").isNull(), F.array(F.lit("missing_row"))).when(F.col("has_e").isNull(), F.array(F.lit("unexpected_row"))).otherwise(F.array_compact(F.array(*checks)))
    return both.select(*(F.coalesce(k, f"__{k}").alias(k) for k in keys), F.explode(found).alias("difference"))


def group_coverage(actual: DataFrame, expected: DataFrame, *keys: str) -> DataFrame:
    """Expected keys that are absent or there more than once, and keys that nobody expects."""
    seen = actual.groupBy(*keys).agg(F.count("*").alias("rows"))
    both = seen.join(expected.select(*keys).distinct().withColumn("wanted", F.lit(1)), list(keys), "full_outer")
    return both.select(*keys, F.coalesce("rows", F.lit(0)).alias("rows"), F.col("wanted").isNotNull().alias("expected")).filter("not (expected and rows = 1)")


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows and sum of the rows' SHA-256 words: the same for the same rows in any order, and not for dropped or doubled ones."""
    return rows.agg(F.count("*").alias("rows"), *(word_sum(w).cast("string").alias(f"word_{i}") for i, w in enumerate(row_words(*columns))))


def row_words(*columns: str) -> list[Column]:
    """The four words of a row's SHA-256, which a fingerprint sums: whole numbers of 32 bits."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def word_sum(word: Column) -> Column:
    """The exact sum of 32-bit words, of their halves by themselves: decimals cost far more a row, and halves fit a long up to 10^14 rows."""
    high, low = F.sum(F.shiftright(word, 16)), F.sum(word.bitwiseAND(65535))
    return (high.cast("decimal(28,0)") * 65536 + low.cast("decimal(28,0)")).cast("decimal(30,0)")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one side, with the side, repeats counted."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
