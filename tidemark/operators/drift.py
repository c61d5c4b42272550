"""Distances between a reference population and a current one.

Null is a group of the current rows like any other.  Values that are null, NaN or
infinite take no part in a distribution; they are counted apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import carried, join_same, quantiles, running_counts

SMOOTHING = 0.5
MINIMUM_ROWS = 20


def finite(value: str) -> Column:
    """``value`` where it is a finite number, else null."""
    number = F.col(value).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), F.col(value))


def reference_edges(reference: DataFrame, score: str) -> DataFrame:
    """One row: the distinct inner deciles of ``score``, or the middle of its range."""
    q = quantiles(reference.withColumn(score, finite(score)), score, tuple(i / 10 for i in range(1, 10)))
    inner = F.array_sort(F.array_distinct(F.filter(F.transform("q", lambda x: F.round(x, 10)), lambda x: (x > F.col("least")) & (x < F.col("greatest")))))
    return q.select(F.when(F.size(inner) > 0, inner).otherwise(F.array((F.col("least") + F.col("greatest")) / 2)).alias("edges"))


def assign_bins(rows: DataFrame, edges: DataFrame, score: str) -> DataFrame:
    """``bin``: how many edges lie at or below the score."""
    value = F.col(score).cast("double")
    return rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e <= value))).drop("edges")


def psi_bins(reference: DataFrame, current: DataFrame, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, smoothed shares and the component of each bin, for each group ``by`` of the current rows."""
    edges = reference_edges(reference, score)
    old = assign_bins(reference.filter(finite(score).isNotNull()), edges, score).groupBy("bin").agg(F.count("*").alias("reference_loans"))
    new = assign_bins(current.filter(finite(score).isNotNull()), edges, score).groupBy(*by, "bin").agg(F.count("*").alias("current_loans"))
    grid = edges.select(F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"), (F.size("edges") + 1).alias("bins"))
    totals = current.groupBy(*by).agg(F.count(finite(score)).alias("current_total"))
    # One row for each bin and group; the bins are ten at most.
    cells = totals.crossJoin(F.broadcast(grid)).join(F.broadcast(old), "bin", "left")
    cells = join_same(cells, new, (*by, "bin"), "left").fillna(0, ["reference_loans", "current_loans"])
    cells = cells.crossJoin(F.broadcast(reference.agg(F.count(finite(score)).alias("reference_total"))))
    share = lambda side: (F.col(f"{side}_loans") + SMOOTHING) / (F.col(f"{side}_total") + F.col("bins") * SMOOTHING)
    part = (share("current") - share("reference")) * F.log(share("current") / share("reference"))
    return cells.select(*by, (F.col("bin") + 1).alias("bin"), "reference_loans", "current_loans", F.round(share("reference"), 8).alias("reference_share"), F.round(share("current"), 8).alias("current_share"), part.alias("component"), "current_total")


def psi(reference: DataFrame, current: DataFrame, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Population stability index of each ``by``; null below MINIMUM_ROWS rows with a score."""
    out = psi_bins(reference, current, score, by).groupBy(*by).agg(F.sum("component").alias("total"), F.max("current_total").alias("rows"))
    return out.select(*by, "rows", F.when(F.col("rows") >= MINIMUM_ROWS, F.round("total", 6)).alias("psi"))


def _two_samples(reference: DataFrame, current: DataFrame, value: Column, by: tuple[str, ...]) -> DataFrame:
    """Reference and current counts at each value, the reference's for each group ``by`` of the current rows: as many rows as are asked for."""
    old = reference.groupBy(value.alias("value")).agg(F.count("*").alias("ref"))
    if by:
        old = old.crossJoin(current.select(*by).distinct())
    new = current.groupBy(*by, value.alias("value")).agg(F.count("*").alias("cur"))
    both = old.select(*by, "value", "ref", F.lit(0).cast("long").alias("cur")).unionByName(new.select(*by, "value", F.lit(0).cast("long").alias("ref"), "cur"))
    return both.groupBy(*by, "value").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))


def ecdf_counts(reference: DataFrame, current: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative counts of both samples at each of their finite values."""
    return running_counts(_two_samples(reference, current, finite(value), by).filter("value is not null"), "value", ("ref", "cur"), by)


def _turning_points(reference: DataFrame, current: DataFrame, value: str, keys: tuple[str, ...], same: tuple[str, ...]) -> DataFrame:
    """``(keys, value, cum_ref, cum_cur)``: for each value of a group its own point, and the last of the reference before it.

    Between two values of a group its own count stands still and the reference's
    only rises, so the gap is greatest at one of these two ends.  Reference values
    are laid once, whatever the number of groups, and a group's as often as it has them.
    """
    old = reference.groupBy(*same, finite(value).alias("value")).agg(F.count("*").alias("ref")).filter("value is not null")
    new = current.groupBy(*keys, finite(value).alias("value")).agg(F.count("*").alias("cur")).filter("value is not null")
    own = carried(new, keys, ("value",), cum_cur=("sum", "cur"), previous=("max_before", "value"))
    point = lambda kind, count, previous: own.select(*keys, "value", F.lit(kind).alias("kind"), count.alias("cum_cur"), previous.alias("previous"), F.lit(None).cast("long").alias("ref"))
    before, here = point(0, F.col("cum_cur") - F.col("cur"), F.col("previous")), point(2, F.col("cum_cur"), F.lit(None).cast(own.schema["value"].dataType))
    groups = [F.lit(None).cast(current.schema[c].dataType).alias(c) for c in keys if c not in same]
    moved = old.select(*same, *groups, "value", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("cum_cur"), F.lit(None).cast(own.schema["value"].dataType).alias("previous"), "ref")
    points = moved.unionByName(before).unionByName(here).withColumn("of_ref", F.when(F.col("kind") == 1, F.col("value")))
    placed = carried(points, same, ("value", "kind"), cum_ref=("sum", "ref"), last=("max", "of_ref"))
    between = F.col("last") > F.col("previous")
    kept = placed.filter((F.col("kind") == 2) | ((F.col("kind") == 0) & F.col("last").isNotNull() & F.coalesce(between, F.lit(True))))
    return kept.select(*keys, F.when(F.col("kind") == 2, F.col("value")).otherwise(F.col("last")).alias("value"), F.coalesce("cum_ref", F.lit(0)).alias("cum_ref"), "cum_cur")


def ks_distance(reference: DataFrame, current: DataFrame, value: str, by: tuple[str, ...] = (), same: tuple[str, ...] = ()) -> DataFrame:
    """Greatest gap of the two cumulative distributions, by whole numbers, and the least value that has it.

    ``by`` are groups of the current rows; ``same`` are columns of both sides, such as a feature's name.
    Every group is there; one without finite values on either side has no distance.
    """
    keys = (*same, *by)
    known, unknown = F.count(finite(value)), F.count_if(finite(value).isNull())
    sizes = current.groupBy(*keys).agg(known.alias("m"), unknown.alias("current_missing"))
    base = reference.groupBy(*same).agg(known.alias("n"), unknown.alias("reference_missing"))
    sizes = (join_same(sizes, base, same, "left") if same else sizes.crossJoin(F.broadcast(base))).fillna(0, ["n", "reference_missing"])
    points = _turning_points(reference, current, value, keys, same)
    joined = join_same(points, sizes, keys) if keys else points.crossJoin(F.broadcast(sizes))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    gap = joined.withColumn("gap", F.abs(big("cum_ref") * big("m") - big("cum_cur") * big("n")).cast("decimal(38,0)"))
    best = gap.groupBy(*keys).agg(F.min_by(F.struct("gap", "value", "cum_ref", "cum_cur"), F.struct((-F.col("gap")).alias("g"), F.col("value").alias("v"))).alias("x"))
    out = join_same(sizes, best, keys, "left") if keys else sizes.crossJoin(best)
    enough = (F.col("m") >= MINIMUM_ROWS) & (F.col("n") > 0)
    some = lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0))
    return out.select(
        *keys,
        F.when(enough, F.round(F.col("x.gap").cast("double") / (some("n") * some("m")), 6)).alias("distance"),
        F.col("x.value").alias("at_value"),
        F.round(F.col("x.cum_ref") / some("n"), 8).alias("reference_cdf"),
        F.round(F.col("x.cum_cur") / some("m"), 8).alias("current_cdf"),
        F.when(enough, "ok").otherwise("insufficient_sample").alias("status"),
        "reference_missing",
        "current_missing",
    )


def category_shares(reference: DataFrame, current: DataFrame, value: str, categories: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and shares of every category in both populations, for each group ``by`` of the current rows; absent ones stay, with zero."""
    listed = reference.sparkSession.createDataFrame([(c,) for c in categories], "value string")
    seen = _two_samples(reference, current, F.col(value), by)
    totals = current.groupBy(*by).agg(F.count("*").alias("m")).crossJoin(F.broadcast(reference.agg(F.count("*").alias("n"))))
    out = join_same(totals.crossJoin(F.broadcast(listed)), seen, (*by, "value"), "left").fillna(0, ["ref", "cur"])
    return out.select(*by, "value", F.col("ref").alias("reference_count"), F.col("cur").alias("current_count"), F.round(F.col("ref") / F.col("n"), 8).alias("reference_share"), F.round(F.col("cur") / F.col("m"), 8).alias("current_share"), "n", "m")


def total_variation(reference: DataFrame, current: DataFrame, value: str, categories: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Half the summed differences of the shares."""
    shares = category_shares(reference, current, value, categories, by)
    gap = F.abs(F.col("reference_count") * F.col("m") - F.col("current_count") * F.col("n"))
    return shares.groupBy(*by).agg(F.round(F.sum(gap).cast("double") / (F.max("n").cast("double") * F.max("m") * 2), 6).alias("distance"))


def finite_share(value: Column) -> Column:
    """Whether a score is a finite probability."""
    return value.isNotNull() & ~F.isnan(value.cast("double")) & value.between(0, 1)
