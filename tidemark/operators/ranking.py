"""Global orders without a global task: ranks, capacities, buckets and cumulative counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import stored, unused



def join_same(left: DataFrame, right: DataFrame, columns: tuple[str, ...], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, by equality of ``columns``, where nulls equal nulls."""
    others = [c for c in right.columns if c not in columns]
    keys = unused([*left.columns, *others], *columns)
    named = right.select(*(F.col(c).alias(k) for c, k in zip(columns, keys, strict=True)), *others)
    condition = reduce(lambda a, b: a & b, (left[c].eqNullSafe(named[k]) for c, k in zip(columns, keys, strict=True)))
    return left.join(named, condition, how).drop(*keys)


def _number(value: Column) -> Column:
    """``value``, with NaN as null."""
    return F.when(~F.isnan(value.try_cast("double")), value)


def laid_by_range(rows: DataFrame, order: list[Column], at: str) -> DataFrame:
    """``rows`` sorted by range and stored, with their partition and place in ``at``.

    A range is a share of the rows, whatever their values; equal sort keys may
    lie on both sides of its edge.
    """
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ordered")


def global_rank(rows: DataFrame, score: str, tie: str, by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """Rank by ``score`` down, then ``tie`` up, within ``by``; null and NaN scores come last, and null is a group like any other.

    Rows are sorted by range into a stored table, where a row knows its place in
    its range; a running sum over the ranges' counts in each group shifts it.
    No task sees a whole group, however its scores lie.
    """
    at, part, n, before = unused([*rows.columns, name], "at", "part", "n", "before")
    order = [*(F.asc_nulls_first(c) for c in by), F.desc_nulls_last(_number(F.col(score))), F.asc_nulls_first(tie)]
    placed = laid_by_range(rows, order, at).withColumn(part, F.shiftright(at, 33))
    ranges = placed.groupBy(*by, part).agg(F.count("*").alias(n), F.min(at).alias(at))
    upto = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*by, part, (F.coalesce(F.sum(n).over(upto), F.lit(0)) - F.col(at) + 1).alias(before))
    out = join_same(placed, ranges, (*by, part))
    return out.select(*(F.col(c) for c in rows.columns), (F.col(at) + F.col(before)).cast("long").alias(name))


def _counts(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("__n"))


def with_total(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return join_same(rows, _counts(rows, by), by) if by else rows.crossJoin(F.broadcast(_counts(rows, by)))


def select_capacity(rows: DataFrame, percent: int, score: str, tie: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The first ``percent`` of each ``by``, rounded up, with their rank."""
    ranked = with_total(global_rank(rows, score, tie, by), by)
    return ranked.filter(F.col("rank") <= F.expr(f"(__n * {percent} + 99) div 100")).drop("__n")


def multi_budget(rows: DataFrame, capacities: DataFrame, score: str, tie: str, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """The selections of every capacity and ``by`` at once."""
    ranked = with_total(global_rank(rows, score, tie, by), by)
    return ranked.crossJoin(F.broadcast(capacities)).filter(F.col("rank") <= F.expr("(__n * percent + 99) div 100")).drop("__n")


def rank_buckets(rows: DataFrame, n: int, score: str, tie: str, name: str = "bucket") -> DataFrame:
    """``n`` buckets by rank, sizes at most one apart, larger ones first."""
    ranked = with_total(global_rank(rows, score, tie))
    q, r, i = F.expr(f"__n div {n}"), F.col("__n") % n, F.col("rank") - 1
    head = r * (q + 1)
    bucket = F.when(i < head, F.floor(i / (q + 1))).otherwise(r + F.floor((i - head) / F.greatest(q, F.lit(1)))) + 1
    return ranked.withColumn(name, bucket.cast("int")).drop("__n", "rank")


def running_counts(values: DataFrame, value: str, counts: tuple[str, ...], by: tuple[str, ...] = (), totals: bool = False) -> DataFrame:
    """Running sums ``cum_<count>`` of ``counts`` over the values of each ``by``, without one task for all values.

    ``values`` has one row a value of any type with an order; null and NaN come
    last.  With ``totals`` the sums over the whole group are there too, as
    ``all_<count>``.
    """
    at, part = unused(values.columns, "at", "part")
    order = [*(F.asc_nulls_first(c) for c in by), F.asc_nulls_last(_number(F.col(value)))]
    placed = laid_by_range(values, order, at).withColumn(part, F.shiftright(at, 33))
    sums = placed.groupBy(*by, part).agg(*(F.sum(c).alias(f"sum_{c}") for c in counts))
    upto = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(*by, part, *(F.coalesce(F.sum(f"sum_{c}").over(upto), F.lit(0)).alias(f"before_{c}") for c in counts), *(F.sum(f"sum_{c}").over(Window.partitionBy(*by)).alias(f"all_{c}") for c in counts))
    inside = Window.partitionBy(*by, part).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.select("*", *(F.sum(c).over(inside).alias(f"in_{c}") for c in counts))
    out = join_same(placed, shifts, (*by, part))
    cumulated = [(F.col(f"before_{c}") + F.col(f"in_{c}")).alias(f"cum_{c}") for c in counts]
    return out.select(*values.columns, *cumulated, *([f"all_{c}" for c in counts] if totals else []))


def carried(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], /, **folds: tuple[str, str]) -> DataFrame:
    """``rows`` with a column for each of ``folds``, name to (kind, column), over their ``by`` in ``order``; null is a group like any other.

    Kinds: ``sum`` and ``max`` of the column from the first row up to each, and
    ``max_before``, up to the row before.  Rows are laid by range, each range is
    folded by itself, and what its earlier ranges end with is carried over its
    edge, so one group may fill many tasks.
    """
    taken = [*rows.columns, *folds]
    at, part = unused(taken, "at", "part")
    edge, own = ({n: unused(taken, f"{what}_{n}")[0] for n in folds} for what in ("before", "inside"))
    fold = {n: F.sum if kind == "sum" else F.max for n, (kind, _) in folds.items()}
    placed = laid_by_range(rows, [*(F.asc_nulls_first(c) for c in by), *(F.asc(c) for c in order)], at).withColumn(part, F.shiftright(at, 33))
    ends = placed.groupBy(*by, part).agg(*(fold[n](c).alias(own[n]) for n, (_, c) in folds.items()))
    upto = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # Only groups that lie in more than one range have something to carry.
    first = ends.select(*by, part, F.row_number().over(Window.partitionBy(*by).orderBy(part)).alias(at), *(fold[n](own[n]).over(upto).alias(edge[n]) for n in folds))
    edges = first.filter(F.col(at) > 1).drop(at)
    last = {n: -1 if kind == "max_before" else Window.currentRow for n, (kind, _) in folds.items()}
    inside = Window.partitionBy(*by, part).orderBy(at)
    placed = placed.select("*", *(fold[n](c).over(inside.rowsBetween(Window.unboundedPreceding, last[n])).alias(own[n]) for n, (_, c) in folds.items()))
    out = join_same(placed, edges, (*by, part), "left")

    def both(n: str) -> Column:
        if folds[n][0] == "sum":
            return F.coalesce(F.col(own[n]) + F.col(edge[n]), own[n], edge[n])
        return F.array_max(F.array(own[n], edge[n]))

    return out.select(*rows.columns, *(both(n).alias(n) for n in folds))


def quantiles(rows: DataFrame, value: str, fractions: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, q, least, greatest, n)``: interpolated percentiles of the values that are there, from counts of each value; no task holds them all."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    upto = running_counts(counts, "value", ("n",), by, totals=True)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("cum_n") - F.col("n") <= place) & (place < F.col("cum_n")), F.col("value")))

    def quantile(f: float) -> Column:
        place = F.lit(f) * (F.col("all_n") - 1)
        off = F.max(place - F.floor(place))
        return F.when(off == 0, at(F.floor(place))).otherwise((1 - off) * at(F.floor(place)) + off * at(F.ceil(place)))

    return upto.groupBy(*by).agg(F.array(*map(quantile, fractions)).alias("q"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.sum("n").alias("n"))


def reason_rank(rows: DataFrame, key: str, size: Column, ordinal: str) -> DataFrame:
    """Rank of each row inside its ``key`` by ``size`` down, then ``ordinal``."""
    return rows.withColumn("reason_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(size), ordinal)))


def earliest_per_group(rows: DataFrame, group: str, time: str, tie: str) -> DataFrame:
    """The first row of each group by (time, tie), without a window: partial minima go before the shuffle."""
    rest = [c for c in rows.columns if c != group]
    return rows.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(time, tie)).alias("x")).select(group, "x.*")


def hash_sample(rows: DataFrame, by: str, key: Column, n: int | dict[str, int], seed: str, digits: int = 4) -> DataFrame:
    """The ``n`` rows of each ``by`` with the lowest SHA-256 of seed and key, or as many as ``n`` has for that ``by``; null is a group like any other.

    Rows are counted by the leading ``digits`` of their hash; those above the one
    where the sample ends are dropped before any order is made.  What is ranked in
    one task is the sample and the rest of one count, a share of 16^-digits of
    the group.  ``rows`` are read twice.
    """
    hashed = rows.withColumn("sample_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key, F.lit(""))), 256))
    lead, size = F.substring("sample_hash", 1, digits), F.lit(n)
    if isinstance(n, dict):
        listed = F.create_map(*(F.lit(x) for pair in n.items() for x in pair)) if n else F.lit(None).cast("map<string,int>")
        size = F.coalesce(F.try_element_at(listed, F.coalesce(by, F.lit(""))), F.lit(0))
    lead_col, upto, least = unused([*hashed.columns], "lead", "upto", "least")
    counts = hashed.groupBy(by, lead.alias(lead_col)).agg(F.count("*").alias(upto))
    before = Window.partitionBy(by).orderBy(lead_col).rowsBetween(Window.unboundedPreceding, -1)
    # The last count that the sample needs is the greatest one with less than n rows before it.
    cuts = counts.withColumn(upto, F.coalesce(F.sum(upto).over(before), F.lit(0))).filter(F.col(upto) < size).groupBy(by).agg(F.max(lead_col).alias(least))
    some = join_same(hashed, cuts, (by,)).filter(lead <= F.col(least)).drop(least)
    place = F.row_number().over(Window.partitionBy(by).orderBy("sample_hash"))
    return some.withColumn(upto, place).filter(F.col(upto) <= size).drop(upto)
