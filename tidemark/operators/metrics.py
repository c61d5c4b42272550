"""Quality of frozen scores, exact under ties, and block bootstrap by weights."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import join_same, laid_by_range, running_counts, select_capacity
from tidemark.sources.shared import stored

#: Distinct scores that the bootstrap's vectors by month are formed for at a time.
SCORES_AT_ONCE = 2048


def _known(rows: DataFrame, score: str, label: str) -> DataFrame:
    return rows.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).try_cast("double")) & F.col(label).isin(0, 1))


def _squares(score: str) -> tuple[Column, Column]:
    """Squared distances of a score from 1 and from 0, exact in twenty places; null for what is no number from 0 to 1."""
    p = F.col(score).try_cast("decimal(12,10)")
    inside = lambda x: F.when(p.between(0, 1), x.cast("decimal(21,20)"))
    return inside((1 - p) * (1 - p)), inside(p * p)


def _squared_error(score: str) -> Column:
    """Summed squared errors of counts ``pos`` and ``neg`` (below 10^16 each); null if any score is no probability."""
    from_one, from_zero = _squares(score)
    total = F.sum(F.col("pos").cast("decimal(16,0)") * from_one + F.col("neg").cast("decimal(16,0)") * from_zero)
    return F.when(F.every(from_one.isNotNull()), total)


def score_counts(rows: DataFrame, score: str, label: str, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """Events and non-events at each distinct score; rows without a score or a label of 0 or 1 don't count."""
    w = F.lit(1) if weight is None else weight
    event = F.sum(F.when(F.col(label) == 1, w).otherwise(0)).cast("long")
    return _known(rows, score, label).groupBy(*by, F.col(score).alias("score")).agg(event.alias("pos"), (F.sum(w).cast("long") - event).alias("neg"))


def quality(rows: DataFrame, score: str, label: str, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """AUC (ties count half), average precision and Brier score of each ``by``; null where a class is missing.

    One pass of running counts serves all three: what lies above a score is the
    total less what lies below.  Null is a group like any other.  The first two
    take scores of any type with an order, such as points; the Brier score is
    null where a score is no number from 0 to 1.
    """
    up = running_counts(score_counts(rows, score, label, by, weight), "score", ("pos", "neg"), by, totals=True)
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    area = F.sum(whole("pos") * (F.col("cum_neg") * 2 - F.col("neg")).cast("decimal(18,0)")).cast("double") / 2
    pos, neg = F.sum("pos"), F.sum("neg")
    found, above = F.col("all_pos") - F.col("cum_pos") + F.col("pos"), F.col("all_neg") - F.col("cum_neg") + F.col("neg")
    precision = F.sum(F.col("pos").cast("double") * found / (found + above))
    off = _squared_error("score").cast("double")
    return up.groupBy(*by).agg(
        F.round(off / (pos + neg), 8).alias("brier"),
        (pos + neg).alias("records"),
        pos.alias("events"),
        F.round(area / F.nullif(pos.cast("double") * neg.cast("double"), F.lit(0.0)), 8).alias("auc"),
        F.round(precision / F.nullif(pos.cast("double"), F.lit(0.0)), 8).alias("average_precision"),
    )


def constant_baseline(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """What the training event rate scores on test rows."""
    rate = train.agg(F.avg(label).alias("rate"))
    own = test.agg(F.avg(label).alias("event_rate"))
    brier = F.col("event_rate") * (1 - F.col("rate")) * (1 - F.col("rate")) + (1 - F.col("event_rate")) * F.col("rate") * F.col("rate")
    return rate.crossJoin(own).select(F.lit(0.5).alias("auc"), F.round("event_rate", 8).alias("average_precision"), F.round(brier, 8).alias("brier"), F.round("rate", 8).alias("rate"))


def precision_capture(rows: DataFrame, percent: int, score: str, tie: str, label: str = "label") -> DataFrame:
    """Hits among the first ``percent`` of rows, by those reviewed and by all events."""
    top = select_capacity(rows, percent, score, tie).agg(F.count("*").alias("reviewed"), F.sum(label).cast("long").alias("hits"))
    return top.crossJoin(rows.agg(F.sum(label).cast("long").alias("events"))).select("reviewed", "hits", "events", F.round(F.col("hits") / F.col("reviewed"), 8).alias("precision"), F.round(F.col("hits") / F.col("events"), 8).alias("capture"))


def bootstrap_draws(months: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``(replicate, vintage, weight)``: as many months drawn with replacement as there are, by SHA-256 of seed, replicate and slot.

    The list of months, not their rows, is broadcast: one entry a month of the calendar.  Null is a month like any other, the first one.
    Where there is no month, nothing is drawn.
    """
    listed = months.select("vintage").distinct().agg(F.sort_array(F.collect_set(F.struct("vintage"))).alias("all"))
    slots = months.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate")).crossJoin(F.broadcast(listed))
    drawn = slots.filter(F.size("all") > 0).select("replicate", "all", F.explode(F.sequence(F.lit(0), F.size("all") - 1)).alias("slot"))
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("replicate"), F.col("slot")), 256), 1, 8)
    index = (F.conv(digits, 16, 10).cast("long") % F.size("all")).cast("int")
    return drawn.select("replicate", F.get("all", index)["vintage"].alias("vintage")).groupBy("replicate", "vintage").agg(F.count("*").cast("int").alias("weight"))


class _Weights:
    """Months and their weights in each replicate: a number for each of both, which every task has."""

    def __init__(self, draws: DataFrame) -> None:
        found = draws.select("replicate", "vintage", "weight").toArrow().to_pydict()
        self.replicates = sorted(set(found["replicate"]))
        self.months = {m: i for i, m in enumerate(dict.fromkeys(found["vintage"]))}
        place = {r: i for i, r in enumerate(self.replicates)}
        self.matrix = np.zeros((len(self.months), len(self.replicates)))
        for r, m, w in zip(found["replicate"], found["vintage"], found["weight"], strict=True):
            self.matrix[self.months[m], place[r]] += w


def _folded(weights: _Weights, precision: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What one range of a group's scores adds to the pairs of months and to each replicate's sum of precisions."""

    def run(rows: pa.Table, offsets: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        m = len(weights.months)
        month = np.array([weights.months.get(x, m) for x in rows.column("vintage").to_pylist()], np.int64)
        place = np.array([weights.months.get(x, m) for x in offsets.column("vintage").to_pylist()], np.int64)

        def vector(name: str) -> np.ndarray:
            out = np.zeros(m + 1, np.int64)
            out[place] = offsets.column(name).to_numpy()
            return out

        below, above_pos, above_neg = vector("below_neg"), vector("above_pos"), vector("above_neg")
        pos, neg, score = rows.column("pos").to_numpy(), rows.column("neg").to_numpy(), rows.column("score").combine_chunks()
        changed = np.append(True, pc.not_equal(score[1:], score[:-1]).to_numpy(zero_copy_only=False)) if len(score) else np.zeros(0, bool)
        group = np.cumsum(changed) - 1
        pairs, gained = np.zeros((m + 1, m + 1), np.int64), np.zeros(len(weights.replicates))
        # From the greatest score of the range down, what is left of the range lies at or above a score.
        here_pos, here_neg = np.bincount(month, pos, m + 1).astype(np.int64), np.bincount(month, neg, m + 1).astype(np.int64)
        starts = np.searchsorted(group, np.arange(0, group[-1] + 1 if len(group) else 0, SCORES_AT_ONCE))
        for low, high in zip(starts, [*starts[1:], len(group)], strict=True):
            own, cell = slice(low, high), (group[low:high] - group[low]) * (m + 1) + month[low:high]
            n = int(group[high - 1] - group[low]) + 1
            count = lambda x: np.bincount(cell, x[own], n * (m + 1)).astype(np.int64).reshape(n, m + 1)  # noqa: E731, B023
            p, q = count(pos), count(neg)
            under_pos, under_neg = np.cumsum(p, axis=0) - p, np.cumsum(q, axis=0) - q
            twice = 2 * (below + under_neg) + q
            for i in np.unique(month[own][pos[own] > 0]):
                pairs[i] += p[:, i] @ twice
            if precision:
                found, over = (above_pos + here_pos - under_pos)[:, :m] @ weights.matrix, (above_neg + here_neg - under_neg)[:, :m] @ weights.matrix
                gained += (p[:, :m] @ weights.matrix * found / np.maximum(found + over, 1)).sum(axis=0)
            below, here_pos, here_neg = below + q.sum(axis=0), here_pos - p.sum(axis=0), here_neg - q.sum(axis=0)
        i, j = np.nonzero(pairs[:m, :m])
        key = offsets.column("of")[0].as_py()
        out = [("pairs", i, j, pairs[i, j], np.zeros(len(i)))]
        if precision:
            r = np.array(weights.replicates)
            out.append(("gained", r, r, np.zeros(len(r), np.int64), gained))
        parts = [pa.table({"key": pa.array([key] * len(a), pa.string()), "what": pa.array([what] * len(a), pa.string()), "i": pa.array(a, pa.int64()), "j": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64()), "x": pa.array(x, pa.float64())}) for what, a, b, n, x in out]
        return pa.concat_tables(parts)

    return run


def _areas(weights: _Weights) -> Callable[[pa.Table], pa.Table]:
    """Twice the area of each replicate: the months' weights on both sides of the pairs' matrix."""

    def run(pairs: pa.Table) -> pa.Table:
        matrix = np.zeros((len(weights.months),) * 2)
        matrix[pairs.column("i").to_numpy(), pairs.column("j").to_numpy()] = pairs.column("n").to_numpy()
        area = np.einsum("mr,mr->r", weights.matrix, matrix @ weights.matrix)
        return pa.table({"key": pa.array([pairs.column("key")[0].as_py()] * len(area), pa.string()), "replicate": pa.array(weights.replicates, pa.int32()), "area": area})

    return run


def block_bootstrap(rows: DataFrame, draws: DataFrame, score: str, label: str, by: tuple[str, ...] = (), precision: bool = False) -> DataFrame:
    """AUC, Brier score and, if asked for, average precision of every replicate; no row meets a replicate.

    AUC is a quadratic form in the months' weights.  One pass in the order of the
    scores gives pairs[m, k], the events of month m above non-events of month k
    (ties half), for each ``by``; a replicate's area is its weights times that
    matrix times its weights.  Squared errors are summed by month.  Average
    precision is folded in the same pass from running vectors by month.

    Scores are laid by range, a row for each score and month, however many
    replicates there are; sums by range, month and group shift a range's vectors.
    What every task has is ``draws``, one number for each month and replicate.
    """
    keyed = _known(rows, score, label).withColumn("key", F.to_json(F.struct(*by)))
    event = F.count_if(F.col(label) == 1)
    counts = keyed.groupBy("key", *by, F.col(score).alias("score"), "vintage").agg(event.alias("pos"), (F.count("*") - event).alias("neg"))
    laid = laid_by_range(counts, [F.asc("key"), F.asc("score")], "at").withColumn("part", F.shiftright("at", 33))
    groups = laid.select("key", *by).distinct()
    weights = _Weights(draws)

    sums = laid.groupBy("key", "part", "vintage").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    grid = laid.select("key", "part").distinct().join(laid.select("key", "vintage").distinct(), "key")
    full = join_same(grid, sums, ("key", "part", "vintage"), "left").fillna(0, ["pos", "neg"])
    upto = Window.partitionBy("key", "vintage").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("key", "vintage").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    some = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    offsets = full.select(F.col("key").alias("of"), F.col("part").alias("of_part"), "vintage", some("neg", upto).alias("below_neg"), some("pos", after).alias("above_pos"), some("neg", after).alias("above_neg"))
    columns = laid.select("key", "part", "at", "vintage", "score", "pos", "neg")
    folded = columns.groupBy("key", "part").cogroup(offsets.groupBy("of", "of_part")).applyInArrow(_folded(weights, precision), "key string, what string, i long, j long, n long, x double")
    folded = folded.groupBy("key", "what", "i", "j").agg(F.sum(F.col("n").cast("decimal(38,0)")).cast("double").alias("n"), F.sum("x").alias("x"))
    areas = folded.filter("what = 'pairs'").groupBy("key").applyInArrow(_areas(weights), "key string, replicate int, area double")

    months = counts.groupBy("key", "vintage").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), _squared_error("score").alias("off"), F.every(_squares("score")[0].isNotNull()).alias("probable"))
    drawn = join_same(months, draws, ("vintage",))
    times = lambda c: F.sum(F.col(c) * F.col("weight"))
    whole = drawn.groupBy("key", "replicate").agg(times("pos").alias("pos"), times("neg").alias("neg"), F.when(F.every("probable"), F.sum((F.col("off") * F.col("weight")).cast("decimal(38,20)"))).cast("double").alias("off"))
    whole = whole.join(areas, ["key", "replicate"], "left")
    gained = F.lit(None).cast("double")
    if precision:
        whole = whole.join(folded.filter("what = 'gained'").select("key", F.col("i").cast("int").alias("replicate"), "x"), ["key", "replicate"])
        gained = F.col("x")
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    none = lambda c: F.nullif(c, F.lit(0.0))
    return whole.join(groups, "key").select(
        "replicate",
        *by,
        F.round(F.col("off") / (pos + neg), 8).alias("brier"),
        (F.col("pos") + F.col("neg")).alias("records"),
        F.col("pos").alias("events"),
        F.round(F.coalesce("area", F.lit(0.0)) / 2 / none(pos * neg), 8).alias("auc"),
        F.round(gained / none(pos), 8).alias("average_precision"),
    )


def difference(a: Column, b: Column) -> Column:
    """``a`` - ``b`` of metrics in eight places, to seven, halves away from zero."""
    exact = lambda c: c.cast("decimal(12,8)")
    return F.round(exact(a) - exact(b), 7).cast("double")


def paired_metric(replicates: DataFrame, metric: str, reference: str, by: str = "method") -> DataFrame:
    """A metric of each ``by`` less that of ``reference``, replicate by replicate."""
    base = replicates.filter(F.col(by) == reference).select("replicate", F.col(metric).alias("base"))
    return replicates.filter(F.col(by) != reference).join(base, "replicate").select(by, "replicate", difference(F.col(metric), F.col("base")).alias("difference"))


def quantile_interval(values: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """2.5 and 97.5 percentiles, interpolated, of the values that are there."""
    out = values.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(value).alias("valid"))
    return out.select(*by, F.round(F.get("q", 0), 8).alias("low"), F.round(F.get("q", 1), 8).alias("high"), "valid")


def capture_bootstrap(ranked: DataFrame, draws: DataFrame, capacities: DataFrame, by: str = "method", per_cell: int = 256, cells: int = 512) -> DataFrame:
    """Events captured by each ``by`` and capacity in every replicate, with months as often as drawn.

    ``ranked`` has ``rank`` within ``by``.  A row drawn w times takes w places;
    the last one inside the budget may count in part.

    Rows are counted by month in at most ``cells`` cells of ``per_cell`` ranks or
    more, and the counts, not the rows, meet the replicates: months times cells
    for each ``by``, however many rows there are.  Only the cell that holds a
    budget's end is opened: its rows meet the replicates whose budget ends there.
    """
    # Read for the cells' size, the counts and the opened cells.
    rows = stored(ranked.select(by, "rank", "label", "vintage"), "ranked")
    size = max(per_cell, -(-(rows.agg(F.max("rank")).first()[0] or 0) // cells))
    celled = rows.withColumn("cell", F.expr(f"(rank - 1) div {size}"))
    counts = celled.groupBy(by, "cell", "vintage").agg(F.count("*").alias("rows"), F.sum("label").alias("hits"))
    weighted = counts.join(draws, "vintage").groupBy(by, "replicate", "cell").agg(F.sum(F.col("rows") * F.col("weight")).alias("rows"), F.sum(F.col("hits") * F.col("weight")).alias("hits"))
    upto = running_counts(weighted, "cell", ("rows", "hits"), (by, "replicate"), totals=True)
    ends = upto.crossJoin(F.broadcast(capacities)).withColumn("k", F.expr("(all_rows * percent + 99) div 100"))
    full = ends.filter("cum_rows <= k").groupBy(by, "replicate", "percent").agg(F.max("cum_hits").alias("hits"))
    cut = ends.filter("cum_rows > k and cum_rows - rows < k").select(by, "replicate", "percent", "cell", (F.col("k") - F.col("cum_rows") + F.col("rows")).alias("left"))
    opened = celled.join(draws, "vintage").join(cut, [by, "replicate", "cell"])
    place = Window.partitionBy(by, "replicate", "percent").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    part = F.least("weight", F.greatest(F.lit(0), F.col("left") - F.coalesce(F.sum("weight").over(place), F.lit(0))))
    inside = opened.select(by, "replicate", "percent", (F.col("label") * part).alias("hits")).groupBy(by, "replicate", "percent").agg(F.sum("hits").alias("hits"))
    return full.unionByName(inside).groupBy(by, "replicate", "percent").agg(F.sum("hits").cast("long").alias("captured"))


def paired_difference(captured: DataFrame, reference: str, by: str = "method") -> DataFrame:
    """Captured events of each method less those of ``reference``, replicate by replicate."""
    base = captured.filter(F.col(by) == reference).select("replicate", "percent", F.col("captured").alias("base"))
    return captured.filter(F.col(by) != reference).join(base, ["replicate", "percent"]).select(by, "replicate", "percent", (F.col("captured") - F.col("base")).alias("difference"))
