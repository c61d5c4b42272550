"""Feature preparation, scorecards and explanations around fitted coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import global_rank, quantiles, reason_rank, with_total
from tidemark.sources.shared import stored

#: Fixed values of the scorecard: points at the base odds, and points that double them.
BASE_POINTS, BASE_ODDS, DOUBLING = 600.0, 50.0, 20.0
WOE_SMOOTHING = 0.5


def design_matrix(cohort: DataFrame) -> DataFrame:
    return cohort.withColumns({"log_principal": F.log1p(F.col("principal_cents") / 100), "small_business": (F.col("segment") == "small_business").cast("double")})


def moments(train: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Mean and population deviation of each of ``columns``, in one row."""
    return train.agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"__s_{c}") for c in columns))


def standardize(train: DataFrame, rows: DataFrame, columns: tuple[str, ...], stats: DataFrame | None = None) -> DataFrame:
    """``columns`` of ``rows`` less the training mean, by the training rows' population deviation; ``stats`` are the training rows' ``moments``, if they are there already."""
    stats = moments(train, columns) if stats is None else stats
    joined = rows.crossJoin(F.broadcast(stats))
    return joined.select(*(F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0).alias(c) if c in columns else F.col(c) for c in rows.columns))


def calibration_grid(score: Column, places: int = 6) -> Column:
    return F.round(score, places)


def published_rounding(score: Column, places: int = 10) -> Column:
    return F.round(score, places)


def impute_median(train: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Nulls of ``column`` replaced by the training median, and a flag for them."""
    median = quantiles(train, column, (0.5,)).select(F.get("q", 0).alias("__median"))
    return rows.crossJoin(F.broadcast(median)).withColumn(f"{column}_missing", F.col(column).isNull().cast("int")).withColumn(column, F.coalesce(column, "__median")).drop("__median")


def business_rule(utilization: Column, debt_to_income: Column, prior: Column) -> Column:
    return 0.5 * utilization + 0.3 * debt_to_income + 0.2 * F.least(prior, F.lit(5.0)) / 5


def woe_cuts(train: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``(name, cuts)``: the middles between at most five distinct values, else the distinct inner quintiles."""
    values = tall(train, names)
    # Six values tell whether there are more than five, so a task's array never grows beyond them.
    distinct = values.filter("value is not null").distinct()
    first = F.row_number().over(Window.partitionBy("name").orderBy("value"))
    few = distinct.withColumn("place", first).filter("place <= 6").groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("few"))
    quintiles = quantiles(values, "value", (0.2, 0.4, 0.6, 0.8), ("name",)).select("name", F.array_sort(F.array_distinct("q")).alias("q"))
    middles = F.transform(F.slice("few", 1, F.size("few") - 1), lambda x, i: (x + F.get("few", i + 1)) / 2)
    return few.join(quintiles, "name").select("name", F.when(F.size("few") <= 5, middles).otherwise(F.col("q")).alias("cuts"))


def tall(rows: DataFrame, names: tuple[str, ...], *keep: str) -> DataFrame:
    """``keep`` columns, ``name`` and ``value``."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names)))
    return rows.select(*keep, pairs.alias("x")).select(*keep, "x.name", "x.value")


def woe_bins(train: DataFrame, cuts: DataFrame, names: tuple[str, ...], label: str = "label") -> DataFrame:
    """Events and non-events of each bin of each feature, and the smoothed log ratio of the classes' shares."""
    rows = tall(train, names, label).join(F.broadcast(cuts), "name")
    placed = rows.withColumn("bin", F.size(F.filter("cuts", lambda c: c <= F.col("value"))))
    counts = placed.groupBy("name", "bin").agg(F.count_if(F.col(label) == 1).alias("events"), F.count_if(F.col(label) == 0).alias("non_events"), F.size(F.first("cuts")).alias("edges"))
    totals = train.agg(F.count_if(F.col(label) == 1).alias("e"), F.count_if(F.col(label) == 0).alias("n"))
    b = F.col("edges") + 1
    share = lambda c, total: (F.col(c) + WOE_SMOOTHING) / (F.col(total) + WOE_SMOOTHING * b)
    return counts.crossJoin(F.broadcast(totals)).select("name", "bin", "events", "non_events", F.log(share("events", "e") / share("non_events", "n")).alias("woe"))


def woe_transform(rows: DataFrame, cuts: DataFrame, bins: DataFrame, names: tuple[str, ...], key: str = "application_id") -> DataFrame:
    """``(key, name, value, woe)`` of each row and feature; a bin without training rows has 0."""
    placed = tall(rows, names, key).join(F.broadcast(cuts), "name").withColumn("bin", F.size(F.filter("cuts", lambda c: c <= F.col("value")))).drop("cuts")
    return placed.join(F.broadcast(bins.select("name", "bin", "woe")), ["name", "bin"], "left").fillna(0.0, ["woe"])


def scorecard_points(transformed: DataFrame, coefficients: DataFrame, intercept: float) -> DataFrame:
    """Points of each feature, and of the base, so that their sum is 600 at odds of 50 to 1 and 20 more double the odds."""
    import math

    factor = DOUBLING / math.log(2)
    offset = BASE_POINTS - factor * math.log(BASE_ODDS)
    joined = transformed.join(F.broadcast(coefficients.select("name", "coef")), "name")
    return joined.select("application_id", "name", F.round(-F.col("coef") * F.col("woe") * factor, 6).alias("points"), F.lit(round(offset - factor * intercept, 6)).alias("base_points"))


def contributions(rows: DataFrame, coefficients: DataFrame, names: tuple[str, ...], key: str = "application_id") -> DataFrame:
    """Each feature's part of the log odds against the training mean, ranked inside its row: what raises the odds most comes first."""
    joined = tall(rows, names, key).join(F.broadcast(coefficients), "name")
    parts = joined.withColumn("contribution", F.round((F.col("value") - F.col("mean")) * F.col("coef") / F.col("scale"), 10))
    return reason_rank(parts, key, F.col("contribution"), "ord").select(key, "name", "contribution", "reason_rank")


def rebuilt_probability(parts: DataFrame, baseline: float, key: str = "application_id") -> DataFrame:
    """The probability that a row's contributions and the baseline give."""
    return parts.groupBy(key).agg(F.round(1 / (1 + F.exp(-(F.sum("contribution") + baseline))), 8).alias("probability"))


def stratified_split(rows: DataFrame, label: str, key: str, seed: int, test: int = 20, calibration: int = 20) -> DataFrame:
    """``stage`` of each row: ``test`` and ``calibration`` percent of each class by the order of a hash, the rest for training."""
    unit = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256), 1, 8), 16, 10).cast("double") / 2**32
    ranked = with_total(global_rank(rows.withColumn("__u", unit), "__u", key, (label,), name="__place"), (label,))
    place = F.col("__place")
    first, second = F.expr(f"(__n * {test} + 50) div 100"), F.expr(f"(__n * {test + calibration} + 50) div 100")
    return ranked.withColumn("stage", F.when(place <= first, "test").when(place <= second, "calibration").otherwise("train")).drop("__u", "__place", "__n")


def seeded_stages(rows: DataFrame, label: str, key: str, seeds: tuple[int, ...], test: int = 20, calibration: int = 20, bits: int = 12) -> DataFrame:
    """``rows`` with a column ``stage_<seed>`` for each seed: the stages of ``stratified_split``, without an order of the rows.

    Hashes are counted by their leading ``bits``; only rows of the count in which a
    stage ends are ranked, a share of 2^-bits of a class, and every row is held
    against the hash and key that the stage ends with.  Rows of one key are of one
    stage.  ``rows`` are read three times and not moved.
    """

    def unit(seed: int) -> Column:
        return F.coalesce(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256), 1, 8), 16, 10).cast("long"), F.lit(-1))

    name = F.coalesce(F.col(key), F.lit(""))
    tall = rows.select(F.col(label).alias("class"), name.alias("key"), F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), unit(s).alias("u")) for s in seeds))).alias("x"))
    tall = tall.select("class", "key", "x.seed", "x.u", F.shiftright("x.u", 32 - bits).alias("cell"))
    counts = tall.groupBy("class", "seed", "cell").agg(F.count("*").alias("n"))
    own = Window.partitionBy("class", "seed")
    upto = F.sum("n").over(own.orderBy(F.desc("cell")))
    # 2^bits rows a class and seed at most, and two of them hold a stage's end.
    ends = F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.expr(f"(all * {p} + 50) div 100").alias("size")) for s, p in (("test", test), ("calibration", test + calibration))))).alias("e")
    cells = counts.select("class", "seed", "cell", "n", upto.alias("upto"), F.sum("n").over(own).alias("all")).select("class", "seed", "cell", "n", "upto", ends)
    cells = cells.filter("e.size > upto - n and e.size <= upto").select(F.col("class").alias("of"), F.col("seed").alias("s"), F.col("cell").alias("c"), "e.stage", (F.col("e.size") - F.col("upto") + F.col("n")).alias("rest"))
    near = tall.join(F.broadcast(stored(cells, "cells")), F.col("class").eqNullSafe(F.col("of")) & (F.col("seed") == F.col("s")) & (F.col("cell") == F.col("c")))
    place = F.row_number().over(Window.partitionBy("class", "seed", "stage").orderBy(F.desc("u"), "key"))
    last = near.withColumn("place", place).filter("place = rest")
    of = lambda seed, stage, c: F.max(F.when((F.col("seed") == seed) & (F.col("stage") == stage), F.col(c)))
    cuts = stored(last.groupBy(F.col("class").alias("__class")).agg(*(of(s, g, c).alias(f"__{g}_{c}_{s}") for s in seeds for g in ("test", "calibration") for c in ("u", "key"))), "cuts")
    upto = lambda s, g: (unit(s) > F.col(f"__{g}_u_{s}")) | ((unit(s) == F.col(f"__{g}_u_{s}")) & (name <= F.col(f"__{g}_key_{s}")))
    stages = (F.when(upto(s, "test"), "test").when(upto(s, "calibration"), "calibration").otherwise("train").alias(f"stage_{s}") for s in seeds)
    return rows.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("__class")), "left").select(*(F.col(c) for c in rows.columns), *stages)
