"""Scoring models: MLlib's solvers on prepared cohorts, fitted on training rows only."""

from __future__ import annotations

import math
from contextlib import AbstractContextManager, nullcontext

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import design_matrix, standardize
from tidemark.sources.shared import stored

INPUTS = ("utilization", "debt_to_income", "prior_delinquencies", "log_principal", "small_business")


def matrix(train: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with standardised inputs in ``features``."""
    ready = standardize(design_matrix(train), design_matrix(rows), INPUTS)
    return VectorAssembler(inputCols=list(INPUTS), outputCol="features").transform(ready)


def fit_logistic(train: DataFrame, c: float = 1.0):
    """L2 logistic regression with an unpenalised intercept; the penalty of 1/C is spread over the rows."""
    n = train.count()
    return LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=200).fit(train)


def raw_scores(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("raw_pd", F.round(vector_to_array("probability")[1], 10)).drop("features", "rawPrediction", "probability", "prediction")


def fit_isotonic(calibration: DataFrame):
    """Monotone recalibration of scores on a six-place grid, from each grid place's rows and event rate: a million places at most, whatever the rows."""
    places = calibration.groupBy(F.round("raw_pd", 6).alias("grid")).agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("rows"))
    return IsotonicRegression(featuresCol="grid", labelCol="label", weightCol="rows").fit(places)


def calibrated(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows.withColumn("grid", F.round("raw_pd", 6))).withColumn("calibrated_pd", F.round(F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)), 10)).drop("grid", "prediction")


#: Bins of an input, as many as MLlib's trees tell apart by default.
TREE_BINS = 32
#: Cells in a task of a tree fit.
CELLS = 20_000


def bin_cuts(train: DataFrame, columns: list[str]) -> list[list[float]]:
    """For each column its distinct values, if they are at most TREE_BINS, else its distinct quantiles."""
    fractions = F.array(*(F.lit(k / TREE_BINS) for k in range(1, TREE_BINS)))
    found = train.agg(*(F.approx_count_distinct(c, 0.02).alias(f"n_{c}") for c in columns), *(F.percentile_approx(c, fractions, 10_000).alias(f"q_{c}") for c in columns)).first()
    cuts = []
    for c in columns:
        # The estimate only spares columns of many values a distinct count.
        few = [r[0] for r in train.select(c).distinct().limit(TREE_BINS + 1).collect()] if found[f"n_{c}"] <= 2 * TREE_BINS else None
        cuts.append(sorted(few if few and len(few) <= TREE_BINS else set(found[f"q_{c}"] or [0.0])))
    return cuts


class BinnedTrees:
    """Boosted trees over the bins of ``features``."""

    def __init__(self, cuts: list[list[float]], model) -> None:
        self.cuts, self.model = cuts, model

    def transform(self, rows: DataFrame) -> DataFrame:
        spread, columns = spread_out(rows, len(self.cuts))
        return self.model.transform(binned(spread, columns, self.cuts)).drop("cells")


def spread_out(rows: DataFrame, n: int) -> tuple[DataFrame, list[str]]:
    """``rows`` with a column for each of the ``n`` numbers in ``features``, and their names."""
    columns = [f"__x_{i}" for i in range(n)]
    array = vector_to_array("features")
    return rows.withColumns({c: array[i] for i, c in enumerate(columns)}), columns


def binned(spread: DataFrame, columns: list[str], cuts: list[list[float]]) -> DataFrame:
    """``columns`` replaced by the vector ``cells`` of their bins."""
    bins = [f"{c}_bin" for c in columns]
    placed = Bucketizer(splitsArray=[[-math.inf, *c, math.inf] for c in cuts], inputCols=columns, outputCols=bins, handleInvalid="keep").transform(spread)
    return VectorAssembler(inputCols=bins, outputCol="cells").transform(placed).drop(*columns, *bins)


def fit_trees(train: DataFrame, rounds: int = 100, step: float = 0.05, depth: int = 3, leaf: int = 20, seed: int = 7, turn: AbstractContextManager | None = None):
    """Boosted trees, fitted on the weighted cells of TREE_BINS bins an input.  ``turn`` is held while rows are read, not while cells are.

    Trees see their inputs by bin only, so rows of equal bins and label are one
    cell that weighs as many: a round passes over the cells, which the bins bound,
    whatever the rows.  A leaf has ``leaf`` rows or more, counted by weight.
    """
    with turn or nullcontext():
        first = train.select("features").first()
        spread, columns = spread_out(train.select("label", "features"), len(first[0]) if first else 0)
        cuts = bin_cuts(spread, columns)
        cells = binned(spread.drop("features"), columns, cuts).groupBy("label", vector_to_array("cells").alias("x")).agg(F.count("*").cast("double").alias("rows"))
        cells = stored(cells.select("label", "rows", "x"), "cells")
    size = cells.agg(F.count("*").alias("cells"), F.sum("rows").alias("rows")).first()
    data = cells.select("label", "rows", array_to_vector("x").alias("cells")).repartition(size["cells"] // CELLS + 1)
    splits = size["rows"] >= 2 * leaf
    trees = GBTClassifier(
        featuresCol="cells", labelCol="label", weightCol="rows", maxIter=rounds, stepSize=step, maxDepth=depth, maxBins=TREE_BINS + 2, seed=seed,
        # Half a row less, so that a leaf of exactly as many is not lost to rounding.
        minInstancesPerNode=1 if splits else int(size["rows"]) + 1, minWeightFractionPerNode=(leaf - 0.5) / size["rows"] if splits else 0.0,
    )
    return BinnedTrees(cuts, trees.fit(data))


def one_hot(train: DataFrame, columns: tuple[str, ...]):
    """Encoder of training categories; an unseen one gives zeros."""
    indexed = [f"{c}_index" for c in columns]
    return Pipeline(stages=[StringIndexer(inputCols=list(columns), outputCols=indexed, handleInvalid="keep"), OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_vector" for c in columns], dropLast=True)]).fit(train)


def constant(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row scored with the training event rate."""
    return rows.crossJoin(F.broadcast(train.agg(F.round(F.avg("label"), 10).alias("raw_pd"))))


def fit_audit(model) -> list[tuple[str, float]]:
    """Coefficients and intercept of a logistic model."""
    return [*zip(INPUTS, map(float, model.coefficients), strict=True), ("intercept", float(model.intercept))]


def frozen_stages(cohort: DataFrame) -> DataFrame:
    """Test rows scored by a model of the training rows, calibrated on the calibration rows."""
    known = cohort.dropna(subset=["label", "utilization", "debt_to_income", "prior_delinquencies"])
    stage = {s: known.filter(F.col("stage") == s) for s in ("train", "calibration", "test")}
    logistic = fit_logistic(matrix(stage["train"], stage["train"]))
    # Each fit makes its own passes over the rows; callers hand over a stored table.
    isotonic = fit_isotonic(raw_scores(logistic, matrix(stage["train"], stage["calibration"])))
    scored = calibrated(isotonic, raw_scores(logistic, matrix(stage["train"], stage["test"])))
    return scored.select("application_id", "decision_at", F.date_format("decision_at", "yyyy-MM").alias("vintage"), "segment", "principal_cents", "label", F.col("raw_pd").cast("decimal(12,10)").alias("raw_pd"), F.col("calibrated_pd").cast("decimal(12,10)").alias("calibrated_pd"))
