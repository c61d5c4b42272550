"""Readers and writers of dated event tables, coded study tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import unused

#: Fixed values of the input format: the columns of each text table, in their order.
APPLICATIONS = ("application_id", "decision_at", "principal_cents", "segment")
FEATURE_EVENTS = ("application_id", "name", "value", "observed_at", "available_at")
PERFORMANCE = ("application_id", "as_of", "available_at", "days_past_due")
TYPES = {"decision_at": "date", "observed_at": "date", "available_at": "date", "as_of": "date", "principal_cents": "bigint", "value": "double", "days_past_due": "int"}


def _strings(columns: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` string" for c in columns)


def _csv(spark: SparkSession, multi_line: bool = False):
    """A reader that checks the header of every file.  Only ``multi_line``, for quoted line breaks, makes a file one task."""
    return spark.read.option("header", True).option("enforceSchema", False).option("multiLine", multi_line)


def _same_header(reader, path: str, columns: tuple[str, ...]) -> None:
    header = reader.csv(path).columns
    if tuple(header) != tuple(columns):
        raise ValueError(f"columns differ: {header}")


def read_text_table(spark: SparkSession, path: str, columns: tuple[str, ...], multi_line: bool = False, **options) -> DataFrame:
    """A CSV table of exactly these columns, in this order, as text; rows of another shape are in ``_corrupt``."""
    _same_header(spark.read.option("header", True).options(**options), path, columns)
    reader = _csv(spark, multi_line).schema(f"{_strings(columns)}, _corrupt string").option("mode", "PERMISSIVE").option("columnPruning", False).option("columnNameOfCorruptRecord", "_corrupt")
    return reader.options(**options).csv(path)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of a scan with their place from 1, in the order of files and lines.

    A row knows its place in its block of a file; a running sum over the blocks'
    counts shifts it, so the rows themselves aren't moved.
    """
    file, block, at, n, before = unused([*rows.columns, name], "file", "block", "at", "n", "before")
    placed = rows.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().alias(at))
    blocks = placed.groupBy(file, block).agg(F.count("*").alias(n), F.min(at).alias(at))
    upto = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)
    shifts = blocks.select(F.col(file).alias(f"{file}_"), F.col(block).alias(f"{block}_"), (F.coalesce(F.sum(n).over(upto), F.lit(0)) - F.col(at) + 1).alias(before))
    out = placed.join(shifts, (F.col(file) == F.col(f"{file}_")) & (F.col(block) == F.col(f"{block}_")))
    return out.select(*rows.columns, (F.col(at) + F.col(before)).cast("long").alias(name))


def typed(rows: DataFrame) -> DataFrame:
    """Text columns in their types; what can't be read is null."""
    return rows.select(*(F.col(c).try_cast(TYPES.get(c, "string")).alias(c) for c in rows.columns if c != "_corrupt"))


def read_features(spark: SparkSession, apps: str, feats: str) -> tuple[DataFrame, DataFrame]:
    """Applications and feature events; outcomes are never opened."""
    return typed(read_text_table(spark, apps, APPLICATIONS)), typed(read_text_table(spark, feats, FEATURE_EVENTS))


def read_events(spark: SparkSession, apps: str, feats: str, performance: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (*read_features(spark, apps, feats), typed(read_text_table(spark, performance, PERFORMANCE)))


def _only(ok, value, said: str):
    """``value`` where ``ok``; any other row ends the job."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(said)).cast("int"))


def read_coded_table(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Space-separated codes; the last column is class 1 or 2 and nothing else, ``record_id`` the row's place in the file order."""
    rows = numbered(spark.read.schema(_strings(columns)).option("sep", " ").csv(path), "record_id")
    return rows.withColumn("label", _only(F.col(columns[-1]).isin("1", "2"), F.col(columns[-1]).cast("int") - 1, "a class is neither 1 nor 2"))


def read_wide_int_table(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A CSV of whole numbers, gzipped or not, with exactly these columns; the first one counts the rows from 1."""
    _same_header(spark.read.option("header", True), path, columns)
    rows = _csv(spark).schema(", ".join(f"`{c}` int" for c in columns)).option("mode", "FAILFAST").csv(path)
    (place,) = unused(rows.columns, "place")
    first = columns[0]
    return numbered(rows, place).withColumn(first, _only(F.col(first) == F.col(place), F.col(first), f"{first} does not count the rows from 1")).drop(place)


def read_raw_loans(spark: SparkSession, paths: dict[str, str], columns: tuple[str, ...], multi_line: bool = False) -> DataFrame:
    """Several CSV files of exactly these columns, with ``source`` and, within it, ``ordinal`` from 1."""
    out = None
    for source, path in sorted(paths.items()):
        _same_header(spark.read.option("header", True), path, columns)
        one = numbered(_csv(spark, multi_line).schema(_strings(columns)).csv(path), "ordinal").withColumn("source", F.lit(source))
        out = one if out is None else out.unionByName(one)
    return out


def write_table(rows: DataFrame, path: str, columns: tuple[str, ...], kind: str = "parquet") -> None:
    """``columns`` in their order, to a place that has to be new."""
    writer = rows.select(*columns).write.mode("errorifexists").format(kind)
    (writer.option("header", True).option("nullValue", "") if kind == "csv" else writer).save(path)


def read_report_table(spark: SparkSession, path: str, columns: tuple[str, ...], kind: str = "parquet") -> DataFrame:
    """A published table with exactly these columns in this order."""
    rows = spark.read.option("header", True).option("nullValue", "").format(kind).load(path)
    if tuple(rows.columns) != tuple(columns):
        raise ValueError(f"columns differ: {rows.columns}")
    return rows


def write_evidence(apps: DataFrame, feats: DataFrame, params: dict[str, str], path: str) -> None:
    """The events and parameters behind a result, so that it can be computed again."""
    write_table(apps, f"{path}/applications", APPLICATIONS)
    write_table(feats, f"{path}/feature_events", FEATURE_EVENTS)
    apps.sparkSession.createDataFrame([params]).write.mode("errorifexists").parquet(f"{path}/params")


def read_evidence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    apps, feats = (spark.read.parquet(f"{path}/{n}") for n in ("applications", "feature_events"))
    return apps, feats, spark.read.parquet(f"{path}/params").first().asDict()
