"""Queries with the SQL that says the same, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.fixtures import frame, with_tables
from tidemark.sources.shared import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The lending tables over one folder, each built once, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str, own: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.sf_dir, self.own = spark, sf_dir, own

    def __getattr__(self, name: str) -> DataFrame:
        value = frame(self.spark, self.sf_dir, name, own=self.own)
        setattr(self, name, value)
        return value

    def kept(self, *names: str) -> Tables:
        """The same tables with those of ``names`` stored, for a job that reads them several times."""
        out = Tables(self.spark, self.sf_dir, dict(self.own or {}))
        for name in names:
            out.own[name] = stored(getattr(out, name), name)
        return out

    def of(self, some: DataFrame) -> Tables:
        """The tables of the applications that ``some`` has, by id.

        Features and performance of an application follow from the rows of its own
        id, so they are derived for these alone, not for all and then dropped.
        """
        rows = self.applications.join(some.select("application_id"), "application_id", "left_semi").select(*self.applications.columns)
        return Tables(self.spark, self.sf_dir, {"applications": stored(rows, "applications")})


def query(tables: str, sql: str | None = None):
    """Register a function of ``Tables``; ``sql`` follows the tables' ``WITH`` and starts with SELECT or another table."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:  # else beyond SQL: model fits
            ORACLE_SQL[build.__name__] = with_tables(*tables.split()) + ("\n" if sql.lstrip().upper().startswith("SELECT") else ", ") + sql.strip()
        return build

    return register
