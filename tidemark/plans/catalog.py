"""Registered queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import jobs, known_then, records, scores, studies
from tidemark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "jobs", "known_then", "records", "scores", "studies"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input coverage at the decision, by population, month and feature."""
    return QUERIES["a12_coverage_rollup"](spark, sf_dir)
