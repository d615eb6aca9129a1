"""All queries of the library, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import documents, evidence, files, growth, logs, members, runs, state, texts, vectors  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the hierarchy over hashed document vectors."""
    return QUERIES["tree_build"](spark, sf_dir)
