"""Advisory snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetscope.functions.advisories import OSV_SCHEMA


def read_advisories(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """OSV records from JSON lines (or one document per file with ``multi_line``); the schema is given,
    so nothing is read twice to infer it."""
    return spark.read.schema(OSV_SCHEMA).option("multiLine", multi_line).json(path)
