"""The ordinal confidence scale and the severity rollup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# HIGH > MEDIUM > LOW.
LEVELS = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def rank(level: Column) -> Column:
    out = None
    for name, value in LEVELS.items():
        out = (F if out is None else out).when(level == name, value)
    return out


def threshold(minimum: str) -> int:
    """Numeric rank of a user-given minimum (``high``, ``medium``, ``low``)."""
    key = minimum.strip().upper()
    if key not in LEVELS:
        raise ValueError(f"invalid minimum confidence: {minimum!r}")
    return LEVELS[key]


def meets(level: Column, minimum: str) -> Column:
    """Level at or above the minimum. Spelt as a plain IN so it can reach a parquet scan."""
    floor = threshold(minimum)
    return level.isin([name for name, value in LEVELS.items() if value >= floor])


def risk_status(critical: Column, warning: Column, info: Column) -> Column:
    """``struct<label, color>`` of one repository's risk counts."""
    total = critical + warning + info
    return (
        F.when(
            critical > 0,
            F.struct(F.concat(critical.cast("string"), F.lit(" critical")).alias("label"), F.lit("red").alias("color")),
        )
        .when(
            total > 0,
            F.struct(F.concat(total.cast("string"), F.lit(" risks")).alias("label"), F.lit("yellow").alias("color")),
        )
        .otherwise(F.struct(F.lit("clean").alias("label"), F.lit("brightgreen").alias("color")))
    )
