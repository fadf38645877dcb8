from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from fleetscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, **{"spark.sql.shuffle.partitions": "2"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluates a column over a list of strings: ``one(values, lambda c: ...)``."""

    def run(values, expression):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")
        rows = df.select("n", expression(F.col("v")).alias("out")).orderBy("n").collect()
        return [row.out for row in rows]

    return run
