from __future__ import annotations

import pytest


@pytest.fixture(scope="session", autouse=True)
def checkpoints(spark, tmp_path_factory):
    """What a cluster names in ``spark.checkpoint.dir``."""
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with further columns whose names the operators use themselves."""

    def build(rows, extra=True):
        schema = "doc_id long, text string" + (", node string, token string, n string, severity string, lang_pred string" if extra else "")
        return spark.createDataFrame([(*r, *["x"] * 5 * extra) for r in rows], schema)

    return build
