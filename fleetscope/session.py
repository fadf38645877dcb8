"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings an operator user should start a cluster session with. None of the operators needs
#: them for right results; they let AQE split hot partitions and size the shuffles at run time.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(app: str = "fleetscope", cores: int | str = 8, **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    ``fallback`` is only for sessions that name none, such as tests: a machine-local folder does
    not survive the loss of that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    folder = folder or fallback
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder


class Workspace:
    """Tables that a long computation keeps in the shared folder while it runs: each is computed once, and a
    lost executor loses none. :meth:`close`, or the end of a ``with`` block, removes them."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark, folder).rstrip('/')}/workspace-{uuid.uuid4().hex}"

    def table(self, name: str, df: DataFrame, **options: str) -> DataFrame:
        """``df`` written as ``name``, with the writer's ``options``, and read back."""
        path = f"{self.folder}/{name}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Removes a table, or all of them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def close(self) -> None:
        self.drop()

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
