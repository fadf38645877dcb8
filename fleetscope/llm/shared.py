"""Tables, the shared folder, and Arrow batches of bounded size."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python function holds in work arrays at once, unless one text is longer.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; a session that names none,
    as in tests, gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return folder or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a Parquet table in the shared folder; a lost executor does not lose it,
    and what is planned on it starts from its size."""
    folder = new_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a table are removed as soon as it is written. Without, they stay until the
    driver collects its garbage. What is computed more than once is planned anew each time."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bounded_sample(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """At most ``rows`` rows, those with about the least hashes of ``columns``. The rows are counted, then
    all but a few more than needed are filtered where they are; only these meet in one task."""
    count = df.count()
    if count <= rows:
        return df
    edge = -(1 << 63) + int((rows * 1.05 + 300) / count * (1 << 64))
    name = free_name(df.columns, "hash")
    hashed = df.withColumn(name, F.xxhash64(*columns))
    near = hashed.filter(F.col(name) < F.lit(min(edge, (1 << 63) - 1)))
    return near.orderBy(name, *columns).limit(rows).drop(name)


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or with underscores before it if a column has that name, whatever its case."""
    names = {name.lower() for name in taken}
    while wanted.lower() in names:
        wanted = f"_{wanted}"
    return wanted


def text_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of ``batch`` in runs whose texts take about ``limit`` bytes together."""
    texts = batch.column(column)
    start = held = 0
    for row, size in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + (size or 0) > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, for files that executors write and read."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def open_store(uri: str) -> tuple:
    """The file system of a path as Spark names it, and the path there; executors open it by themselves."""
    import pyarrow.fs as pafs  # takes memory that only writers and readers of files need

    known = re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]:", "s3:", uri))
    return pafs.FileSystem.from_uri(known if re.match(r"[a-z][a-z0-9+.-]*:", known) else f"file://{known}")
