"""Repository files as a table."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import suppress
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.functions import paths, text
from fleetscope.operators import scope
from fleetscope.operators.ordered import join_groups
from fleetscope.operators.packages import lookup
from fleetscope.sources.store import open_store

# Files that carry instructions for assistants.
CONTEXT_FILES = [".cursorrules", "CLAUDE.md", "AGENTS.md", ".claudecode", "README.md"]
README = "README.md"
RULES_FOLDER = ".cursor/rules/"
RULES_SUFFIX = ".mdc"


#: Bytes of files that a task reads, and of those in one batch of rows.
TASK_BYTES = 256 << 20
BATCH_BYTES = 8 << 20
#: A cell cannot hold a file of so many bytes; its row has no content.
CELL_BYTES = (1 << 31) - 1
# Stands for a genuine replacement character while bytes that are no UTF-8 become one.
_GENUINE = "\ufdd0\ufdd1"
_LISTED = "repo string, path string, size long, mtime timestamp"


def lenient_text(raw: Column) -> Column:
    """Bytes as text; bytes that are no UTF-8 are dropped, replacement characters in the text stay."""
    text = raw.cast("string")
    marked = F.make_valid_utf8(F.replace(text, F.lit("\ufffd"), F.lit(_GENUINE)))
    cleaned = F.replace(F.replace(marked, F.lit("\ufffd"), F.lit("")), F.lit(_GENUINE), F.lit("\ufffd"))
    return F.when(F.is_valid_utf8(text), text).otherwise(cleaned)


def _skipped_folder(path: str) -> bool:
    """The default rules for a folder below a repository, so that the walk never enters it."""
    return path.rpartition("/")[2] in paths.IGNORED_FOLDERS or any(f"{path}/".endswith(part) for part in paths.IGNORED_FRAGMENTS)


def _walk(root: str, repo: str) -> Iterator[tuple]:
    """Path, size and time of the files of a repository, folder by folder; links to folders are not followed."""
    store, base = open_store(f"{root}/{repo}")
    local = isinstance(store, pafs.LocalFileSystem)
    folders = [""]
    while folders:
        folder = folders.pop()
        for info in store.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)):
            path = f"{folder}/{info.base_name}".lstrip("/")
            if info.type == pafs.FileType.Directory:
                if not _skipped_folder(path) and not (local and os.path.islink(info.path)):
                    folders.append(path)
            elif info.type == pafs.FileType.File:
                yield repo, path, info.size, info.mtime


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``repo, path, size, mtime`` of the files below ``root/<repo>/``, without the folders that a default rule
    ignores. Folders are read, a repository in one task; no file is opened.

    Spark's own file sources pass over names that begin with a dot or an underscore, so the executors list
    with ``pyarrow.fs``, which must know the store.
    """
    root = root.rstrip("/")
    names = ["repo", "path", "size", "mtime"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC")]

    def repositories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            store, base = open_store(root)
            found = [i.base_name for i in store.get_file_info(pafs.FileSelector(base)) if i.type == pafs.FileType.Directory]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["repo"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo in batch.column(0).to_pylist():
                walk = _walk(root, repo)
                while rows := list(islice(walk, 10_000)):
                    yield _batch(rows, names, kinds)

    top = spark.range(0, 1, 1, 1).mapInArrow(repositories, "repo string")
    return top.repartition(4 * spark.sparkContext.defaultParallelism, "repo").mapInArrow(files, _LISTED)


def _contents(listed: DataFrame, root: str, task_bytes: int) -> DataFrame:
    """``listed`` with the bytes of each file, dealt into tasks of about ``task_bytes``."""
    root = root.rstrip("/")
    total = listed.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()
    small = F.pmod(F.xxhash64("repo", "path"), F.greatest(F.lit(1), F.ceil(total / task_bytes)))
    # A file that fills a task has a number of its own.
    part = F.when(F.col("size") >= task_bytes, F.xxhash64("path", "repo")).otherwise(small)
    names = ["repo", "path", "size", "mtime", "raw"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                raw = None
                if row["size"] < CELL_BYTES:
                    with suppress(FileNotFoundError):
                        with store.open_input_stream(f"{base}/{row['repo']}/{row['path']}", compression=None) as source:
                            raw = source.read()
                rows.append((*row.values(), raw))
                held += len(raw or b"")
                if held >= BATCH_BYTES or len(rows) >= 10_000:
                    yield _batch(rows, names, kinds)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, names, kinds)

    dealt = listed.withColumn("__part", part).repartition("__part").select(*names[:4])
    return dealt.mapInArrow(read, f"{_LISTED}, raw binary")


def read_files(spark: SparkSession, root: str, own_rules: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``root/<repo>/<path>`` as ``repo, path, size, mtime, is_binary, content``, a row per listed file.

    The listing decides what is opened: not what a rule of the repository's own ignore files hides (with
    ``own_rules``), nor what has a binary suffix; these files have rows without content, those of ignored
    folders none (:func:`list_files`). The rest is packed into tasks by size. Text is decoded leniently
    (:func:`lenient_text`); a NUL makes a file binary.
    """
    listed = list_files(spark, root)
    binary_name = paths.suffix(F.col("path")).isin(paths.BINARY_SUFFIXES)
    marked = listed.withColumn("__closed", binary_name)
    if own_rules:
        files = _contents(listed.filter(F.col("path").isin(paths.IGNORE_FILES)), root, task_bytes)
        rules = scope.ignore_rules(files.withColumn("content", lenient_text(F.col("raw"))))
        ruled = join_groups(marked, rules, ["repo"], F.col("path"), how="left")
        own = F.coalesce(F.rlike(paths.posix(F.col("path")), F.col("regex")), F.lit(False))
        marked = ruled.select("repo", "path", "size", "mtime", (F.col("__closed") | own).alias("__closed"))
    opened = _contents(marked.filter(~F.col("__closed")).drop("__closed"), root, task_bytes)
    nul = F.coalesce(F.contains("raw", F.lit(bytearray(b"\x00"))), F.lit(False))
    closed = marked.filter("__closed").drop("__closed").withColumn("raw", F.lit(None).cast("binary"))
    rows = opened.unionByName(closed).withColumn("is_binary", binary_name | nul)
    content = F.when(~F.col("is_binary"), lenient_text(F.col("raw")))
    return rows.select("repo", "path", "size", "mtime", "is_binary", content.alias("content"))


def context_name(path: Column) -> Column:
    """Canonical name of an instruction file, NULL for others."""
    root = lookup(F.lower(path), {name.lower(): name for name in CONTEXT_FILES})
    rule = path.startswith(RULES_FOLDER) & F.lower(path).endswith(RULES_SUFFIX)
    return F.coalesce(root, F.when(rule, path))


def context_files(
    files: DataFrame, repo: str = "repo", name: Column | None = None, content: str = "content", readme: Column | None = None
) -> DataFrame:
    """Instruction files, whole, with their line count and a preview: the first lines of READMEs and of long texts."""
    named = files.withColumn("__name", context_name(F.col("path")) if name is None else name)
    is_readme = F.col("__name") == README if readme is None else readme
    return named.filter(F.col("__name").isNotNull()).select(
        repo,
        F.col("__name").alias("name"),
        F.col(content).alias("content"),
        text.preview(F.col(content), is_readme).alias("preview"),
        F.size(text.lines(F.col(content))).alias("lines_count"),
    )
