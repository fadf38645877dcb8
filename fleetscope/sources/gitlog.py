"""Parsers of version-control text output that lies in files or tables, one row per line or block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.functions import paths
from fleetscope.functions.text import strip, unpack
from fleetscope.operators.ordered import with_running_last

# Formats.
LOG_SEPARATOR = r"\|"
META_SEPARATOR = "<<>>"
META_END = "<<>>END"
BLAME_HEADER = "^[0-9a-f]{40} "
AUTHOR_PREFIX = "author "


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files with ``line`` and the ``file`` it comes from."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def parse_commit_log(df: DataFrame, line: str = "line", keep: Sequence[str] = ("repo",)) -> DataFrame:
    """``hash|author|date|subject`` lines; the subject may hold further bars, short lines are dropped."""
    parts = F.split(strip(F.col(line)), LOG_SEPARATOR, 4)
    names = ["hash", "author", "date", "subject"]
    whole = F.filter(F.array(parts), lambda p: F.size(p) == 4)
    return df.select(
        *keep, unpack(whole, lambda p: F.struct(*[strip(F.get(p, n)).alias(name) for n, name in enumerate(names)]))
    )


def parse_touched_paths(df: DataFrame, line: str = "line", keep: Sequence[str] = ("repo", "hash", "ts")) -> DataFrame:
    """One row per non-blank path line of a name-only log."""
    return df.select(*keep, paths.posix(strip(F.col(line))).alias("path")).filter(F.col("path") != "")


def parse_numstat(df: DataFrame, line: str = "line", keep: Sequence[str] = ("repo",)) -> DataFrame:
    """``added<TAB>deleted<TAB>path``: binary, malformed and empty changes are dropped, renames keep
    their new side."""
    def number(text: Column) -> Column:
        # a failing cast costs far more than a look at the digits
        return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint"))

    def change(p: Column) -> Column:
        renamed = F.regexp_replace(F.get(p, 2), r"(?s)^.*? => ", "")
        return F.struct(
            paths.posix(renamed).alias("path"), number(F.get(p, 0)).alias("added"), number(F.get(p, 1)).alias("deleted")
        )

    rows = df.select(*keep, unpack(F.array(F.split(strip(F.col(line)), "\t")), change))
    return rows.filter(F.col("path").isNotNull() & (F.col("added") + F.col("deleted") > 0))


def parse_blame(
    df: DataFrame,
    keys: Sequence[str] = ("repo", "path"),
    line_no: str = "line_no",
    line: str = "line",
    rows_per_block: int | None = 10_000,
) -> DataFrame:
    """Line porcelain to one (author, sha) per content line.

    Author and header are carried forward to the tab line; blocks of line numbers keep a very long
    listing from becoming one task.
    """
    text = F.col(line)
    content = text.startswith("\t")
    marked = df.select(
        *keys,
        line_no,
        content.alias("__content"),
        F.when(~content & text.startswith(AUTHOR_PREFIX), F.substr(text, F.lit(len(AUTHOR_PREFIX) + 1))).alias("__a"),
        F.when(~content & text.rlike(BLAME_HEADER), F.substring(text, 1, 40)).alias("__s"),
    )
    block: Column | None = F.floor(F.col(line_no) / rows_per_block) if rows_per_block else None
    carried = with_running_last(marked, keys, [line_no], {"author": "__a", "sha": "__s"}, block)
    return carried.filter(
        F.col("__content") & (F.col("author") != "") & F.col("sha").isNotNull()
    ).select(*keys, line_no, "author", "sha")


def parse_commit_meta(df: DataFrame, text: str = "text", keep: Sequence[str] = ("repo",)) -> DataFrame:
    """``sha<<>>author<<>>email<<>>epoch<<>>message<<>>END`` blocks of a whole log text."""
    blocks = F.transform(F.split(F.col(text), META_END), lambda b: F.split(strip(b), META_SEPARATOR, 5))

    def commit(p: Column) -> Column:
        return F.struct(
            F.get(p, 0).alias("sha"),
            F.get(p, 1).alias("author"),
            F.get(p, 2).alias("email"),
            F.timestamp_seconds(F.get(p, 3).try_cast("bigint")).alias("ts"),
            strip(F.get(p, 4)).alias("message"),
        )

    return df.select(*keep, unpack(F.filter(blocks, lambda p: F.size(p) == 5), commit))
