"""Content fingerprints and incremental runs against a stored snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import confidence, paths

# The eight words of 32 bits of every digest are added up, as decimals that hold any number of them.
_WORDS = 8
_HEX = 8


def file_token(*parts: Column) -> Column:
    """``path:size:mtime`` style token of one file."""
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def _sums(digest: Column) -> list[Column]:
    return [
        F.sum(F.conv(F.substring(digest, 1 + _HEX * n, _HEX), 16, 10).cast("decimal(38,0)")).alias(f"__w{n}") for n in range(_WORDS)
    ]


def _summed_digest(head: Column) -> Column:
    return F.sha2(F.concat_ws("\n", head, F.col("files").cast("string"), *[F.col(f"__w{n}").cast("string") for n in range(_WORDS)]), 256)


def fingerprint(
    files: DataFrame, token: Column, keys: Sequence[str] = ("repo",), head: Column | None = None
) -> DataFrame:
    """SHA-256 over the number of a repository's tokens and the word-wise sum of their digests.

    Like a digest over the sorted token list it changes when a token appears, vanishes or changes,
    whatever the order; unlike it, it is a sum, so tasks combine partial results and no task ever
    holds a repository's whole list. ``head`` (constant per repository) enters the final digest.
    """
    first = F.max(head).alias("__head") if head is not None else F.lit("").alias("__head")
    digests = files.withColumn("__digest", F.sha2(token, 256))
    sums = digests.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("files"), *_sums(F.col("__digest")))
    return sums.select(*keys, "files", _summed_digest(F.col("__head")).alias("fingerprint"))


def file_digests(files: DataFrame, token: Column, keys: Sequence[str] = ("repo",), path: str = "path") -> DataFrame:
    """``keys, path, digest``: what a snapshot keeps of every file, to name later what has changed."""
    return files.select(*keys, F.col(path).alias("path"), F.sha2(token, 256).alias("digest"))


def folder_tree(digests: DataFrame, keys: Sequence[str] = ("repo",), depth: int | None = None) -> DataFrame:
    """``keys, folder, files, fingerprint`` of every folder, the repository itself being the folder ````.

    A folder's fingerprint covers the paths and digests of all files below it. Each file adds to all folders
    above it, so every level of the tree comes out of one aggregation, whose partial sums leave a task as
    one row per folder. ``depth`` keeps the levels down to so many folders.
    """
    above = F.concat(F.array(F.lit("")), paths.parent_folders(F.col("path")))
    if depth is not None:
        above = F.slice(above, 1, depth + 1)
    token = F.sha2(F.concat_ws("\n", "path", "digest"), 256)
    rows = digests.select(*keys, token.alias("__token"), F.explode(above).alias("folder"))
    sums = rows.groupBy(*keys, "folder").agg(F.count(F.lit(1)).alias("files"), *_sums(F.col("__token")))
    return sums.select(*keys, "folder", "files", _summed_digest(F.lit("")).alias("fingerprint"))


def changed_paths(new: DataFrame, old: DataFrame, keys: Sequence[str] = ("repo",), step: int = 3) -> DataFrame:
    """``keys, kind, path, state``: the folders and files of two tables of :func:`file_digests` that are new,
    changed or gone, and the repositories, which are the folder ````.

    The comparison goes down from the repositories: only below folders whose fingerprints differ, ``step``
    levels deep, are further folders made, and only their files are compared one by one.
    """
    keys = list(keys)

    def compared(a: DataFrame, b: DataFrame, name: str, value: str) -> DataFrame:
        both = a.select(*keys, name, F.col(value).alias("fingerprint")), b.select(*keys, name, F.col(value).alias("fingerprint"))
        return refresh(*both, [*keys, name]).filter("state <> 'same'")

    def below(rows: DataFrame, folders: DataFrame, levels: int) -> DataFrame:
        """Files below one of ``folders`` of the level ``levels``, or of a lesser one with nothing deeper."""
        at = F.element_at(F.slice(F.concat(F.array(F.lit("")), paths.parent_folders(F.col("path"))), 1, levels + 1), -1)
        return rows.withColumn("folder", at).join(folders.select(*keys, "folder"), [*keys, "folder"], "left_semi").drop("folder")

    roots = compared(folder_tree(new, keys, 0), folder_tree(old, keys, 0), "folder", "fingerprint")
    upper = compared(*[folder_tree(below(side, roots, 0), keys, step) for side in (new, old)], "folder", "fingerprint")
    kept = [below(side, upper, step) for side in (new, old)]
    levels = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    deeper = compared(*[folder_tree(side, keys).filter(levels > step) for side in kept], "folder", "fingerprint")
    folders = upper.unionByName(deeper)
    files = compared(*kept, "path", "digest")
    return folders.select(*keys, F.lit("folder").alias("kind"), F.col("folder").alias("path"), "state").unionByName(
        files.select(*keys, F.lit("file").alias("kind"), "path", "state")
    )


def stale(
    current: DataFrame,
    snapshot: DataFrame,
    keys: Sequence[str] = ("repo",),
    minimum: str | None = None,
) -> DataFrame:
    """Rows of ``current`` that the snapshot does not answer: unknown key, other fingerprint, or a
    snapshot taken with a higher minimum confidence than now asked for."""
    usable = snapshot
    if minimum is not None:
        usable = snapshot.filter(confidence.rank(F.upper("min_confidence")) <= confidence.threshold(minimum))
    return current.join(usable.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti")


def refresh(current: DataFrame, snapshot: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """``current`` with ``state`` = new / changed / same, and ``gone`` for keys only in the snapshot."""
    old = snapshot.select(*keys, F.col("fingerprint").alias("__old"))
    new = current.select(*keys, F.col("fingerprint").alias("__new"))
    state = (
        F.when(F.col("__old").isNull(), "new")
        .when(F.col("__new").isNull(), "gone")
        .when(F.col("__old") != F.col("__new"), "changed")
        .otherwise("same")
    )
    return new.join(old, list(keys), "full_outer").select(*keys, state.alias("state"))
