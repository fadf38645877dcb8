"""Which files take part in a scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import paths
from fleetscope.functions.text import lines, strip
from fleetscope.operators.ordered import join_groups


def ignore_rules(files: DataFrame, repo: str = "repo", path: str = "path", text: str = "content") -> DataFrame:
    """``(repo, regex)``: the patterns of each repository's root ignore files as one regex.

    The patterns of a repository are as many as the lines of its three ignore files, which are three
    cells of the input.
    """
    kept = F.filter(
        F.transform(lines(F.col(text)), lambda row: strip(row)), lambda row: (row != "") & ~row.startswith("#")
    )
    return (
        files.filter(F.col(path).isin(paths.IGNORE_FILES))
        .groupBy(repo)
        .agg(F.array_distinct(F.flatten(F.collect_list(kept))).alias("__patterns"))
        .filter(F.size("__patterns") > 0)
        .select(repo, paths.any_ignore_regex(F.col("__patterns")).alias("regex"))
    )


def drop_ignored(
    files: DataFrame,
    path: str = "path",
    rules: DataFrame | None = None,
    repo: str = "repo",
    patterns: Sequence[str] = (),
) -> DataFrame:
    """Files under no default rule, literal pattern, or pattern of their own repository.

    ``rules`` has one row per repository. Paths alone meet them, those of a large repository in many
    tasks; contents are then matched by (repository, path), never gathered by repository.
    """
    kept = files.filter(~paths.ignored(F.col(path), patterns))
    if rules is None:
        return kept
    ruled = join_groups(kept.select(repo, path), rules.select(repo, "regex"), [repo], F.col(path))
    hidden = ruled.filter(F.rlike(paths.posix(F.col(path)), F.col("regex"))).select(repo, path).distinct()
    return kept.join(hidden, [repo, path], "left_anti")


def text_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Scannable text: path rules first, the NUL peek last."""
    return files.filter(~paths.skippable(F.col(path))).filter(~paths.binary(F.col(path), F.col(content)))


def countable_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Text files that count towards a repository's tokens: all but own reports, whatever their size."""
    return files.filter(~paths.basename(F.col(path)).isin(paths.REPORT_FILES)).filter(~paths.binary(F.col(path), F.col(content)))


def within_depth(files: DataFrame, folders: int, path: str = "path") -> DataFrame:
    return files.filter(paths.depth(F.col(path)) <= folders)


def changed_only(files: DataFrame, changed: DataFrame, on: Sequence[str] = ("repo", "path")) -> DataFrame:
    """Incremental scope: files that exist and are in the change set."""
    return files.join(changed.select(*on).distinct(), list(on), "left_semi")


def scope_counts(
    files: DataFrame, changed: DataFrame | None, keys: Sequence[str] = ("repo",), on: Sequence[str] = ("repo", "path")
) -> DataFrame:
    """Files scanned and files there are, per repository; a full scan reads all of them."""
    if changed is None:
        total = F.count(F.lit(1))
        return files.groupBy(*keys).agg(total.alias("files_scanned"), total.alias("files_total"))
    flag = changed.select(*on).distinct().withColumn("__changed", F.lit(True))
    return (
        files.join(flag, list(on), "left")
        .groupBy(*keys)
        .agg(F.count("__changed").alias("files_scanned"), F.count(F.lit(1)).alias("files_total"))
    )


def under_prefixes(
    files: DataFrame, members: DataFrame, repo: str = "repo", path: str = "path", prefix: str = "prefix"
) -> DataFrame:
    """Files joined to the members whose folder they are in (or are).

    Each file lists the folders above it and itself, so this is an equi join on (repo, folder) and
    not a comparison of every file with every member.
    """
    above = F.concat(paths.parent_folders(F.col(path)), F.array(paths.posix(F.col(path))))
    tagged = files.withColumn("__folder", F.explode(above))
    keyed = members.withColumn("__folder", F.regexp_replace(F.col(prefix), "/$", ""))
    return tagged.join(keyed, [repo, "__folder"]).drop("__folder")
