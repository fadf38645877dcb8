"""Workspace definitions and the members they select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import documents, paths
from fleetscope.functions.text import let, lines, strip
from fleetscope.operators.ordered import join_groups

# Definition files in order of precedence.
DEFINITIONS = ["pnpm-workspace.yaml", "pnpm-workspace.yml", "lerna.json", "package.json", "Cargo.toml"]
_NONE = "array<string>"


def clean_pattern(pattern: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(strip(pattern), '^"+|"+$', ""), "^'+|'+$", "")
    return paths.posix(bare)


def yaml_patterns(content: Column) -> Column:
    """List items below ``packages:`` up to the next key, exclusions left out."""

    def below(rows: Column) -> Column:
        start = F.array_position(rows, "packages:").cast("int")
        after = F.slice(rows, F.greatest(start + 1, F.lit(1)), F.size(rows))
        return F.when(start > 0, let(after, items))

    def items(after: Column) -> Column:
        keys = F.filter(after, lambda r: r.contains(":") & ~r.startswith("-"))
        stop = F.coalesce(F.array_position(after, F.get(keys, 0)).cast("int"), F.lit(0))
        kept = F.when(stop > 0, F.slice(after, F.lit(1), stop - 1)).otherwise(after)
        named = F.transform(
            F.filter(kept, lambda r: r.startswith("- ")), lambda r: clean_pattern(F.substr(r, F.lit(3)))
        )
        return F.filter(named, lambda p: ~p.startswith("!"))

    rows = F.filter(F.transform(lines(content), strip), lambda r: (r != "") & ~r.startswith("#"))
    return let(rows, below)


def json_patterns(content: Column, *fields: str) -> Column:
    """The first of the fields that holds a list."""
    lists = F.coalesce(*[documents.string_list(content, *field.split(".")) for field in fields])
    found = F.when(~documents.malformed_json(content), lists)
    return F.transform(F.filter(found, lambda p: strip(p) != ""), clean_pattern)


def cargo_patterns(content: Column) -> Column:
    """``members`` of the ``[workspace]`` table without its ``exclude``."""
    section = F.regexp_extract(content, r"(?ms)^\s*\[workspace\]\s*$(.*?)(?=^\s*\[|\z)", 1)

    def listed(key: str) -> Column:
        inner = F.regexp_extract(section, rf"(?ms)^\s*{key}\s*=\s*\[(.*?)\]", 1)
        return F.transform(F.regexp_extract_all(inner, F.lit('"([^"]+)"'), F.lit(1)), clean_pattern)

    return F.array_except(listed("members"), listed("exclude"))


def workspace_patterns(files: DataFrame, repo: str = "repo", path: str = "path", content: str = "content") -> DataFrame:
    """``repo, source, patterns``: the first definition with any pattern, in the fixed order."""
    text, name = F.col(content), F.col(path)
    patterns = (
        F.when(name.startswith("pnpm-workspace.y"), yaml_patterns(text))
        .when(name == "lerna.json", json_patterns(text, "packages"))
        .when(name == "package.json", json_patterns(text, "workspaces", "workspaces.packages"))
        .when(name == "Cargo.toml", cargo_patterns(text))
    )
    place = F.array_position(paths.literals(DEFINITIONS), name)
    found = files.filter(name.isin(DEFINITIONS)).select(
        repo, name.alias("source"), patterns.alias("patterns"), place.alias("__n")
    )
    best = F.min_by(F.struct("source", "patterns"), F.col("__n"))
    return found.filter(F.size("patterns") > 0).groupBy(repo).agg(best.alias("__b")).select(repo, "__b.*")


def workspace_members(
    files: DataFrame, patterns: DataFrame, repo: str = "repo", path: str = "path"
) -> DataFrame:
    """``repo, name, prefix``: folders selected by their repository's patterns; a repository without a
    hit is its own single member with no prefix.

    A pattern selects whole folders, its ``*`` staying within one segment. Every file offers the
    folders above it, and the patterns of a repository arrive as one regex, so rows never multiply by
    the number of patterns.
    """
    folders = files.select(repo, F.explode(paths.parent_folders(F.col(path))).alias("folder")).distinct()

    def folder_regex(pattern: Column) -> Column:
        bare = F.regexp_replace(pattern, "/+$", "")
        regex = F.regexp_replace(bare, r"([.^$+{}()|\\])", r"\\$1")
        regex = F.replace(regex, F.lit("[!"), F.lit("[^"))
        regex = F.regexp_replace(F.regexp_replace(regex, r"\*\*/", "\u0001"), r"/\*\*$", "\u0002")
        regex = F.regexp_replace(regex, r"\*", "[^/]*")
        regex = F.replace(F.replace(regex, F.lit("?"), F.lit("[^/]")), F.lit("\u0001"), F.lit("(?:[^/]+/)*"))
        return F.replace(regex, F.lit("\u0002"), F.lit("(?:/.+)?"))

    any_pattern = F.concat(F.lit("^(?:"), F.array_join(F.transform("patterns", folder_regex), "|"), F.lit(")$"))
    hits = (
        join_groups(folders, patterns.select(repo, any_pattern.alias("__regex")), [repo], F.col("folder"))
        .filter(F.rlike("folder", F.col("__regex")) & (F.substring_index("folder", "/", -1) != "node_modules"))
        .select(repo, F.substring_index("folder", "/", -1).alias("name"), F.concat("folder", F.lit("/")).alias("prefix"))
    )
    single = files.select(repo).distinct().join(hits.select(repo).distinct(), repo, "left_anti").select(
        repo, F.col(repo).cast("string").alias("name"), F.lit(None).cast("string").alias("prefix")
    )
    return hits.unionByName(single)
