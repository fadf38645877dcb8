"""Who owns which module, and how much of it assistants wrote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import labels
from fleetscope.operators.history import BURST_SECONDS, bursts
from fleetscope.operators.ordered import FEW_SALTS, join_groups, top_k

def line_counts(
    blame: DataFrame,
    keys: Sequence[str] = ("repo", "module"),
    repo: str = "repo",
    path: str = "path",
    author: str = "author",
    sha: str = "sha",
) -> DataFrame:
    """Blame lines counted per (module, path, author, commit): what every operator below works on.

    A commit that wrote a third of all lines shrinks to one row per file before any join, and because
    the operators read the same aggregation, Spark runs its shuffle once and reuses it.
    """
    group = dict.fromkeys([*keys, repo, path, author, sha])
    return blame.groupBy(*group).agg(F.count(F.lit(1)).alias("lines")).filter(F.col("lines") > 0)


def owned_lines(
    counts: DataFrame, keys: Sequence[str] = ("repo", "module"), author: str = "author"
) -> DataFrame:
    """Lines per (module, author)."""
    return counts.groupBy(*keys, author).agg(F.sum("lines").alias("lines"))


def module_totals(counts: DataFrame, keys: Sequence[str] = ("repo", "module"), sha: str = "sha") -> DataFrame:
    """Lines and distinct commits per module."""
    return counts.groupBy(*keys).agg(
        F.sum("lines").alias("line_count"), F.count_distinct(sha).alias("commits")
    )


def shares(
    lines: DataFrame, keys: Sequence[str] = ("repo", "module"), author: str = "author", count: str = "lines"
) -> DataFrame:
    """Whole-number percentages that add up to 100: rounded half up, the rest goes to the largest
    contributor (ties by name) and never below 0.

    Two aggregations and salted joins instead of whole-partition windows, so that a module with very
    many contributors is not handled in one task.
    """
    totals = lines.groupBy(*keys).agg(F.sum(count).alias("__total")).filter(F.col("__total") > 0)
    rounded = join_groups(lines, totals, keys, F.col(author), FEW_SALTS).withColumn(
        "__share", F.floor(F.col(count) / F.col("__total") * 100 + 0.5)
    )
    rest = rounded.groupBy(*keys).agg(
        (100 - F.sum("__share")).alias("__rest"),
        F.min_by(author, F.struct((-F.col(count)).alias("n"), F.col(author).alias("a"))).alias("__largest"),
    )
    gift = F.when(F.col(author) == F.col("__largest"), F.col("__rest")).otherwise(0)
    return join_groups(rounded, rest, keys, F.col(author), FEW_SALTS).select(
        *keys, author, count, F.greatest(F.lit(0), F.col("__share") + gift).cast("int").alias("share")
    )


def tag_commits(
    commits: DataFrame,
    tools: Sequence[tuple[str, str]] = labels.MESSAGE_TOOLS,
    author_tools: Sequence[tuple[str, str]] = labels.AUTHOR_TOOLS,
    message: str = "message",
    author: str = "author",
    email: str = "email",
) -> DataFrame:
    """Adds ``ai_tools`` (sorted) to commits, from message and author."""
    found = F.array_union(
        labels.tools_in_text(F.coalesce(message, F.lit("")), tools),
        labels.tools_of_author(F.col(author), F.col(email), author_tools),
    )
    return commits.withColumn("ai_tools", F.array_sort(found))


def ai_lines(
    counts: DataFrame,
    tagged: DataFrame,
    keys: Sequence[str] = ("repo", "module"),
    repo: str = "repo",
    path: str = "path",
    sha: str = "sha",
    inline_files: DataFrame | None = None,
) -> DataFrame:
    """Per module: lines, lines of assisted commits or files, and their percentage."""
    assisted = tagged.filter(F.size("ai_tools") > 0).select(repo, sha).distinct().withColumn("__ai", F.lit(True))
    joined = counts.join(assisted, [repo, sha], "left")
    if inline_files is None:
        flagged = joined.withColumn("__inline", F.lit(False))
    else:
        marks = inline_files.select(repo, path).distinct().withColumn("__inline", F.lit(True))
        flagged = joined.join(marks, [repo, path], "left")
    is_ai = F.coalesce("__ai", F.lit(False)) | F.coalesce("__inline", F.lit(False))
    totals = flagged.groupBy(*keys).agg(
        F.sum("lines").alias("line_count"), F.sum(F.when(is_ai, F.col("lines")).otherwise(0)).alias("ai_line_count")
    )
    return totals.withColumn("ai_percent", F.bround(F.col("ai_line_count") / F.col("line_count") * 100, 1))


def _touched(counts: DataFrame, tagged: DataFrame, columns: Sequence[str], keys: Sequence[str], repo: str, sha: str) -> DataFrame:
    """(module, assisted commit) pairs, each once."""
    pairs = counts.filter(F.col("lines") > 0).select(*dict.fromkeys([*keys, repo, sha])).distinct()
    return pairs.join(tagged.filter(F.size("ai_tools") > 0).select(repo, sha, *columns), [repo, sha])


def module_tools(
    counts: DataFrame,
    tagged: DataFrame,
    keys: Sequence[str] = ("repo", "module"),
    repo: str = "repo",
    sha: str = "sha",
) -> DataFrame:
    """Sorted distinct tool labels per module; the set is bounded by the tool list."""
    found = _touched(counts, tagged, ["ai_tools"], keys, repo, sha)
    return (
        found.select(*keys, F.explode("ai_tools").alias("__tool"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("__tool")).alias("ai_tools"))
    )


def module_bursts(
    counts: DataFrame,
    tagged: DataFrame,
    keys: Sequence[str] = ("repo", "module"),
    repo: str = "repo",
    sha: str = "sha",
    ts: str = "ts",
    seconds: int = BURST_SECONDS,
    minimum: int = 3,
) -> DataFrame:
    """Whether a module saw a burst of assisted commits."""
    return bursts(_touched(counts, tagged, [ts], keys, repo, sha), keys, ts, seconds, minimum)


def top_contributors(
    shared: DataFrame,
    keys: Sequence[str] = ("repo", "module"),
    author: str = "author",
    share: str = "share",
    is_ai: Column | None = None,
) -> DataFrame:
    """Primary and secondary contributor: people first, assistants only where there are no people."""
    ai = F.size(labels.tools_of_author(F.col(author), F.lit(""))) > 0 if is_ai is None else is_ai
    marked = shared.withColumn("__ai", ai)
    best = top_k(marked, keys, ["__ai", F.desc(share), F.asc(author)], 2, rank="__rank")
    pick = {n: F.when(F.col("__rank") == n, F.struct(author, share, "__ai")) for n in (1, 2)}
    pair = best.groupBy(*keys).agg(
        F.max(pick[1]).alias("__first"), F.max(pick[2]).alias("__second")
    )
    same_kind = F.col("__second.__ai") == F.col("__first.__ai")
    return pair.select(
        *keys,
        F.col(f"__first.{author}").alias("primary_owner"),
        F.col(f"__first.{share}").alias("primary_percent"),
        F.when(same_kind, F.col(f"__second.{author}")).otherwise("").alias("secondary"),
        F.when(same_kind, F.col(f"__second.{share}")).otherwise(0).alias("secondary_percent"),
    )


def module_ownership(
    contributors: DataFrame,
    ai: DataFrame,
    churn: DataFrame,
    tools: DataFrame | None = None,
    burst: DataFrame | None = None,
    keys: Sequence[str] = ("repo", "module"),
) -> DataFrame:
    """One row per module. The contributor list itself stays in rows (:func:`shares`): a module's
    number of contributors has no bound."""
    keys = list(keys)
    out = contributors.join(ai, keys).join(churn.select(*keys, F.col("changes").alias("recent_churn")), keys, "left")
    none = F.array().cast("array<string>")
    out = out.join(tools, keys, "left") if tools is not None else out.withColumn("ai_tools", none)
    out = out.join(burst, keys, "left") if burst is not None else out.withColumn("burst", F.lit(False))
    churned = F.coalesce("recent_churn", F.lit(0))
    labelled = F.coalesce("ai_tools", none)
    heavy = F.col("ai_percent") >= labels.AI_ASSISTED_PERCENT
    alone = (F.col("secondary") == "") & heavy
    filled = out.select(
        *keys,
        "primary_owner",
        "primary_percent",
        F.when(alone, F.lit("AI")).otherwise(F.col("secondary")).alias("secondary"),
        F.when(alone, F.col("ai_percent")).otherwise(F.col("secondary_percent").cast("double")).alias("secondary_percent"),
        (heavy | (F.size(labelled) > 0)).alias("ai_assisted"),
        "ai_percent",
        labelled.alias("ai_tools"),
        labels.expertise(F.col("primary_percent"), F.col("line_count"), churned).alias("expertise_level"),
        F.coalesce("burst", F.lit(False)).alias("rapid_ai_session"),
        "line_count",
    )
    return filled.withColumn(
        "secondary_text",
        labels.secondary_text(
            F.col("secondary"), F.col("secondary_percent"), F.col("ai_assisted"), F.col("ai_percent"), F.col("ai_tools")
        ),
    )
