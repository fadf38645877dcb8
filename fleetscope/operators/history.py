"""Commit history: noise, run collapsing, timelines, churn hotspots, bursts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions import labels, paths
from fleetscope.functions.moments import epoch_micros
from fleetscope.operators.ordered import FEW_SALTS, join_groups, top_k, with_previous, with_running_sum

# Fixed values.
NOISE_PREFIXES = ["fix typo", "wip", "update", "checkpoint", "save", "fix", "refactor", "cleanup", "minor", "test"]
ITERATION = r"(?U)^(.+?)\s+(\d+(?:\.\d+)*|\w+)$"
KEEP_COMMITS = 25
HOTSPOTS_PER_REPO = 5
CHURN_DAYS = 30
MODULE_CHURN_DAYS = 90
BURST_SECONDS = 30 * 60
BURST_EVENTS = 3


def noisy(subject: Column, prefixes: Sequence[str] = NOISE_PREFIXES) -> Column:
    """Subject starting with a noise prefix; no word boundary, so ``testimonials`` is noise too."""
    return subject.rlike("(?i)^(?:" + "|".join(labels.quote_regex(p) for p in prefixes) + ")")


def drop_noise(commits: DataFrame, subject: str = "subject", prefixes: Sequence[str] = NOISE_PREFIXES) -> DataFrame:
    return commits.filter(~noisy(F.col(subject), prefixes))


def noise_counts(
    commits: DataFrame, keys: Sequence[str] = ("repo",), subject: str = "subject", prefixes: Sequence[str] = NOISE_PREFIXES
) -> DataFrame:
    """Commits read, kept, and dropped as noise."""
    read, kept = F.count(F.lit(1)), F.count_if(~noisy(F.col(subject), prefixes))
    return commits.groupBy(*keys).agg(read.alias("commits_read"), kept.alias("commits_kept"), (read - kept).alias("commits_dropped"))


def iteration_base(subject: Column) -> Column:
    """Subject without its last word, NULL when it has none to split off."""
    return F.nullif(F.regexp_extract(subject, ITERATION, 1), F.lit(""))


def collapse_runs(
    commits: DataFrame,
    keys: Sequence[str] = ("repo",),
    order: Sequence[str] = ("ts", "hash"),
    subject: str = "subject",
    date: str = "date",
    hash_col: str = "hash",
    author: str = "author",
    block: Column | None = None,
) -> DataFrame:
    """Adjacent commits that differ in their last word only become one row.

    ``order`` is ascending and unique per key. Columns: keys, hash, author, date, subject, commits,
    first_ts (order value of the oldest) and ordering (of the newest).
    """
    based = commits.withColumn("__text", iteration_base(F.col(subject))).withColumn("__base", F.lower("__text"))
    linked = with_previous(based, keys, order, {"__before": "__base"}, block)
    starts = linked.withColumn(
        "__start", F.when(F.col("__base") == F.col("__before"), 0).otherwise(1)
    )
    runs = with_running_sum(starts, keys, order, "__start", "__run", block)
    position = F.struct(*order)
    newest = F.max_by(
        F.struct(
            F.col(hash_col).alias("hash"),
            F.col(author).alias("author"),
            F.col(date).alias("date"),
            F.col(subject).alias("subject"),
            F.col("__text").alias("base"),
        ),
        position,
    )
    grouped = runs.groupBy(*keys, "__run").agg(
        F.count(F.lit(1)).alias("commits"),
        newest.alias("__newest"),
        F.min_by(date, position).alias("__oldest"),
        F.max(position).alias("ordering"),
    )
    many = F.col("commits") >= 2
    span = F.concat_ws(" — ", F.col("__oldest").cast("string"), F.col("__newest.date").cast("string"))
    label = F.concat(F.col("__newest.base"), F.lit(": "), F.col("commits").cast("string"), F.lit(" iterations"))
    return grouped.select(
        *keys,
        F.col("__newest.hash").alias("hash"),
        F.col("__newest.author").alias("author"),
        F.when(many, span).otherwise(F.col("__newest.date").cast("string")).alias("date"),
        F.when(many, label).otherwise(F.col("__newest.subject")).alias("subject"),
        "commits",
        "ordering",
    )


def newest_blocks(commits: DataFrame, keys: Sequence[str], subject: str, block: str, runs: int) -> DataFrame:
    """``commits`` of each key's newest blocks, as many as surely hold more than ``runs`` runs.

    A block with d distinct texts holds d runs or more, of which one may go on from the block before, so
    the distinct texts of a block, less one, add up to a lower bound; it is counted without sorting any history.
    """
    text = F.lower(iteration_base(F.col(subject)))
    counted = commits.groupBy(*keys, block).agg((F.count_distinct(text) + F.count_if(text.isNull()) - 1).alias("__n"))
    newer = Window.partitionBy(*keys).orderBy(F.desc(block)).rowsBetween(Window.unboundedPreceding, -1)
    wanted = counted.withColumn("__before", F.coalesce(F.sum("__n").over(newer), F.lit(0))).filter(F.col("__before") < runs)
    return commits.join(wanted.select(*keys, block), [*keys, block], "left_semi")


def timeline(
    commits: DataFrame,
    keys: Sequence[str] = ("repo",),
    order: Sequence[str] = ("ts", "hash"),
    subject: str = "subject",
    keep: int = KEEP_COMMITS,
    prefixes: Sequence[str] = NOISE_PREFIXES,
    block: str = "date",
    **columns: str,
) -> DataFrame:
    """The newest ``keep`` rows of the whole history without noise, runs collapsed, newest first.

    ``block`` is a column that grows with the order. Only the newest blocks, as many as hold the rows that are
    kept, are sorted; a history of noise alone costs one count.
    """
    recent = newest_blocks(drop_noise(commits, subject, prefixes), list(keys), subject, block, keep)
    collapsed = collapse_runs(recent, keys, order, subject, block=F.col(block), **columns)
    return top_k(collapsed, keys, [F.desc("ordering")], keep, rank="position").drop("ordering")


def clocks(touches: DataFrame, keys: Sequence[str] = ("repo",), ts: str = "ts", latest: Column | None = None) -> DataFrame:
    """The newest time per key as ``clock``. Times after ``latest`` (default: now) come from wrong
    clocks and count only where there are no others."""
    limit = F.current_timestamp() if latest is None else latest
    newest = F.coalesce(F.max(F.when(F.col(ts) <= limit, F.col(ts))), F.max(ts))
    return touches.groupBy(*keys).agg(newest.alias("clock"))


def recent_touches(
    touches: DataFrame, days: int, ts: str = "ts", as_of: Column | None = None, clock: Sequence[str] = ("repo",), told: DataFrame | None = None
) -> DataFrame:
    """Touches of the last ``days`` before ``as_of``, by default before each ``clock`` key's own newest one, so that
    one repository's clock moves no other's. ``told`` may name the table that the clocks are read from."""
    span = F.expr(f"INTERVAL {int(days)} DAYS")
    if as_of is not None:
        return touches.filter(F.col(ts) >= as_of - span)
    known = clocks(touches if told is None else told, clock, ts)
    if not clock:
        return touches.filter(F.col(ts) >= known.scalar() - span)
    dealt = join_groups(touches, known.withColumnRenamed("clock", "__clock"), list(clock), F.col(ts), FEW_SALTS)
    return dealt.filter(F.col(ts) >= F.col("__clock") - span).select(*touches.columns)


def churn(
    touches: DataFrame,
    keys: Sequence[str] = ("repo", "path"),
    ts: str = "ts",
    days: int = CHURN_DAYS,
    as_of: Column | None = None,
    clock: Sequence[str] = ("repo",),
    told: DataFrame | None = None,
) -> DataFrame:
    """Recent touches per key (:func:`recent_touches`)."""
    return recent_touches(touches, days, ts, as_of, clock, told).groupBy(*keys).agg(F.count(F.lit(1)).alias("changes"))


def hotspots(
    counts: DataFrame, keys: Sequence[str] = ("repo",), path: str = "path", changes: str = "changes", k: int = HOTSPOTS_PER_REPO
) -> DataFrame:
    """Most changed paths per key, ties by name."""
    return top_k(counts, keys, [F.desc(changes), F.asc(path)], k, rank="rank")


def numstat_churn(
    numstat: DataFrame, files: DataFrame | None = None, keys: Sequence[str] = ("repo",), path: str = "path"
) -> DataFrame:
    """Changed lines per still existing path, from ``added``/``deleted`` counts."""
    live = numstat if files is None else numstat.join(files.select(*keys, path), [*keys, path], "left_semi")
    return live.groupBy(*keys, path).agg(F.sum(F.col("added") + F.col("deleted")).alias("changes"))


def module_churn(
    touches: DataFrame,
    repo: str = "repo",
    path: str = "path",
    ts: str = "ts",
    days: int = MODULE_CHURN_DAYS,
    as_of: Column | None = None,
    eligible: DataFrame | None = None,
    buckets: Sequence[str] = paths.MODULE_BUCKETS,
) -> DataFrame:
    """Recent touches per module, over eligible files only."""
    kept = touches if eligible is None else touches.join(eligible.select(repo, path), [repo, path], "left_semi")
    named = kept.withColumn("module", paths.module_key(F.col(path), buckets))
    return churn(named, [repo, "module"], ts, days, as_of, [repo], touches)


def hotspot_matrix(
    counts: DataFrame, service: str = "repo", path: str = "path", changes: str = "changes", limit: int = KEEP_COMMITS
) -> DataFrame:
    """The fleet's ``limit`` hottest files, however many of them a service has.

    Ranks are given after the distributed top-n, so the unpartitioned window sees ``limit`` rows.
    """
    order = [F.desc(changes), F.asc(service), F.asc(path)]
    top = counts.orderBy(*order).limit(limit)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), service, path, changes)


def sort_hotspots(counts: DataFrame, key: str = "changes", descending: bool | None = None, tie: str = "path") -> DataFrame:
    """By any column; counts fall and names rise unless told otherwise."""
    falling = key == "changes" if descending is None else descending
    return counts.orderBy(F.desc(key) if falling else F.asc(key), F.asc(tie))


def hotspot_density(
    counts: DataFrame, keys: Sequence[str] = ("repo",), changes: str = "changes", path: str = "path"
) -> DataFrame:
    """Each count against its group's maximum: percent, bar cells, heat tier.

    The maximum is aggregated and joined back: a window over a whole repository would buffer it in one
    task.
    """
    top = counts.groupBy(*keys).agg(F.max(changes).alias("__top"))
    value, peak = F.col(changes), F.col("__top")
    return join_groups(counts, top, keys, F.col(path), FEW_SALTS).select(
        *counts.columns,
        labels.density(value, peak).alias("density"),
        labels.bar_cells(value, peak).alias("cells"),
        labels.heat(value, peak).alias("heat"),
    )


def bursts(
    events: DataFrame,
    keys: Sequence[str] = ("repo",),
    ts: str = "ts",
    seconds: int = BURST_SECONDS,
    minimum: int = BURST_EVENTS,
) -> DataFrame:
    """``(keys, burst)``: whether any ``minimum`` events lie within ``seconds``.

    Time is cut into slots of ``seconds``. A slot with ``minimum`` events is a burst by itself, so no
    slot ever needs more than its ``minimum`` first events; sparser slots are kept whole and compared
    with the following slot. Groups are bounded by that, whatever a key holds.
    """
    epoch = epoch_micros(events, ts)
    width = seconds * 1_000_000
    slotted = events.select(*keys, epoch.alias("__t")).withColumn("__slot", F.floor(F.col("__t") / width))
    first = top_k(slotted, [*keys, "__slot"], ["__t"], minimum)
    slots = first.groupBy(*keys, "__slot").agg(F.array_sort(F.collect_list("__t")).alias("__ts"))
    # each slot meets its successor exactly once: pairs (2n, 2n+1) and (2n-1, 2n)
    shifted = slots.withColumn("__shift", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "__pair", F.col("__slot") + F.col("__shift")
    )
    ahead = Window.partitionBy(*keys, "__shift", F.floor(F.col("__pair") / 2)).orderBy("__slot")
    joined = shifted.withColumn("__next", F.lead("__ts").over(ahead))
    both = F.concat(F.col("__ts"), F.coalesce("__next", F.array().cast("array<bigint>")))
    tight = F.exists(
        F.transform(both, lambda t, i: F.coalesce(F.get(both, i + (minimum - 1)) - t <= width, F.lit(False))),
        lambda hit: hit,
    )
    # a dense slot lists its first events only, so it is judged alone
    alone = F.size("__ts") >= minimum
    return joined.groupBy(*keys).agg(F.bool_or(alone | tight).alias("burst"))
