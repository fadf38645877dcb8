"""Ordered computations that survive a hot key.

A plain window over one key sends the whole key to one task. The three carries below take a
``block``: a column that grows with the order (a day, ``line_no div 10000``). Rows are then windowed
per (key, block), one summary row per block is windowed per key, and the summary is joined back.
Without ``block`` the plain window is used, for inputs whose groups are known to be small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "__o_block"

#: Sub-keys over which the rows of one key are dealt in :func:`join_groups`: for raw rows, and for rows
#: that are already aggregated, where a hot key is much smaller and repeating the groups weighs more.
SALTS = 32
FEW_SALTS = 8

#: Tasks of :func:`deal`: for rows that fill memory, and for rows that cost time, where a task's start weighs more.
#: Splits of files and adaptive shuffles follow bytes; rows that cost far more than their bytes tell would
#: share a few tasks, or one. Adaptive execution leaves these numbers alone.
DEALT = 256
FEW_DEALT = 64


def _ordering(order: Sequence[str]) -> Column:
    return F.struct(*order)


def _within(keys: Sequence[str], order: Sequence[str], block: Column | None):
    return Window.partitionBy(*keys, *([_BLOCK] if block is not None else [])).orderBy(*order)


def _across(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(_BLOCK)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, str],
    block: Column | None = None,
) -> DataFrame:
    """Adds ``out -> value of the preceding row`` per key (NULL on the first row)."""
    values = dict(values)
    if block is None:
        window = _within(keys, order, None)
        return df.select("*", *[F.lag(col).over(window).alias(out) for out, col in values.items()])
    rows = df.withColumn(_BLOCK, block)
    window = _within(keys, order, block)
    pack = F.struct(*[F.col(col).alias(out) for out, col in values.items()])
    tails = rows.groupBy(*keys, _BLOCK).agg(F.max_by(pack, _ordering(order)).alias("__o_tail"))
    before = tails.select(*keys, _BLOCK, F.lag("__o_tail").over(_across(keys)).alias("__o_before"))
    joined = rows.select(
        "*", F.lag(pack).over(window).alias("__o_prev"), F.row_number().over(window).alias("__o_n")
    ).join(before, [*keys, _BLOCK], "left")
    chosen = F.when(F.col("__o_n") == 1, F.col("__o_before")).otherwise(F.col("__o_prev"))
    return joined.select(*df.columns, *[chosen[out].alias(out) for out in values])


def with_running_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, str],
    block: Column | None = None,
) -> DataFrame:
    """Adds ``out -> last non-NULL value up to and including the row`` per key."""
    values = dict(values)
    upto = (Window.unboundedPreceding, Window.currentRow)
    if block is None:
        window = _within(keys, order, None).rowsBetween(*upto)
        return df.select("*", *[F.last(c, ignorenulls=True).over(window).alias(o) for o, c in values.items()])
    rows = df.withColumn(_BLOCK, block)
    window = _within(keys, order, block).rowsBetween(*upto)
    tails = rows.groupBy(*keys, _BLOCK).agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), _ordering(order))).alias(f"__o_t_{o}")
            for o, c in values.items()
        ]
    )
    earlier = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    before = tails.select(
        *keys, _BLOCK, *[F.last(f"__o_t_{o}", ignorenulls=True).over(earlier).alias(f"__o_b_{o}") for o in values]
    )
    joined = rows.select(
        "*", *[F.last(c, ignorenulls=True).over(window).alias(f"__o_w_{o}") for o, c in values.items()]
    ).join(before, [*keys, _BLOCK], "left")
    return joined.select(
        *df.columns, *[F.coalesce(F.col(f"__o_w_{o}"), F.col(f"__o_b_{o}")).alias(o) for o in values]
    )


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    block: Column | None = None,
) -> DataFrame:
    """Adds the running sum of a numeric column per key."""
    upto = (Window.unboundedPreceding, Window.currentRow)
    if block is None:
        return df.select("*", F.sum(value).over(_within(keys, order, None).rowsBetween(*upto)).alias(out))
    rows = df.withColumn(_BLOCK, block)
    window = _within(keys, order, block).rowsBetween(*upto)
    earlier = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy(*keys, _BLOCK)
        .agg(F.sum(value).alias("__o_sum"))
        .select(*keys, _BLOCK, F.sum("__o_sum").over(earlier).alias("__o_before"))
    )
    joined = rows.select("*", F.sum(value).over(window).alias("__o_within")).join(before, [*keys, _BLOCK], "left")
    total = F.coalesce(F.col("__o_within") + F.col("__o_before"), "__o_within", "__o_before")
    return joined.select(*df.columns, total.alias(out))


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str | None = None
) -> DataFrame:
    """First ``k`` rows per key. The rank filter sits on the window, so Spark cuts every map task's
    share to ``k`` rows per key before the shuffle; a hot key sends little."""
    if k < 1:
        raise ValueError("k must be at least 1")
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def deal(df: DataFrame, by: Sequence[str], parts: int = DEALT) -> DataFrame:
    """``df`` dealt over ``parts`` tasks by the hash of ``by``, which should have no hot value."""
    return df.repartition(parts, *by)


def spread(key: Column, parts: Column) -> Column:
    """Stable part number of a row: the same in every run and on every machine."""
    digest = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 7), 16, 10).cast("bigint")
    return F.pmod(digest, parts)


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], item: Column, salts: int = SALTS, how: str = "inner"
) -> DataFrame:
    """``rows`` with the columns of ``groups``, which has at most one row per key; rows without one are
    dropped, or kept with nulls if ``how`` is ``left``.

    Groups that Spark takes to fit a broadcast go to every task as they are. Else the rows of a key are dealt over
    ``salts`` sub-keys by a stable hash of ``item`` and the group row is repeated for each, so a key that
    holds a third of all rows is joined in many tasks. The group side grows by the factor ``salts``, but
    it is one narrow row per key; it is never broadcast.
    """
    if _is_small(groups):
        return rows.join(groups, list(keys), how)
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(item), F.lit(salts)).cast("int"))
    return dealt.join(_repeated(groups, salts), [*keys, "__salt"], how).drop("__salt")


def _is_small(df: DataFrame) -> bool:
    """Whether Spark's own estimate of ``df`` is within its limit of broadcasts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def _repeated(groups: DataFrame, salts: int) -> DataFrame:
    """``groups`` once for each ``__salt`` below ``salts``. Spark takes an explode to make no rows, and would broadcast
    all copies of what fits once; the rows of an unpivot it counts."""
    names = [f"__salt_{salt}" for salt in range(salts)]
    dealt = groups.select("*", *[F.lit(salt).alias(name) for salt, name in enumerate(names)])
    return dealt.unpivot([F.col(f"`{c}`") for c in groups.columns], names, "__which", "__salt").drop("__which")


def with_part(
    df: DataFrame, keys: Sequence[str], item: Column, per_part: int, out: str = "part"
) -> DataFrame:
    """Adds a part number that splits every group into parts of about ``per_part`` rows.

    Collecting (keys, part) instead of keys bounds the size of each collected list however large a
    group is, and loses nothing.
    """
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / per_part).alias("__parts"))
    return join_groups(df, sizes, keys, item).withColumn(out, spread(item, F.col("__parts"))).drop("__parts")
