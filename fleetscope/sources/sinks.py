"""Report documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.operators.ordered import with_part

ITEMS_PER_PART = 1000


def report_payload(
    sections: Mapping[str, DataFrame],
    keys: Sequence[str] = ("repo",),
    identity: Mapping[str, Sequence[str]] | None = None,
    per_part: int = ITEMS_PER_PART,
) -> DataFrame:
    """``(keys, section, part, items, payload)``: the facts of each repository as JSON documents.

    A section with up to ``per_part`` items is one document; a larger one is written as several parts
    of about that size, so neither a task nor a row has to hold a repository's whole list. Items of a
    part are sorted; ``identity`` names the columns that place an item (default: all of them).
    """
    out = None
    for name, df in sections.items():
        columns = [c for c in df.columns if c not in keys]
        placed = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in (identity or {}).get(name, columns)])
        item = F.to_json(F.struct(*columns))
        rows = with_part(df.select(*keys, placed.alias("__id"), item.alias("__item")), keys, F.col("__id"), per_part)
        listed = F.array_sort(F.collect_list("__item"))
        part = rows.groupBy(*keys, "part").agg(
            F.count(F.lit(1)).alias("items"),
            F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("payload"),
        )
        part = part.select(*keys, F.lit(name).alias("section"), "part", "items", "payload")
        out = part if out is None else out.unionByName(part)
    return out


def write_reports(payload: DataFrame, path: str, partition: str = "section", mode: str = "overwrite") -> None:
    """JSON lines, one folder per section. Repositories are many and small, so they are no partitions."""
    payload.write.mode(mode).partitionBy(partition).json(path)
