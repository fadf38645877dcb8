"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.operators.ordered import join_groups

#: A chunk ends at the first full stop or line end after 512 characters, or at 8192 characters.
CHUNK_PATTERN = r"(?s).{512,8191}?(?:[.\n]|\z)|.{1,8192}"


def chunks(text: Column, pattern: str = CHUNK_PATTERN) -> Column:
    """Content-defined chunks of a text, which joined give the text: where a chunk ends depends only on
    the characters since it began."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _identifier(chunk: Column) -> Column:
    return F.unhex(F.substring(F.sha2(chunk.cast("binary"), 256), 1, 32))


def verify_identifiers(docs: DataFrame, text: str = "text", pattern: str = CHUNK_PATTERN) -> None:
    """Raises ValueError if two different chunks have one identifier.

    Every distinct chunk moves once, to the others with its identifier; copies are dropped before.
    """
    pieces = docs.select(F.explode(chunks(F.coalesce(F.col(text), F.lit("")), pattern)).alias("chunk"))
    distinct = pieces.select(_identifier(F.col("chunk")).alias("id"), "chunk").distinct()
    clash = distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if found := clash.count():
        raise ValueError(f"{found} chunk identifiers stand for more than one chunk")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pattern: str = CHUNK_PATTERN) -> DataFrame:
    """One row per document, dropped ones too: ``doc_id, keep_id, group_size, kept, text_sha256,
    n_chunks``.

    Chunks are reduced to verified identifiers, and documents are equal when their ordered identifier
    lists are; long texts do not move again. The largest doc_id of a group stays. Only groups of two or
    more are dealt to the sub-keys of the join; a row that finds none is alone.

    Null texts count as empty, and empty texts equal each other. A null doc_id is smaller than any
    other. If the id that stays occurs in several rows of its group, all of them say kept. An empty
    table gives an empty result; other columns are ignored.
    """
    verify_identifiers(docs, text, pattern)
    whole = F.coalesce(F.col(text), F.lit(""))
    recipes = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.transform(chunks(whole, pattern), _identifier).alias("recipe"),
        F.sha2(whole.cast("binary"), 256).alias("text_sha256"),
    )
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    found = join_groups(recipes, groups, ["recipe"], F.col("doc_id"), how="left")
    alone = F.col("size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("last"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )


def keep_largest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: of the rows with the largest doc_id one that
    is largest by a hash of its other columns, so repeated rows stay once. Nulls as in
    :func:`exact_groups`. Copies within a task are dropped before rows move; each other row moves once.
    """
    verify_identifiers(docs, text)
    whole = F.coalesce(F.col(text), F.lit(""))
    others = sorted(name for name in docs.columns if name not in (doc_id, text))
    rest = F.xxhash64(F.col(text).isNull(), *[F.col(f"`{name}`").cast("string") for name in others])
    rows = docs.select(
        F.transform(chunks(whole), _identifier).alias("recipe"),
        F.struct(F.col(doc_id).alias("id"), rest.alias("rest")).alias("rank"),
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
    )
    return rows.groupBy("recipe").agg(F.max_by("row", "rank").alias("row")).select("row.*")
