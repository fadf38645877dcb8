"""Benchmark items inside documents: bottom-k MinHash containment search by item size, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from fleetscope.llm.shared import free_name, text_slices
from fleetscope.llm.shingling import mix, shingle_sets, words_of

#: Containment from which an item counts as found, in hundredths.
CONTAINMENT_PERCENT = 75
#: Shingles of items that are sent to every executor at once; more items mean more passes.
BLOCK_SHINGLES = 2_000_000


def needed(count, percent: int = CONTAINMENT_PERCENT):
    """Shingles of ``count`` that must be found."""
    return -(-percent * count // 100)


class ItemBlock:
    """Items whose sketches are searched together.

    An item of ``q`` shingles, ``c`` of which must occur in a document, has the ``q - c + 1`` least
    values of one MinHash permutation as its sketch: a document that lacks all of them holds at most
    ``c - 1`` shingles, so the sketch loses no item, however long the document is. Items are partitioned
    by size, and a block takes partitions in turn.
    """

    def __init__(self, items: list[tuple[object, np.ndarray]], percent: int) -> None:
        self.ids = [item for item, _ in items]
        self.sets = [shingles for _, shingles in items]
        self.needed = [needed(len(s), percent) for s in self.sets]
        keys, owners = [], []
        for number, (shingles, need) in enumerate(zip(self.sets, self.needed, strict=True)):
            least = shingles[np.argsort(mix(shingles, 7), kind="stable")[: len(shingles) - need + 1]]
            keys.append(least)
            owners.append(np.full(len(least), number, dtype=np.int64))
        every = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.keys = every[order]
        self.owners = np.concatenate(owners)[order] if owners else np.empty(0, np.int64)
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def search(self, shingles: np.ndarray) -> list[tuple[object, int, int]]:
        """``(item, its shingles, how many of them occur)`` for the items found in a document's set."""
        near = shingles[self.seen[(shingles & np.uint64(0xFFFF)).astype(np.int64)]]
        if not len(near) or not len(self.keys):
            return []
        lo, hi = np.searchsorted(self.keys, near, "left"), np.searchsorted(self.keys, near, "right")
        found = []
        hits = [self.owners[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b > a]
        for number in np.unique(np.concatenate(hits)).tolist() if hits else []:
            own = self.sets[number]
            at = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
            common = int(np.count_nonzero(shingles[at] == own))
            if common >= self.needed[number]:
                found.append((self.ids[number], len(own), common))
        return found


def _item_blocks(items: DataFrame, item_id: str, text: str, block_shingles: int) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Items by size partition (powers of two of their shingles), in blocks of bounded size.

    Spark makes the shingles and sorts the items; the driver holds one block at a time."""
    kind = items.schema[item_id].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, 1):
                found = list(shingle_sets(words_of(batch.column(1))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())],
                    names=["item", "size", "shingles"],
                )

    rows = items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).mapInArrow(sets, f"item {kind}, size long, shingles binary")
    ordered = rows.filter("size > 0").orderBy(F.floor(F.log2("size")), "item", "shingles")
    block, held = [], 0
    for row in ordered.toLocalIterator():
        if block and held + row["size"] > block_shingles:
            yield block
            block, held = [], 0
        block.append((row.item, np.frombuffer(row.shingles, dtype=np.uint64)))
        held += row["size"]
    yield block


def find_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    percent: int = CONTAINMENT_PERCENT, out: str = "items_found", block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``docs`` with ``out``, an array of ``struct<item_id, n_shingles, n_common>`` of the items of which
    at least ``percent`` hundredths of the distinct five-word shingles occur in the whole text.

    No row moves. Items go out in blocks of at most ``block_shingles`` shingles (or one item), and
    documents pass once for each block. An item of fewer than five words has its whole sequence as its
    one shingle and is found where that is all of a document. Null, empty and wordless texts hold and
    are nothing; items that repeat an id are found apart; a null item id stays null. Without items every
    array is empty. Columns of ``docs`` keep their names; a clashing ``out`` gets underscores.
    """
    out = free_name(docs.columns, out)
    kind = items.schema[item_id].dataType
    found = docs
    names = []
    for number, block in enumerate(_item_blocks(items, item_id, item_text, block_shingles)):
        names.append(free_name(found.columns, f"{out}_{number}"))
        found = _search_block(found, ItemBlock(block, percent), text, names[-1], kind)
    parts = [F.col(f"`{name}`") for name in names]
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], (F.concat(*parts) if len(parts) > 1 else parts[0]).alias(out))


def _search_block(docs: DataFrame, block: ItemBlock, text: str, name: str, kind) -> DataFrame:
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(vars(block))
    schema = StructType([*docs.schema.fields]).add(
        name, ArrayType(StructType().add("item_id", kind).add("n_shingles", LongType()).add("n_common", LongType()))
    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        struct = pa.struct([("item_id", to_arrow_type(kind)), ("n_shingles", pa.int64()), ("n_common", pa.int64())])
        search = ItemBlock.__new__(ItemBlock)
        vars(search).update(shared.value)
        for whole in batches:
            for batch in text_slices(whole, at):
                hits = [search.search(s) for s in shingle_sets(words_of(batch.column(at)))]
                rows = [[{"item_id": i, "n_shingles": q, "n_common": c} for i, q, c in h] for h in hits]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(struct))], names=[*batch.schema.names, name])

    return docs.mapInArrow(add, schema)


def contained_pairs(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item found in it: ``doc_id, item_id, n_shingles, n_common,
    containment``. Edge cases as in :func:`find_items`."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = find_items(rows, items, "text", item_id, item_text)
    return found.select("doc_id", F.explode("items_found").alias("hit")).select(
        "doc_id", "hit.*", (F.col("hit.n_common") / F.col("hit.n_shingles")).alias("containment")
    )
