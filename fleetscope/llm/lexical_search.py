"""Ranked search for items by their terms: an automaton of all item terms goes over the texts themselves.

Terms are guarded: in text and automaton alike every character that is no part of a term becomes a blank,
and a pattern is a term between two blanks, so that a match is a whole term. Texts and terms are bytes of
UTF-8 throughout; no index of the documents is made. Items go in blocks, as many as one automaton holds;
each block reads the documents twice, once for the number of documents and terms and each term's document
frequency, once for the scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.shared import cut, text_slices
from fleetscope.operators.ordered import top_k

#: Bytes of item texts in a block. An automaton has at most so many nodes and two for each term.
BLOCK_BYTES = 1 << 21
TOP = 10
#: Cells of a table of documents by items, and postings of terms, that a task works on at once.
_CELLS = 1 << 21
# Fixed value: bytes that are parts of terms, lower-cased; all others become blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, repeats included."""
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """Terms of a block of items as a guarded automaton; its outputs lead to the items."""

    def __init__(self, items: list[list[bytes]]) -> None:
        import ahocorasick

        self.items = len(items)
        self.terms = sorted({term for own in items for term in own})
        place = {term: i for i, term in enumerate(self.terms)}
        pairs = [(place[term], i) for i, own in enumerate(items) for term in own]
        packed, times = np.unique(np.array([t * max(1, len(items)) + i for t, i in pairs], dtype=np.int64), return_counts=True)
        term, self.item = np.divmod(packed, max(1, len(items)))
        self.times = times
        # Term t leads to the items item[first[t]:first[t + 1]], each with its number of occurrences there.
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(self.terms):
            self.found.add_word(f" {term.decode('latin-1')} ", i)
        self.found.make_automaton()

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms in each text, and for every text and item term in it the text's row, the term, its occurrences."""
        contents = texts.cast(pa.binary()).to_pylist()
        folded = b" " + b"  ".join([(c or b"").translate(_FOLD) for c in contents]) + b" "
        sizes = np.array([len(c or b"") + 2 for c in contents], dtype=np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        blank = np.frombuffer(folded, dtype=np.uint8) == 32
        n = np.diff(np.concatenate([[0, 0], np.cumsum(blank[:-1] & ~blank[1:])])[edges])
        if not self.terms:
            return n, *[np.empty(0, np.int64)] * 3
        hits = np.fromiter(chain.from_iterable(self.found.iter(folded.decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
        rows = np.searchsorted(edges, hits[:, 0] - 1, "right") - 1
        keys, tf = np.unique(rows * len(self.terms) + hits[:, 1], return_counts=True)
        return n, *np.divmod(keys, len(self.terms)), tf.astype(np.int64)

    def scores(self, rows: np.ndarray, terms: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, item and summed ``values`` of rows and items that share terms, in parts of whole rows; all in integers."""
        reach = self.first[terms + 1] - self.first[terms]
        total = np.concatenate([[0], np.cumsum(reach)])
        begins = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else rows
        ends, lo = np.append(begins[1:], len(rows)), 0
        while lo < len(begins):
            at = begins[lo]
            hi = max(lo + 1, int(np.searchsorted(total[ends], total[at] + _CELLS, "right")))
            to = ends[hi - 1]
            lo = hi
            spread = np.repeat(np.arange(at, to), reach[at:to])
            posting = self.first[terms[spread]] + np.arange(len(spread)) - (total[spread] - total[at])
            keys = rows[spread] * self.items + self.item[posting]
            added = values[spread] * self.times[posting]
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            yield *np.divmod(keys[first], self.items), np.add.reduceat(added[order], first)


def _weights(count: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def _statistics(texts: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms, and each item term's document frequency, over all ``texts``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        df, documents, total = np.zeros(len(automaton.terms), dtype=np.int64), 0, 0
        for whole in batches:
            for batch in text_slices(whole, 0):
                n, _, term, _ = automaton.counts(batch.column(0))
                df += np.bincount(term, minlength=len(df))
                documents, total = documents + int((n > 0).sum()), total + int(n.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [-1, -2])), pa.array(np.append(df[held], [documents, total]))], names=["term", "n"])

    summed = dict(texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    df = np.zeros(len(shared.value.terms), dtype=np.int64)
    for term, n in summed.items():
        if term >= 0:
            df[term] = n
    return summed.get(-1, 0), summed.get(-2, 0), df


def _best(kept: list[tuple], k: int) -> list[np.ndarray]:
    """Of item, score, doc_id and its being null the first ``k`` of every item."""
    item, score, doc, null = (np.concatenate(c) for c in zip(*kept, strict=True))
    order = np.lexsort((doc, null, -score, item))
    begins = np.searchsorted(item[order], item[order])
    order = order[np.arange(len(order)) - begins < k]
    return [c[order] for c in (item, score, doc, null)]


def _blocks(items: DataFrame, limit: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and terms of items in ascending order, in blocks of about ``limit`` bytes of text; one block is held at a time."""
    ids: list = []
    terms: list[list[bytes]] = []
    held = 0
    for item, text in items.orderBy("item", "text").toLocalIterator():
        own = terms_of(text)
        if ids and ids[-1] == item:
            terms[-1] += own
        else:
            if held >= limit:
                yield ids, terms
                ids, terms, held = [], [], 0
            ids.append(item)
            terms.append(own)
        held += len((text or "").encode()) + 1
    if ids:
        yield ids, terms


def ranked_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` documents with the highest scores for each item: ``item_id, rank, doc_id, score``.

    Terms are runs of digits, letters and all characters beyond ASCII, A-Z lower-cased. With N documents
    that have a term, L terms in all, n in a document, a term in df documents and tf times in this one,
    w = floor(1000 ln((2N + 2) / (2df + 1))), m = 25 + 75nN div L, and a document's score is the sum of
    w (10^9 tf div (1000 tf + 8m)) over the item's terms, repeats included.

    Equal scores go by ascending doc_id, a null one last; documents without a term of the item have no
    row. Rows that share a doc_id are documents of their own, rows that share an item_id one item. Null and
    empty texts have no terms. ``item_id`` is integer. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc"))
    wanted = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    done = None
    for ids, terms in _blocks(wanted, block_bytes):
        shared = spark.sparkContext.broadcast(Automaton(terms))
        documents, total, df = _statistics(rows.select("text"), shared)
        weight, named = _weights(documents, df), ids

        def score(batches: Iterator[pa.RecordBatch], shared=shared, documents=documents, total=total, weight=weight, named=named) -> Iterator[pa.RecordBatch]:
            automaton, kept, held = shared.value, [], 0
            for whole in batches:
                for batch in text_slices(whole, 0):
                    n, row, term, tf = automaton.counts(batch.column(0))
                    m = 25 + (75 * n * documents) // max(1, total)
                    values = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                    doc = batch.column(1).fill_null(0).to_numpy()
                    null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
                    for at, item, points in automaton.scores(row, term, values):
                        some = points > 0
                        kept.append((item[some], points[some], doc[at[some]], null[at[some]]))
                        held += int(some.sum())
                        if held > _CELLS:
                            kept = [tuple(_best(kept, k))]
                            held = len(kept[0][0])
            if kept:
                item, points, doc, null = _best(kept, k)
                columns = [pa.array([named[i] for i in item.tolist()], pa.int64()), pa.array(doc, mask=null), pa.array(points)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        found = cut(rows.mapInArrow(score, "item_id long, doc_id long, score long"))
        shared.unpersist()
        done = found if done is None else done.union(found)
    if done is None:
        done = spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return top_k(done, ["item_id"], order, k, "rank").select("item_id", "rank", "doc_id", "score")
