"""Exact self join of documents on the Jaccard similarity of their word shingles.

Sets meet in tiles: a rare shingle of both, and a size band in which their sizes allow the similarity.
In a tile hashed bitmaps, as wide as the set is large, bound the overlap from above; what is left is
decided by exact intersection of the sorted sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetscope.llm.components import components
from fleetscope.llm.shared import cut, text_slices
from fleetscope.llm.shingling import mix, shingle_sets, words_of
from fleetscope.operators.ordered import join_groups

#: Similarity from which two documents link, in hundredths.
SIMILARITY_PERCENT = 75
#: Shingles counted together in a task, and uses among them from which one is reported as frequent.
_COUNTED, _FREQUENT = 1 << 21, 8
#: Frequent shingles that are sent to every executor. They only order a set's shingles; any order gives
#: the same links.
FREQUENT_SHINGLES = 500_000
#: Nodes whose ids are sent to every task to pick their documents; more are matched by a shuffle join.
BROADCAST_NODES = 2_000_000
#: Turns in which each component is linked to likely other ones before all that still differ meet. They
#: only save comparisons within a component; any number gives the same links.
TURNS = 3


def _key(shingles: np.ndarray) -> int:
    """One hash of a whole set. Sets are taken as equal when key and size are."""
    return int(mix(shingles, 11).sum(dtype=np.uint64).astype(np.int64)) if len(shingles) else 0


def _sets(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for batch in text_slices(whole, column):
            yield batch, list(shingle_sets(words_of(batch.column(column))))


def _survey(rows: DataFrame) -> DataFrame:
    """``doc_id, n, k, bits`` of every row, and ``shingle, uses`` of shingles that many sets of a task
    have."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = rows_type
        buffer: list[np.ndarray] = []
        held, seen = 0, set()

        def frequent() -> pa.RecordBatch:
            values, uses = np.unique(np.concatenate(buffer), return_counts=True)
            often = uses >= _FREQUENT
            values, uses = values[often].view(np.int64), uses[often].astype(np.int64)
            empty = pa.nulls(len(values), pa.int64())
            none = [pa.nulls(len(values), kind), empty, empty, pa.nulls(len(values), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(values), pa.array(uses)], names=names)

        for batch, sets in _sets(batches, 1):
            kind = batch.schema.field(0).type
            keys = [_key(s) for s in sets]
            for key, shingles in zip(keys, sets, strict=True):
                if (key, len(shingles)) not in seen:
                    seen.add((key, len(shingles)))
                    buffer.append(shingles)
                    held += len(shingles)
            empty = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()),
                    pa.array([_bitmap(s) for s in sets], pa.binary()), empty, empty,
                ],
                names=names,
            )
            if held >= _COUNTED:
                yield frequent()
                buffer, held = [], 0
        if held:
            yield frequent()

    rows_type, names = None, ["doc_id", "n", "k", "bits", "shingle", "uses"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(survey, f"doc_id {kind}, n long, k long, bits binary, shingle long, uses long")


def _frequent(survey: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, sorted, with the power of two of their uses: whole powers, the highest
    first, as far as ``most`` goes."""
    totals = cut(
        survey.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.floor(F.log2(F.sum("uses"))).cast("int").alias("level"))
    )
    least, room = 64, most
    for row in totals.groupBy("level").count().orderBy(F.desc("level")).collect():
        room -= row["count"]
        if room < 0:
            break
        least = row.level
    found = totals.filter(F.col("level") >= least).select("shingle", "level").toArrow()
    values = found.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], found.column("level").to_numpy().astype(np.uint8)[order]


def _postings(rows: DataFrame, values: np.ndarray, levels: np.ndarray, percent: int) -> DataFrame:
    """``token, k, n, place``: of each distinct set of a task, the shingles of which another set that is similar
    enough must share one. With ``n`` shingles these are the first ``n - ceil(percent n) + 1`` in an
    order that all sets follow: rarer ones first, then by hash; ``place`` counts from 0."""
    shared = rows.sparkSession.sparkContext.broadcast((values, levels))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, level = shared.value
        near = np.zeros(1 << 20, dtype=bool)
        near[(common & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        seen: set[tuple[int, int]] = set()
        for _, sets in _sets(batches, 1):
            fresh, keys = [], []
            for shingles in sets:
                key = (_key(shingles), len(shingles))
                if len(shingles) and key not in seen:
                    seen.add(key)
                    fresh.append(shingles)
                    keys.append(key)
            if not fresh:
                continue
            tokens = []
            for shingles in fresh:
                count = len(shingles)
                prefix = count - -(-percent * count // 100) + 1
                maybe = np.flatnonzero(near[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)]) if len(common) else ()
                if len(maybe):
                    rank = np.zeros(count, dtype=np.uint8)
                    at = np.minimum(np.searchsorted(common, shingles[maybe]), len(common) - 1)
                    rank[maybe] = np.where(common[at] == shingles[maybe], level[at], 0)
                    shingles = shingles[np.argsort(rank, kind="stable")]
                tokens.append(shingles[:prefix])
            sizes = [len(t) for t in tokens]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(tokens).view(np.int64)),
                    pa.array(np.repeat(np.array([k for k, _ in keys], dtype=np.int64), sizes)),
                    pa.array(np.repeat(np.array([n for _, n in keys], dtype=np.int32), sizes)),
                    pa.array(np.concatenate([np.arange(size, dtype=np.int32) for size in sizes])),
                ],
                names=["token", "k", "n", "place"],
            )

    return rows.mapInArrow(post, "token long, k long, n int, place int")


def _bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle in a map of 64 bits or the power of two that is not below the set's size."""
    width = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    bits = np.zeros(width, dtype=bool)
    bits[(mix(shingles, 13) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(a: bytes, b: bytes, sizes: int) -> int:
    """The most shingles that two sets of together ``sizes`` can share: each differing bit is a shingle
    of one set alone. The wider map is folded onto the narrower one."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    return (sizes - int(np.bitwise_count(x ^ y).sum())) // 2


def _exact(rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``a, b, near``: whether the sets are similar enough, by intersection of the sorted sets. Only the sets
    of these nodes are made; their ids go to every task if there are at most :data:`BROADCAST_NODES`."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(near, pa.bool_())], names=["a", "b", "near"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    pairs = cut(pairs)
    nodes = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    few = nodes.count() <= BROADCAST_NODES
    wanted = rows.join(F.broadcast(nodes) if few else nodes, "doc_id", "left_semi")
    sets = cut(wanted.select("doc_id", "text").mapInArrow(build, f"node {kind}, shingles binary"))
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"shingles_{name}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "shingles_a", "shingles_b")
    return full.mapInArrow(compare, f"a {kind}, b {kind}, near boolean")


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` with ``bound``, the most their similarity can be as their bitmaps show it, without those
    that cannot be similar enough."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, bounds = [], []
            for n, m, x, y in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                most = min(overlap_bound(x, y, n + m), n, m)
                near.append(100 * most >= percent * (n + m - most))
                bounds.append(most / (n + m - most))
            columns = [*batch.columns[4:], pa.array(bounds, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[4:], "bound"]).filter(pa.array(near, pa.bool_()))

    side = lambda name: classes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))
    mapped = pairs.join(side("a"), "a").join(side("b"), "b")
    return mapped.select("n_a", "n_b", "bits_a", "bits_b", *pairs.columns).mapInArrow(bound, StructType([*pairs.schema.fields]).add("bound", "double"))


def linked_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = SIMILARITY_PERCENT
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    A document's set are the distinct runs of five words of its whole text, A-Z lower-cased; with fewer
    words the whole sequence is its one shingle. Two documents link when 100 * intersection is at least
    ``percent`` * union; ``component_id`` is the smallest doc_id that links lead to, its own included.
    Documents without words (null and empty texts too) have an empty set and link with nothing.

    Equal sets are one node from the start. In a few turns each component is linked to likely
    others in its tiles; then only nodes of different components have to meet, so a group of near
    copies is not compared pair by pair, and no link between components is missed. A row with a null doc_id links through an equal set
    only. Rows that share a doc_id count as one document. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    survey = cut(_survey(rows))
    own = survey.filter("k IS NOT NULL").select("doc_id", "n", "k", "bits")
    least = F.min(F.struct("doc_id", "bits"))
    classes = own.filter("n > 0 AND doc_id IS NOT NULL").groupBy("k", "n").agg(least.alias("least"))
    classes = cut(classes.select("k", "n", F.col("least.doc_id").alias("node"), "least.bits"))
    tiles = _shared_tokens(_postings(rows, *_frequent(survey, FREQUENT_SHINGLES), percent), classes)
    components_of = _link(rows, tiles, classes, percent)
    own = own.drop("bits")
    placed = join_groups(own, classes.drop("bits"), ["k", "n"], F.col("doc_id"))
    found = placed.join(components_of, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id")
    )
    alone = own.join(classes.select("k", "n"), ["k", "n"], "left_anti")
    return found.union(alone.select("doc_id", "n", F.col("doc_id")))


def _shared_tokens(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """``token, node, n, place`` where another set has the token too; one row per token and set."""
    order = Window.partitionBy("token").orderBy("n", "k")
    at = F.struct("n", "k")
    near = postings.select("token", "n", "k", "place", F.lag(at).over(order).alias("before"), F.lead(at).over(order).alias("after"))
    known = F.coalesce(F.col("before") == at, F.lit(False))
    shared = near.filter(~known & (F.col("before").isNotNull() | F.col("after").isNotNull())).select("token", "n", "k", "place")
    return cut(shared.join(classes.drop("bits"), ["k", "n"]).select("token", "node", "n", "place"))


def _reachable(m, n, i, j, percent: int):
    """Whether sets of ``m`` and ``n`` shingles whose first common one is at the places ``i`` and ``j`` can
    be similar enough: all common ones come after it in both. A similar pair's first common shingle
    passes, so no pair is lost by asking this of each."""
    return (100 + percent) * F.least(m - i, n - j) >= percent * (m + n)


def _label(tiles: DataFrame, edges: DataFrame | None) -> DataFrame:
    """``tiles`` with ``label``, the component that ``edges`` put the node in."""
    if edges is None:
        return tiles.withColumn("label", F.col("node"))
    labels = components(edges, "a", "b")
    return tiles.join(labels, "node", "left").select(*tiles.columns, F.coalesce("component", "node").alias("label"))


def _open_tiles(labelled: DataFrame, turn: int) -> DataFrame:
    """Rows of tiles in which several components meet, each with the rows ``near`` it: a hub of its
    tile, which is of the component with the least name, and, two before and one after: in order of size in
    the first turn, by a hash that changes with the turn later."""
    tile = Window.partitionBy("token")
    hashed = F.xxhash64("node", F.lit(turn))
    order = tile.orderBy("n", "node") if turn == 0 else tile.orderBy(hashed, "node")
    row = F.struct("node", "n", "place", "label")
    spread = labelled.select(
        "*",
        F.min("label").over(tile).alias("least"),
        F.max("label").over(tile).alias("most"),
        F.min(F.struct("label", hashed.alias("hash"), row.alias("row"))).over(tile).alias("hub"),
        F.array(F.lag(row).over(order), F.lag(row, 2).over(order), F.lead(row).over(order)).alias("near"),
    )
    return spread.filter("least <> most").select(*labelled.columns, F.filter(F.array_distinct(F.concat(F.array("hub.row"), "near")), lambda other: other.label != F.col("label")).alias("near"))


def _likely(opened: DataFrame, classes: DataFrame, tested: DataFrame | None, percent: int) -> DataFrame:
    """``a, b``: untested pairs with a hub or a row near that can be similar enough; in the first turn, when
    each node is a component, for each only the one with the largest bound of its similarity."""
    met = opened.select("node", "n", "place", "label", F.explode("near").alias("other")).filter(
        _reachable(F.col("other.n"), F.col("n"), F.col("other.place"), F.col("place"), percent)
    )
    pairs = met.select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b"), "label").distinct()
    if tested is not None:
        pairs = pairs.drop("label").distinct().join(tested, ["a", "b"], "left_anti")
        return _bounded(pairs, classes, percent).select("a", "b")
    best = _bounded(pairs, classes, percent).groupBy("label").agg(F.max(F.struct("bound", "a", "b")).alias("best"))
    return best.select("best.a", "best.b").distinct()


def _link(rows: DataFrame, tiles: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    edges = tested = None
    opened = cut(_open_tiles(_label(tiles, None), 0))
    for turn in range(1, TURNS + 1):
        judged = cut(_exact(rows, _likely(opened, classes, tested, percent), percent))
        tested = judged.select("a", "b") if tested is None else tested.union(judged.select("a", "b"))
        linked = judged.filter("near").select("a", "b")
        edges = linked if edges is None else edges.union(linked)
        if linked.isEmpty():
            break
        opened = cut(_open_tiles(_label(opened.select(*tiles.columns), edges), turn))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + F.lit(1e-9))
    x = opened.select("token", F.explode(F.array(band, band + 1)).alias("band"), F.col("node").alias("a"), F.col("n").alias("m"), F.col("place").alias("i"), F.col("label").alias("p"))
    y = opened.select("token", band.alias("band"), F.col("node").alias("b"), "n", F.col("place").alias("j"), F.col("label").alias("q"))
    smaller = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("a") < F.col("b")))
    reachable = _reachable(F.col("m"), F.col("n"), F.col("i"), F.col("j"), percent)
    meet = x.join(y, ["token", "band"]).filter(smaller & (F.col("p") != F.col("q")) & reachable)
    pairs = meet.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    last = _exact(rows, _bounded(pairs, classes, percent).select("a", "b"), percent)
    return components(edges.union(last.filter("near").select("a", "b")), "a", "b")
