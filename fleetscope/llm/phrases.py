"""Collocations: phrases of two to four words whose parts seldom occur apart.

Phrases are counted by vertical partitioning of the suffixes. Prefixes of one word and of two words are
counted first; those that are too rare to begin a phrase end the suffixes that run into them. The remaining
suffixes, truncated to four words, are dealt into groups by prefix, so that a group fits a memory budget:
a prefix with too many suffixes for its group is lengthened by a word, then by another. The suffix subtree
of each group is built on its own, from its sorted suffixes, and a phrase's count is the total of the
leaves below its node.

Words are 64-bit hashes of language and word while they are counted; the frequent ones are checked
to be unequal, and another seed is taken if two of them, or one of them and a rare word, are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.shared import cut, text_slices
from fleetscope.llm.shingling import mix
from fleetscope.operators.ordered import FEW_SALTS, join_groups, top_k

#: Words of the longest phrase, and the depth of the subtrees.
DEPTH = 4
LEAST = 30
TOP = 2000
#: Percent of a phrase's occurrences inside one longer phrase from which on it is left out.
INSIDE_PERCENT = 80
#: Suffixes of a group, the memory budget of a subtree: about 48 bytes each. It grows with the input
#: beyond so many groups, as a group's suffixes are sorted by Spark, which spills them.
GROUP_ROWS = 1 << 18
MAX_GROUPS = 1 << 16
#: Bits of the filters that every task gets: as many for each entry, and at most so many. A filter that is
#: too small lets more rows through, whose counts are then found too low.
BITS_EACH, MAX_BITS = 32, 1 << 28
#: Rows that a task counts before they leave it.
_LOCAL_ROWS = 1 << 21
_SLICE_BYTES = 4 << 20
_PIECE = 1 << 21
#: Seeds tried until the frequent words have hashes of their own.
_SEEDS = 8
#: Sub-keys over which the phrases of a language are dealt before its first ones are ranked together.
_RANK_SALTS = 64
# Bytes that end a piece, and bytes that part words.
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PARTS = _BREAKS.copy()
_PARTS[[0x20, 0x09]] = True
_IDS = [f"w{i}" for i in range(1, DEPTH + 1)]
_U = np.uint64


class _Words:
    """Words of Arrow texts: id, row, first byte and end in ``data``, and whether a word goes on in the
    piece of the one before."""

    def __init__(self, texts: pa.Array, salts: np.ndarray, seed: int) -> None:
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, offsets, content = texts.buffers()
        at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.data = np.frombuffer(content, dtype=np.uint8)[at[0] : at[-1]] if content is not None else np.empty(0, np.uint8)
        at = at - at[0]
        self.bounds, found, lo = [], [], 0
        while lo < len(self.data):
            hi = self._edge(at, lo)
            self.bounds.append((lo, hi))
            found.append(self._chunk(at, lo, hi))
            lo = hi
        empty = np.empty(0, np.int64)
        self.start, self.end, broken = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (empty, empty, empty)
        self.row = np.searchsorted(at, self.start, "right") - 1
        self.salts = salts
        self.id = self.ids(seed)
        self.joined = ~broken.astype(bool)
        self.joined[1:] &= self.row[1:] == self.row[:-1]
        self.joined[:1] = False

    def ids(self, seed: int) -> np.ndarray:
        """A hash of language and word, never 0, another one for each seed."""
        base, letters = _hashing(seed)
        hashes = np.empty(len(self.start), dtype=np.uint64)
        for lo, hi in self.bounds:
            first, last = np.searchsorted(self.start, (lo, hi))
            starts, ends = self.start[first:last] - lo, self.end[first:last] - lo
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(letters[self.data[lo:hi]] * _powers(base, hi - lo), out=sums[1:])
            hashes[first:last] = (sums[ends] - sums[starts]) * _powers(pow(base, -1, 1 << 64), hi - lo + 1)[starts] + (ends - starts).astype(np.uint64)
        out = mix(hashes + self.salts[self.row], 31)
        out[out == 0] = 1
        return out

    def _edge(self, at: np.ndarray, lo: int) -> int:
        """End of a chunk from ``lo`` on: no word goes on there."""
        hi = min(len(self.data), lo + _PIECE)
        while lo < hi < len(self.data):
            parts = np.flatnonzero(_PARTS[self.data[lo:hi]])
            inner = at[(at > lo) & (at <= hi)]
            best = max(parts[-1] + 1 + lo if len(parts) else lo, inner[-1] if len(inner) else lo)
            if best > lo:
                return int(best)
            hi = min(len(self.data), hi + _PIECE)  # a word longer than a chunk
        return hi

    def _chunk(self, at: np.ndarray, lo: int, hi: int) -> tuple:
        data = self.data[lo:hi]
        parts = _PARTS[data]
        begins = at[(at >= lo) & (at < hi)] - lo
        before = np.concatenate([[True], parts[:-1]])
        before[begins] = True
        after = np.concatenate([parts[1:], [True]])
        after[begins[begins > 0] - 1] = True
        starts, ends = np.flatnonzero(~parts & before), np.flatnonzero(~parts & after) + 1
        breaks = np.concatenate([[0], np.cumsum(_BREAKS[data])])
        broken = np.ones(len(starts), dtype=bool)
        broken[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
        if len(starts):  # the bytes back to the end of the word before, in an earlier chunk
            back = self.data[max(0, lo - _PIECE) : lo + starts[0]]
            last = np.flatnonzero(~_PARTS[back])
            broken[0] = bool(_BREAKS[back[last[-1] + 1 :]].any()) if len(last) else lo <= _PIECE or self._broken_before(lo + int(starts[0]))
        return starts + lo, ends + lo, broken

    def _broken_before(self, place: int) -> bool:
        """Whether a piece ends between ``place`` and the word before; for very long runs of blanks."""
        while place > 0 and _PARTS[self.data[place - 1]]:
            place -= 1
            if _BREAKS[self.data[place]]:
                return True
        return place == 0

    def text(self, word: int) -> str:
        return bytes(_FOLD[self.data[self.start[word] : self.end[word]]]).decode()


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_known: dict = {}


def _hashing(seed: int) -> tuple[int, np.ndarray]:
    """Base of the polynomial and values of the bytes, A-Z as a-z."""
    if ("seed", seed) not in _known:
        base = int(mix(np.array([seed], dtype=np.uint64), 32)[0]) | 1
        _known["seed", seed] = base, mix(np.arange(256, dtype=np.uint64), 33 + seed)[_FOLD]
    return _known["seed", seed]


def _powers(base: int, length: int) -> np.ndarray:
    held = _known.get(base)
    if held is None or len(held) < length:
        steps = np.full(max(length, _PIECE + 1), _U(base))
        steps[0] = 1
        held = _known[base] = np.multiply.accumulate(steps)
    return held[:length]


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _together(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of several ids, for filters and groups."""
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for column in columns:
        out = mix(out * _U(0x9E3779B97F4A7C15) + column, 34)
    return out


class _Counts:
    """Rows of ids with their counts, equal ones put together; nearly all that a task meets twice are."""

    def __init__(self) -> None:
        self.held: list[tuple] = []
        self.rows = 0

    def add(self, columns: list[np.ndarray], counts: np.ndarray | None = None) -> None:
        self.held.append((*columns, np.ones(len(columns[0]), np.int64) if counts is None else counts))
        self.rows += len(columns[0])

    def merge(self) -> tuple:
        *columns, counts = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.argsort(_together(columns))
        columns, counts = [c[order] for c in columns], counts[order]
        new = np.ones(len(counts), dtype=bool)
        new[1:] = False
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        at = np.flatnonzero(new)
        merged = (*[c[at] for c in columns], np.add.reduceat(counts, at) if len(at) else counts)
        self.held, self.rows = [merged], len(at)
        return merged

    def full(self) -> bool:
        """Whether the rows fill the store even when put together."""
        return self.rows >= _LOCAL_ROWS and len(self.merge()[0]) >= _LOCAL_ROWS // 2

    def take(self) -> tuple | None:
        out = self.merge() if self.held else None
        self.held, self.rows = [], 0
        return out


def _longs(column: np.ndarray) -> pa.Array:
    return pa.array(column.view(np.int64))


def _slices(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[_Words, list[str], np.ndarray]]:
    """Words of slices of rows ``lang, text``, the languages in them, and the language of each row."""
    for whole in batches:
        for batch in text_slices(whole, 1, _SLICE_BYTES):
            coded = batch.column(0).dictionary_encode()
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            salts = np.array([_salt(name) for name in names], dtype=np.uint64)[codes]
            yield _Words(batch.column(1), salts, seed), names, codes


class _Filter:
    """A bit for each hash that may be in a table."""

    def __init__(self, table: DataFrame, columns: list[str], entries: int) -> None:
        bits = 1 << 16
        while bits < min(entries * BITS_EACH, MAX_BITS):
            bits *= 2
        self.mask = _U(bits - 1)

        def read(batches: Iterator[pa.RecordBatch], mask=self.mask) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = np.unique(_together([c.to_numpy().view(np.uint64) for c in batch.columns]) & mask)
                cells, at = np.unique(places >> _U(6), return_index=True)
                marks = np.bitwise_or.reduceat(_U(1) << (places & _U(63)), at) if len(at) else places
                yield pa.RecordBatch.from_arrays([_longs(cells), _longs(marks)], names=["cell", "marks"])

        found = table.select(*columns).mapInArrow(read, "cell long, marks long").groupBy("cell").agg(F.bit_or("marks").alias("marks")).toArrow()
        self.words = np.zeros(bits >> 6, dtype=np.uint64)
        self.words[found["cell"].to_numpy()] = found["marks"].to_numpy().view(np.uint64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        places = hashes & self.mask
        return (self.words[(places >> _U(6)).astype(np.int64)] >> (places & _U(63))) & _U(1) == 1


def _count_words(rows: DataFrame, seed: int, least: int) -> DataFrame:
    """``id, lang, n``: frequent words without ``lang``, and the number of all words of a language without ``id``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = _Counts(), {}

        def out(found: tuple | None, totals: dict) -> pa.RecordBatch:
            ids, n = found if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            names, sums = list(totals), list(totals.values())
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([_longs(ids), pa.nulls(len(names), pa.int64())]),
                    pa.concat_arrays([pa.nulls(len(ids), pa.string()), pa.array(names, pa.string())]),
                    pa.concat_arrays([_longs(n), pa.array(sums, pa.int64())]),
                ],
                names=["id", "lang", "n"],
            )

        for words, names, codes in _slices(batches, seed):
            counts.add([words.id])
            for name, n in zip(names, np.bincount(codes[words.row], minlength=len(names)).tolist(), strict=True):
                totals[name] = totals.get(name, 0) + n
            if counts.full():
                yield out(counts.take(), {})
        yield out(counts.take(), totals)

    found = rows.mapInArrow(scan, "id long, lang string, n long").groupBy("id", "lang").agg(F.sum("n").alias("n"))
    return cut(found.filter((F.col("id").isNull() & (F.col("n") > 0)) | (F.col("n") >= least)))


def _count_pairs(rows: DataFrame, seed: int, least: int, frequent: _Filter) -> DataFrame:
    """``w1, w2, lang, word, n``: pairs of words in a piece with ``n``, and words that may be frequent with their text."""
    held = rows.sparkSession.sparkContext.broadcast(frequent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, spelled = _Counts(), np.empty(0, np.uint64)

        def out(found: tuple) -> pa.RecordBatch:
            none = pa.nulls(len(found[2]), pa.string())
            return pa.RecordBatch.from_arrays([_longs(found[0]), _longs(found[1]), none, none, _longs(found[2])], names=["w1", "w2", "lang", "word", "n"])

        for words, names, codes in _slices(batches, seed):
            ok = held.value.holds(_together([words.id]))
            both = np.flatnonzero(words.joined[1:] & ok[1:] & ok[:-1]) if len(ok) else np.empty(0, np.int64)
            counts.add([words.id[both], words.id[both + 1]])
            # A word with the id of another one differs from it under another seed.
            at = np.flatnonzero(ok)
            known, first = np.unique(_together([words.id[at], words.ids(seed + _SEEDS)[at]]), return_index=True)
            wanted = at[first[~np.isin(known, spelled, assume_unique=True)]]
            if len(spelled) < _LOCAL_ROWS:
                spelled = np.union1d(spelled, known)
            texts = [words.text(word) for word in wanted.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    _longs(words.id[wanted]), pa.nulls(len(wanted), pa.int64()), pa.array([names[c] for c in codes[words.row[wanted]].tolist()], pa.string()),
                    pa.array(texts, pa.string()), pa.nulls(len(wanted), pa.int64()),
                ],
                names=["w1", "w2", "lang", "word", "n"],
            )
            if counts.full():
                yield out(counts.take())
        if found := counts.take():
            yield out(found)

    found = rows.mapInArrow(scan, "w1 long, w2 long, lang string, word string, n long")
    summed = found.groupBy("w1", "w2", "lang", "word").agg(F.sum("n").alias("n"))
    return cut(summed.filter((F.col("n") >= least) | F.col("w2").isNull()))


def _suffixes(rows: DataFrame, seed: int, pairs: _Filter, heavy: np.ndarray, groups: int) -> DataFrame:
    """``part, deep, w1..w4, n``: suffixes of three words or more, as far as their pairs may be frequent, four words
    at most; ``part`` is the group of the prefix, ``deep`` whether the prefix is the whole suffix."""
    held = rows.sparkSession.sparkContext.broadcast((pairs, heavy))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        known, large = held.value

        def out(found: tuple) -> pa.RecordBatch:
            *ids, n = found
            first, second = (np.isin(_together(ids[i : i + 2]), large) for i in (0, 1))
            deep = first & second
            prefix = _together(ids[:2])
            prefix = np.where(first, _together(ids[:3]), prefix)
            prefix = np.where(deep, _together(ids), prefix)
            part = (mix(prefix, 35) % _U(groups)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(part), pa.array(deep), *[_longs(c) for c in ids], _longs(n)], names=["part", "deep", *_IDS, "n"])

        for words, _, _ in _slices(batches, seed):
            ids, size = words.id, len(words.id)
            if size < 3:
                continue
            pair = np.zeros(size + 2, dtype=bool)
            pair[: size - 1] = words.joined[1:] & known.holds(_together([ids[:-1], ids[1:]]))
            at = np.flatnonzero(pair[:size] & pair[1 : size + 1])
            last = np.where(pair[at + 2], ids[np.minimum(at + 3, size - 1)], _U(0))
            counts.add([ids[at], ids[at + 1], ids[at + 2], last])
            if counts.full():
                yield out(counts.take())
        if found := counts.take():
            yield out(found)

    return rows.mapInArrow(scan, "part int, deep boolean, " + ", ".join(f"{c} long" for c in _IDS) + ", n long")


def _subtrees(suffixes: DataFrame, groups: int, least: int) -> DataFrame:
    """``w1..w4, n``: nodes of three and four words that are frequent. A task walks through the sorted suffixes
    of its group; the node that is open at each depth is all it holds."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, tuple] = {}

        def closed(depth: int, nodes: list[np.ndarray], deep: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            # Under a prefix that is longer than the node other groups hold the rest of its leaves.
            keep = (sums >= least) | deep if depth < DEPTH else sums >= least
            columns = [c[keep] for c in nodes] + [np.zeros(int(keep.sum()), np.int64)] * (DEPTH - depth) + [sums[keep]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*_IDS, "n"])

        for batch in batches:
            deep, *ids, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for depth in range(3, DEPTH + 1):
                some = ids[depth - 1] != 0
                columns = [*[c[some] for c in ids[:depth]], deep[some], n[some]]
                if depth in opened:
                    columns = [np.concatenate([[a], b]) for a, b in zip(opened[depth], columns, strict=True)]
                if not len(columns[0]):
                    continue
                new = np.ones(len(columns[0]), dtype=bool)
                new[1:] = False
                for column in columns[:depth]:
                    new[1:] |= column[1:] != column[:-1]
                at = np.flatnonzero(new)
                nodes, sums = [c[at] for c in columns[:-1]], np.add.reduceat(columns[-1], at)
                opened[depth] = (*[c[-1] for c in nodes], sums[-1])
                yield closed(depth, [c[:-1] for c in nodes[:depth]], nodes[depth][:-1], sums[:-1])
        for depth, (*node, deep, total) in opened.items():
            yield closed(depth, [np.array([c]) for c in node], np.array([deep]), np.array([total]))

    dealt = suffixes.repartitionById(groups, F.col("part")).sortWithinPartitions("part", *_IDS)
    nodes = dealt.select("deep", *_IDS, "n").mapInArrow(build, ", ".join(f"{c} long" for c in _IDS) + ", n long")
    return nodes.groupBy(*_IDS).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The phrases of one to four words that occur ``least`` times or more within a language's pieces:
    ``w1..w4, n`` (0 beyond a phrase's end), the words behind the ids, ``id, lang, word``, and the number of all
    words of each language, ``lang, n``; three tables in the shared folder.

    Texts split into pieces at ``. , ; : ! ?`` and line breaks and pieces into words at blanks and tabs; A-Z count as a-z.
    Null and empty texts have no words, a null language is ``und``. Every row counts, repeated ones too.
    """
    if least < 1:
        raise ValueError("least must be at least 1")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    words = _count_words(rows, seed, least)
    frequent = words.filter("id IS NOT NULL").select(F.col("id").alias("w1"), "n")
    pairs = _count_pairs(rows, seed, least, _Filter(frequent, ["w1"], frequent.count()))
    spelled = pairs.filter("w2 IS NULL").select(F.col("w1").alias("id"), "lang", "word")
    spelled = cut(spelled.join(frequent.select(F.col("w1").alias("id")), "id", "left_semi").distinct())
    if spelled.groupBy("id").count().filter("count > 1").limit(1).count():
        if seed + 1 == _SEEDS:
            raise ValueError("frequent words share a hash under every seed")
        return phrase_counts(docs, text, lang, least, seed + 1)
    pairs = pairs.filter("w2 IS NOT NULL").select("w1", "w2", "n")
    size = pairs.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).first()
    budget = max(GROUP_ROWS, -(-(size["n"] or 0) // MAX_GROUPS))
    groups = max(1, -(-2 * (size["n"] or 0) // budget))
    large = pairs.filter(F.col("n") > budget // 8).select("w1", "w2").toArrow()  # of all suffixes, so 4 a group at most
    heavy = _together([large[c].to_numpy().view(np.uint64) for c in ("w1", "w2")])
    nodes = _subtrees(_suffixes(rows, seed, _Filter(pairs, ["w1", "w2"], size["rows"]), heavy, groups), groups, least)
    none = F.lit(0).cast("long")
    shallow = [
        frequent.select("w1", *[none.alias(c) for c in _IDS[1:]], "n"),
        pairs.select("w1", "w2", *[none.alias(c) for c in _IDS[2:]], "n"),
    ]
    return cut(shallow[0].union(shallow[1]).union(nodes)), spelled, words.filter("id IS NULL").select("lang", "n")


def _part(first: int, last: int, names: list[str]) -> list[Column]:
    """Words ``first`` to ``last`` as a phrase of its own."""
    ids = [F.col(c) for c in _IDS[first:last]]
    return [c.alias(name) for c, name in zip(ids + [F.lit(0).cast("long")] * (DEPTH - len(ids)), names, strict=True)]


def _spread(phrases: DataFrame, cuts: list[tuple], kept: list) -> DataFrame:
    """A row per phrase and struct of ``cuts``, (length of the phrases it goes for, struct)."""
    length = sum((F.when(F.col(c) != 0, 1).otherwise(0) for c in _IDS), F.lit(0))
    chosen = F.filter(F.array(*[F.when(length == size, F.struct(*fields)) for size, fields in cuts]), lambda c: c.isNotNull())
    return phrases.select(*kept, F.explode(chosen).alias("cut")).select(*kept, "cut.*")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, inside_percent: int = INSIDE_PERCENT
) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates are phrases of two to four words that occur ``a >= least`` times (see
    :func:`phrase_counts`). A cut after the first k words gives l and r, the counts of the first part and of the
    rest, and the score 2,000,000 a div (l + r); the lowest counts, of equal ones that with the smallest k. A
    candidate inside a longer one that occurs at least ``inside_percent`` percent as often is left out. The rest are
    ranked by score, then a, both descending, then by phrase in the order of its bytes. ``n`` is the number of all
    words of the language. A table without words has no rows.
    """
    counts, spelled, totals = phrase_counts(docs, text, lang, least)
    phrases = counts.filter("w2 <> 0").withColumnRenamed("n", "a")
    whole = F.xxhash64(*_IDS)
    left, right, sub = ([f"{side}{i}" for i in range(DEPTH)] for side in "xys")
    cuts = [(size, [F.lit(k).alias("k"), *_part(0, k, left), *_part(k, size, right)]) for size in range(2, DEPTH + 1) for k in range(1, size)]
    parts = lambda names, out: counts.select(*[F.col(c).alias(n) for c, n in zip(_IDS, names, strict=True)], F.col("n").alias(out))
    cut_up = join_groups(_spread(phrases, cuts, [*_IDS, "a"]), parts(left, "l"), left, whole, FEW_SALTS)
    cut_up = join_groups(cut_up, parts(right, "r"), right, whole, FEW_SALTS)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cut_up.withColumn("score", score).groupBy(*_IDS, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))
    inner = [(size, _part(at, at + own, sub)) for size in range(3, DEPTH + 1) for own in range(2, size) for at in range(size - own + 1)]
    over = _spread(phrases, inner, ["a"]).groupBy(*[F.col(s).alias(c) for s, c in zip(sub, _IDS, strict=True)]).agg(F.max("a").alias("over"))
    kept = scored.join(over, _IDS, "left").filter(F.col("over").isNull() | (wide("over") * 100 < wide("a") * inside_percent))
    named = join_groups(kept, spelled.select(F.col("id").alias("w1"), "lang"), ["w1"], whole, FEW_SALTS)
    named = named.select("lang", *_IDS, "a", "least.score", "least.l", "least.r").withColumn("salt", F.pmod(whole, F.lit(_RANK_SALTS)))
    order = [F.col("score").desc(), F.col("a").desc()]
    # Equal ones at the edge stay until their phrases are known.
    for keys in (["lang", "salt"], ["lang"]):
        named = named.withColumn("place", F.rank().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= top)
    first = cut(named.drop("salt", "place"))
    at = first.select(*_IDS, F.posexplode(F.array(*_IDS)).alias("at", "id")).filter("id <> 0")
    written = join_groups(at, spelled.select("id", "word"), ["id"], whole, FEW_SALTS)
    words = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"])
    texts = written.groupBy(*_IDS).agg(F.concat_ws(" ", words).alias("phrase"))
    ranked = top_k(first.join(texts, _IDS), ["lang"], [*order, F.col("phrase")], top, "rank")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
