"""Byte-level BPE, encoding and decoding; merges of short pieces are found by a scan, of long ones in a segment tree."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from fleetscope.llm.shared import free_name, text_slices

#: Pieces that a task keeps with their ids; a full store is emptied.
CACHED_PIECES = 400_000
#: Longer pieces are not kept.
CACHED_LENGTH = 64
#: Bytes up to which the least pair of a piece is found by a scan. Any number gives the same ids.
SCANNED_BYTES = 128
_NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    return _merge_scanned(piece, ranks) if len(piece) <= SCANNED_BYTES else _merge_tree(piece, ranks)


def _merge_scanned(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """``pairs[i]`` is the rank of ``tokens[i]`` joined with the next one; the first of least rank merges."""
    rank, n = ranks.get, len(piece)
    tokens = [piece[i : i + 1] for i in range(n)]
    pairs = [rank(piece[i : i + 2], _NONE) for i in range(n - 1)]
    while pairs and (least := min(pairs)) != _NONE:
        i = pairs.index(least)
        tokens[i] = token = tokens[i] + tokens.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(token + tokens[i + 1], _NONE)
        if i:
            pairs[i - 1] = rank(tokens[i - 1] + token, _NONE)
    return [ranks[token] for token in tokens]


def _merge_tree(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Leaf ``i`` of the tree holds ``rank * n + i`` of the token at byte ``i`` joined with the next live
    token, so the root is the leftmost pair of least rank; a merge updates the leaves of the merged token,
    of the one before, and of the one that went."""
    n = len(piece)
    token = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(leaf: int, value: int) -> None:
        k = size + leaf
        tree[k] = value
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least

    def pair(i: int) -> int:
        rank = ranks.get(token[i] + token[after[i]]) if after[i] < n else None
        return _NONE if rank is None else rank * n + i

    while tree[1] != _NONE:
        i = tree[1] % n
        gone = after[i]
        token[i] += token[gone]
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        put(gone, _NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[token[i]])
        i = after[i]
    return ids


class Encoder:
    """Splits texts by ``pattern`` and merges every piece apart, as the public encoders do; no special
    tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = CACHED_PIECES) -> None:
        import regex

        self.ranks, self.pieces, self.cached = ranks, regex.compile(pattern).findall, cached
        self.words = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = np.array(merge_piece(piece.encode("utf-8"), self.ranks), dtype="<u4").tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self.known) >= self.cached:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        known, piece = self.known.get, self._piece
        return np.frombuffer(b"".join([known(p) or piece(p) for p in self.pieces(text)]), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.words.__getitem__, ids.tolist()))


def _encoded(batches: Iterator[pa.RecordBatch], column: int, vocabulary: str, pattern: str) -> Iterator[tuple]:
    encoder = Encoder(read_ranks(vocabulary), pattern)
    for whole in batches:
        for batch in text_slices(whole, column):
            yield batch, [encoder.encode(t or "") for t in batch.column(column).to_pylist()], encoder


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with ``out``, the ids of each whole text as ``array<int>``.

    ``vocabulary`` is a file of ranks that every executor can open; ``pattern`` splits texts into pieces
    that merge apart. Null and empty texts give an empty array. A column that has the name of ``out``
    keeps it; the new one gets underscores before its name.
    """
    out = free_name(docs.columns, out)
    at = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, _ in _encoded(batches, at, vocabulary, pattern):
            flat = np.concatenate(ids) if ids else np.empty(0, "<u4")
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    return docs.mapInArrow(add, StructType([*docs.schema.fields]).add(out, ArrayType(IntegerType())))


def decode_ids(rows: DataFrame, vocabulary: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``, the bytes that the array of ids stands for; null ids give null, no ids no
    bytes. An id that the vocabulary lacks, or a null among the ids, ends the job with a KeyError."""
    out = free_name(rows.columns, out)
    at = rows.columns.index(ids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {rank: word for word, rank in read_ranks(vocabulary).items()}
        for batch in batches:
            texts = [None if i is None else b"".join(map(words.__getitem__, i)) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, out])

    return rows.mapInArrow(add, StructType([*rows.schema.fields]).add(out, "binary"))


def token_digests(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256`` (ids as little-endian unsigned 32-bit
    integers) and ``decoded_sha256`` of the bytes decoded from them. Ids live only within a task.
    Nulls as in :func:`encode_texts`; rows with equal ids are separate results."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, encoder in _encoded(batches, 1, vocabulary, pattern):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(encoder.decode(i)).hexdigest() for i in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
