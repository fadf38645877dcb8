"""Token ids as length-delimited binary records with checksums and a separate offset index.

A shard is a run of records, each framed as

    length      8 bytes, little-endian unsigned
    checksum    4 bytes, masked CRC-32C of the length
    payload     ids as little-endian unsigned integers of 2 or 4 bytes
    checksum    4 bytes, masked CRC-32C of the payload

The index of a shard is a file of its own: a JSON line with the id width, then a row of three
little-endian signed 64-bit integers per record: offset, payload length and doc_id, so that a reader may
fetch records in any order.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.shared import cut, open_store, text_slices
from fleetscope.operators.ordered import with_running_sum

#: Words, and parts of words, with their ids in a generation of the store that a worker process keeps.
CACHED_WORDS = 600_000
CACHED_LENGTH = 64
#: Stands for a null doc_id in an index.
NULL_ID = -(1 << 63)
#: Bytes of texts in a shard, about, where there are more than one for each partition of a shuffle.
SHARD_BYTES = 1 << 29
# The vocabulary's own split, for words of printable ASCII and Latin letters without a form of their own
# when lower-cased or composed.
_PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e]+")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017e]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u017e0-9]+")


def _crc_tables() -> np.ndarray:
    """The register of CRC-32C after each byte alone."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_tables()
#: Bytes whose register is looked up by pairs at once, a power of two. Any number from four on gives the same checksums.
_BLOCK = 16


def _advance(crcs: np.ndarray, zeros: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """CRC registers after ``zeros`` more zero bytes: linear in the bits, so two table lookups."""
    if zeros not in known:
        bits = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
        if zeros == 1:
            moved = (bits >> np.uint32(8)) ^ _CRC[bits & np.uint32(255)]
        else:
            half = _advance(bits, zeros // 2)
            moved = _advance(half, zeros // 2)
        tables = np.zeros((2, 1 << 16), dtype=np.uint32)
        for side in range(2):
            for bit in range(16):
                tables[side, (np.arange(1 << 16) >> bit) & 1 == 1] ^= moved[16 * side + bit]
        known[zeros] = tables
    low, high = known[zeros]
    return low[crcs & np.uint32(0xFFFF)] ^ high[crcs >> np.uint32(16)]


def _pairs(known: list[np.ndarray] = []) -> list[np.ndarray]:  # noqa: B006
    """The register after a block of zero bytes but for one pair, for each pair of the block and its values, the first
    byte in the low half of the index."""
    if not known:
        pair = np.arange(1 << 16, dtype=np.uint32)
        last = [_advance(_CRC[pair & np.uint32(255)], 1) ^ _CRC[pair >> np.uint32(8)]]
        while len(last) < _BLOCK // 2:
            last.append(_advance(last[-1], 2))
        known[:] = last[::-1]
    return known


def crc32c(contents: list[bytes]) -> np.ndarray:
    """CRC-32C of each of ``contents``. Those that need as many blocks, four to eight times a power of two or fewer, are
    folded together: the register of each block alone, then of two blocks, four and so on, and the few that are left
    one after another."""
    out = np.zeros(len(contents), dtype=np.uint32)
    sizes = np.array([len(c) for c in contents], dtype=np.int64)
    counts = [-(-n // _BLOCK) for n in sizes.tolist()]
    counts = np.array([-(-n >> (bits := max(0, n.bit_length() - 3))) << bits for n in counts], dtype=np.int64)
    for count in np.unique(counts[counts > 0]).tolist():
        rows = np.flatnonzero(counts == count)
        # Leading zero bytes leave a zero register.
        block = b"".join([contents[r].rjust(count * _BLOCK, b"\0") for r in rows.tolist()])
        pairs = np.frombuffer(block, dtype="<u2").reshape(len(rows), count, _BLOCK // 2)
        registers, step = np.zeros((len(rows), count), dtype=np.uint32), _BLOCK
        for place, table in enumerate(_pairs()):
            registers ^= table[pairs[:, :, place]]
        while registers.shape[1] % 2 == 0:
            registers, step = _advance(registers[:, 0::2], step) ^ registers[:, 1::2], step * 2
        folded = registers[:, 0]
        for column in range(1, registers.shape[1]):
            folded = _advance(folded, step) ^ registers[:, column]
        out[rows] = folded
    start, power = np.full(len(contents), 0xFFFFFFFF, dtype=np.uint32), 1
    while (sizes >= power).any():
        start, power = np.where(sizes & power, _advance(start, power), start), power * 2
    return out ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crcs: np.ndarray) -> np.ndarray:
    """Checksums of checksums are weak; rotating and shifting by a constant avoids them."""
    return ((crcs >> np.uint32(15)) | (crcs << np.uint32(17))) + np.uint32(0xA282EAD8)


def frame(payloads: list[bytes]) -> list[bytes]:
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    checks = [[c.tobytes() for c in masked(crc32c(part))] for part in (lengths, payloads)]
    return [b"".join(parts) for parts in zip(lengths, checks[0], payloads, checks[1], strict=True)]


def unframe(records: list[bytes]) -> list[bytes]:
    """The payloads; ValueError if a length or checksum does not fit."""
    payloads = [r[12:-4] for r in records]
    lengths = [r[:8] for r in records]
    if any(len(r) < 16 or int.from_bytes(n, "little") != len(p) for r, n, p in zip(records, lengths, payloads, strict=True)):
        raise ValueError("a record's length is damaged")
    stored = [b"".join([r[8:12] for r in records]), b"".join([r[-4:] for r in records])]
    for part, check in zip((lengths, payloads), stored, strict=True):
        if (masked(crc32c(part)) != np.frombuffer(check, dtype="<u4")).any():
            raise ValueError("a record's checksum does not fit")
    return payloads


def _runs(table: list[list[int]], limit: int = 1 << 20) -> Iterator[list[list[int]]]:
    """Index rows in runs whose payloads take about ``limit`` bytes."""
    run, held = [], 0
    for entry in table:
        if run and held + entry[1] > limit:
            yield run
            run, held = [], 0
        run.append(entry)
        held += entry[1]
    if run:
        yield run


# The normalizer and pre-tokenizer under which the ids of a text are those of its words.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the others numbered from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


_BYTE_LETTERS = str.maketrans({chr(b): letter for b, letter in _byte_letters().items()})


class _Store(dict):
    """Values kept by :meth:`make`, in two generations: when the younger one is full it becomes the older one, so
    what is asked for again and again stays."""

    def __init__(self) -> None:
        super().__init__()
        self.older: dict = {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class _Parts(_Store):
    """Ids of the parts that the vocabulary's own split makes of words, by the library's merges."""

    def __init__(self, tokenizer, width: int) -> None:
        super().__init__()
        self.merge = tokenizer.model.tokenize
        self.coded = [i.to_bytes(width, "little") for i in range(min(tokenizer.get_vocab_size(), 1 << (8 * width)))]

    def make(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_LETTERS)
        try:
            return b"".join([self.coded[token.id] for token in self.merge(letters)])
        except IndexError:
            raise OverflowError("an id does not fit the width") from None


class _WordIds(_Store):
    """Ids of words in UTF-8."""

    def __init__(self, tokenizer, width: int) -> None:
        super().__init__()
        self.tokenizer, self.width, self.parts = tokenizer, width, _Parts(tokenizer, width)

    def make(self, word: bytes) -> bytes:
        text = word.decode()
        mark = text[-1] if text[-1] in ".,;:!?" else ""
        letters = text[:-1] if mark else text
        if letters.isalpha() and (letters.isascii() or _PLAIN.fullmatch(letters)):
            ids = self.parts[letters.lower()]
            return ids + self.parts[mark] if mark else ids
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join([self.parts[part] for part in _SPLIT.findall(text.lower())])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=f"<u{self.width}").tobytes()


class WordEncoder:
    """``tokenizers`` over whole texts. Where the file's normalizer and pre-tokenizer are those above, blanks
    split words before anything else, so the ids of a text are those of its blank-separated words, which are kept
    once encoded; with any other file texts are encoded whole."""

    def __init__(self, tokenizer: str, width: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(tokenizer), f"<u{width}"
        with open(tokenizer, "rb") as source:
            described = json.load(source)
        special = [token["content"] for token in described.get("added_tokens", [])]
        by_words = (
            described.get("normalizer") == _NORMALIZER and described.get("pre_tokenizer") == _PRE_TOKENIZER
            and described["model"]["type"] == "BPE" and all(s.startswith("<|") and not re.search(r"\s", s) for s in special)
        )
        self.known = _WordIds(self.tokenizer, width) if by_words else None

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts in UTF-8, as integers in little-endian order."""
        if self.known is None:
            return [np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, dtype=self.kind).tobytes() for t in texts]
        return [b"".join(map(self.known.__getitem__, text.split())) for text in texts]


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(tokenizer: str, width: int) -> WordEncoder:
    """The encoder of this process, which keeps its words from task to task."""
    if (tokenizer, width) not in _encoders:
        _encoders.clear()
        _encoders[tokenizer, width] = WordEncoder(tokenizer, width)
    return _encoders[tokenizer, width]


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
    width: int = 2, shards: int | None = None,
) -> DataFrame:
    """Writes the ids of every whole text, ``end_id`` after each, as shards in ascending ``doc_id`` order
    and returns ``shard, file, index, records, ids``: one row per shard, kept in the shared folder.

    Texts are split by ranges of (doc_id, hash of the text), so that equal ids are dealt out too, sorted
    within a range and written by its task under a name of its own; the table lists the file of the
    attempt that counted, so a task that is lost or runs twice leaves no wrong shard. Null and empty
    texts have the end id alone; null ids come first; rows with equal ids keep an order by text. An id
    that does not fit ``width`` bytes (2 or 4) raises OverflowError. An empty table writes no shard.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    last = np.array([end_id], dtype=f"<u{width}").tobytes()
    if shards is None:
        held = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // SHARD_BYTES))
    ordered = rows.withColumn("salt", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "salt").sortWithinPartitions("doc_id", "salt", "text").drop("salt")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, name, sinks = None, uuid.uuid4().hex, []
        records = total = ids = 0
        for whole in batches:
            for batch in text_slices(whole, 1):
                if not batch.num_rows:
                    continue
                if not sinks:
                    encode = encoder(tokenizer, width).encode
                    store, path = open_store(folder)
                    store.create_dir(path, recursive=True)
                    sinks = [store.open_output_stream(f"{path}/{name}.{kind}") for kind in ("records", "index")]
                    sinks[1].write(json.dumps({"width": width}).encode() + b"\n")
                payloads = [coded + last for coded in encode(batch.column(1).cast(pa.binary()).to_pylist())]
                sinks[0].write(b"".join(frame(payloads)))
                sizes = np.array([len(p) for p in payloads], dtype="<i8")
                ends = total + np.cumsum(sizes + 16)
                entries = np.stack([ends - sizes - 16, sizes, batch.column(0).fill_null(NULL_ID).to_numpy()], axis=1)
                sinks[1].write(entries.astype("<i8").tobytes())
                records, total, ids = records + len(payloads), int(ends[-1]), ids + int(sizes.sum()) // width
        for sink in sinks:
            sink.close()
        if sinks:
            yield pa.RecordBatch.from_pydict(
                {"file": [f"{name}.records"], "index": [f"{name}.index"], "records": [records], "ids": [ids]},
                schema=pa.schema([("file", pa.string()), ("index", pa.string()), ("records", pa.int64()), ("ids", pa.int64())]),
            )

    written = ordered.mapInArrow(write, "file string, index string, records long, ids long")
    return cut(written.withColumn("shard", F.spark_partition_id()).select("shard", "file", "index", "records", "ids"))


def read_records(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """The records of the shards in ``shards``, read back by the index: ``doc_id, shard, row, start,
    n_tokens, ids_crc32``.

    ``start`` counts the ids of all records before, ``ids_crc32`` is the unsigned CRC-32 of the ids as
    little-endian unsigned 32-bit integers. Every length and checksum is verified; a damaged record
    raises ValueError.
    """
    blocks = with_running_sum(shards.withColumn("all", F.lit(0)), ["all"], ["shard"], "ids", "through", F.col("shard").cast("long") / 1000)
    placed = blocks.select("shard", "file", "index", (F.col("through") - F.col("ids")).alias("base"))

    names = ["doc_id", "shard", "row", "start", "n_tokens", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        for batch in batches:
            for shard, file, index, base in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with store.open_input_stream(f"{path}/{index}") as source:
                    head, _, body = source.read().partition(b"\n")
                width = json.loads(head)["width"]
                table = np.frombuffer(body, dtype="<i8").reshape(-1, 3).tolist()
                start, row = base, 0
                with store.open_input_file(f"{path}/{file}") as source:
                    for part in _runs(table):
                        records = []
                        for offset, length, _ in part:
                            source.seek(offset)
                            records.append(source.read(length + 16))
                        out = []
                        for (_, _, doc), payload in zip(part, unframe(records), strict=True):
                            ids = np.frombuffer(payload, dtype=f"<u{width}").astype("<u4")
                            out.append((None if doc == NULL_ID else doc, shard, row, start, len(ids), zlib.crc32(ids.tobytes())))
                            start, row = start + len(ids), row + 1
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    dealt = placed.repartition(max(1, min(shards.count(), 1 << 16)), "shard")
    return dealt.mapInArrow(read, "doc_id long, shard int, row long, start long, n_tokens long, ids_crc32 long")
