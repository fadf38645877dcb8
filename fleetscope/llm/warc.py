"""WARC archives: one gzip member per record, written by tasks, read back by byte ranges.

The reader cuts every archive into byte ranges, one task's work each. A task looks for the gzip magic from
the start of its range on, takes a place for a record only if the member decodes to a WARC header and ends
with a fitting checksum, and owns the records that start inside its range, wherever they end.

A payload may itself be an archive, whose members then stand inside another member's bytes. The reader
therefore goes over the ranges twice: first for the end of what each range owns, whose running maximum is
where the next range's own records can begin, then for the records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetscope.llm.shared import cut, open_store, text_slices
from fleetscope.operators.ordered import join_groups

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of an archive that one row of the reader covers.
SPLIT_BYTES = 32 << 20
#: Bytes read from a store at once.
CHUNK_BYTES = 1 << 20
#: Bytes within which the header of a record has to end.
HEADER_BYTES = 1 << 20
#: Groups of equal payloads whose keys are sent to every task, about 100 bytes each; beyond, rows are
#: joined with their group over salted keys.
BROADCAST_GROUPS = 200_000
#: Written as the date of every record unless one is given, so that equal input makes equal archives.
DATE = "2020-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    """A header value: line breaks would end it."""
    return " ".join(value.split())


def record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE
) -> bytes:
    """One record, not yet compressed. A revisit keeps the HTTP header of the response and leaves out the payload."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    named = "" if page_id is None else str(page_id)
    identity = uuid.uuid5(uuid.NAMESPACE_URL, f"{named} {url} {digest} {revisit}")
    lines = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{identity}>",
        "WARC-Date": date,
        "WARC-Target-URI": _one_line(url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{payload_digest(block)}",
        "Page-ID": named,
    }
    if revisit:
        lines |= {"WARC-Profile": REVISIT_PROFILE, "Refers-To-Page-ID": str(refers_to)}
    lines |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = b"".join(f"{name}: {value}\r\n".encode() for name, value in lines.items())
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _member(content: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header, names in lower case, and block of a decoded record; ValueError where it is none."""
    head, blank, rest = content.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or not lines[0].startswith(b"WARC/1."):
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line without a name")
        fields[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not size.isdigit() or rest[int(size) :] != b"\r\n\r\n":
        raise ValueError("the block's length does not fit")
    return fields, rest[: int(size)]


class _Archive:
    """Buffered bytes of a file, read on from any place."""

    def __init__(self, source, length: int) -> None:
        self.source, self.length, self.at, self.held = source, length, 0, b""

    def chunk(self, offset: int) -> bytes:
        """Some bytes from ``offset`` on, empty at the end."""
        if not self.at <= offset < self.at + len(self.held):
            self.at, self.held = offset, self.source.read_at(max(0, min(CHUNK_BYTES, self.length - offset)), offset)
        return self.held[offset - self.at :]

    def find(self, offset: int, end: int) -> int | None:
        """The first place from ``offset`` on, before ``end``, where the magic stands."""
        while offset < end:
            held = self.chunk(offset)
            place = held.find(MAGIC)
            if place >= 0:
                return offset + place if offset + place < end else None
            if offset + len(held) >= self.length:
                return None
            if len(held) < len(MAGIC):  # the magic may go on in the next chunk
                self.at, self.held = offset, self.source.read_at(min(CHUNK_BYTES, self.length - offset), offset)
            else:
                offset += len(held) - len(MAGIC) + 1
        return None

    def member(self, offset: int) -> tuple[bytes, int] | None:
        """The decoded member at ``offset`` and its end, or None where there is no whole member with a
        WARC header; the header is decoded first, the rest only if it is one."""
        unpacker, parts, size, place = zlib.decompressobj(31), [], 0, offset
        headed = False
        try:
            while not unpacker.eof:
                held = self.chunk(place)
                if not held:
                    return None
                place += len(held)
                while held and not unpacker.eof:
                    out = unpacker.decompress(held, 0 if headed else HEADER_BYTES)
                    parts.append(out)
                    size += len(out)
                    if not headed:
                        first = b"".join(parts)
                        if not b"WARC/1.".startswith(first[:7]):
                            return None
                        headed = b"\r\n\r\n" in first
                        if size > HEADER_BYTES and not headed:
                            return None
                    held = unpacker.unconsumed_tail
        except zlib.error:
            return None
        return b"".join(parts), place - len(unpacker.unused_data)


def _owned(archive: _Archive, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, end, header and block of the records that start in ``start`` to ``end``."""
    at = archive.find(start, end)
    while at is not None:
        found = archive.member(at)
        after = at + 1
        if found:
            try:
                fields, block = parse(found[0])
            except ValueError:
                fields = None
            if fields is not None:
                after = found[1]
                yield at, after, fields, block
        at = archive.find(after, end)


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0
) -> DataFrame:
    """Writes a record per row into ``folder``, an archive per task, and returns ``path, length, records``:
    a row per archive, kept in the shared folder. It lists the archive of the attempt that counted, so a
    task that is lost or runs twice adds no records.

    The payload is the text in UTF-8; null is empty. Of rows with equal payloads (equal length and SHA-256) of at
    least ``min_bytes`` bytes those with the largest id are responses, the others revisit them without the
    payload; rows that share the largest id are all responses. A null id is the smallest. Null addresses are
    written empty, line breaks in them as spaces. Other columns are ignored; an empty table makes no archive.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("key", F.when(F.octet_length("payload") >= min_bytes, F.concat_ws(":", F.sha2("payload", 256), F.octet_length("payload"))))
    counted = rows.filter("key IS NOT NULL").groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    groups = cut(counted.filter("n > 1 AND refers_to IS NOT NULL").drop("n"))
    if groups.count() <= BROADCAST_GROUPS:
        named = rows.join(F.broadcast(groups), "key", "left")
    else:
        named = join_groups(rows, groups, ["key"], F.col("page_id"), how="left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    dealt = named.select("page_id", "url", "payload", "refers_to", revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, path, total, count = None, f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz", 0, 0
        for whole in batches:
            for batch in text_slices(whole, 2):
                if sink is None and batch.num_rows:
                    store, place = open_store(path)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(place, compression=None)
                payloads = batch.column(2).cast(pa.binary()).to_pylist()
                others = [batch.column(i).to_pylist() for i in (0, 1, 3, 4)]
                for page, address, target, again, payload in zip(*others, payloads, strict=True):
                    member = _member(record(page, address, payload, target, again))
                    sink.write(member)
                    total, count = total + len(member), count + 1
        if sink is None:
            return
        sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([total]), pa.array([count])], names=["path", "length", "records"])

    return cut(dealt.mapInArrow(write, "path string, length long, records long"))


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of the archives below ``folder``; nothing but the listing is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select("path", "length")


_META = "path string, part int, offset long, end long, warc_type string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string"


def _integer(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


def _row(path: str, part: int, offset: int, end: int, fields: dict[str, str], block: bytes) -> tuple:
    """A record's row; ValueError if its payload does not fit the digest that it carries."""
    kind, digest = fields.get("warc-type", ""), fields.get("warc-payload-digest", "")
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    stored = digest[5:] if digest[:5].lower() == "sha1:" else None
    if kind == "revisit":
        sizes = [int(line[15:]) for line in http.split(b"\r\n") if line[:15].lower() == b"content-length:" and line[15:].strip().isdigit()]
        size, payload = sizes[0] if sizes else None, None
    else:
        size, computed = len(payload), payload_digest(payload)
        if kind == "response" and stored not in (None, computed):
            raise ValueError(f"payload of the record at {offset} of {path} does not fit its digest")
        stored = computed
    return (
        path, part, offset, end, kind, _integer(fields.get("page-id")), fields.get("warc-target-uri"),
        _integer(fields.get("refers-to-page-id")), size, stored, payload,
    )


def _ranges(archives: DataFrame, split_bytes: int) -> DataFrame:
    """``path, length, part, start, stop``: byte ranges of the archives."""
    parts = F.sequence(F.lit(0), F.ceil(F.col("length") / split_bytes).cast("int") - 1)
    spread = archives.filter("length > 0").select("path", "length", F.explode(parts).alias("part"))
    start = F.col("part").cast("long") * split_bytes
    return spread.select("path", "length", "part", start.alias("start"), F.least(start + split_bytes, "length").alias("stop"))


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of ``archives`` (``path, length``; see :func:`list_archives`): ``path, part, offset, end,
    warc_type, page_id, url, refers_to, payload_bytes, payload_digest`` and the ``payload``.

    Archives are gzip members, a record in each, as any number of byte ranges. What stands between members
    and is no record is passed over, a record cut off at the end of its archive too. A response's digest is
    computed from its payload and compared with the one it carries (ValueError otherwise); a revisit has no
    payload, its length and digest are those it carries.
    """
    ranges = _ranges(archives, split_bytes)
    count = max(1, min(ranges.count(), 1 << 16))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, part, start, stop in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                store, place = open_store(path)
                with store.open_input_file(place) as source:
                    last = max((end for _, end, _, _ in _owned(_Archive(source, length), start, stop)), default=0)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([part], pa.int32()), pa.array([last])], names=["path", "part", "reach"])

    ends = cut(ranges.repartition(count, "path", "part").mapInArrow(reach, "path string, part int, reach long"))
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    floors = ends.select("path", "part", F.coalesce(F.max("reach").over(before), F.lit(0)).alias("floor"))
    begun = ranges.join(floors, ["path", "part"]).withColumn("start", F.greatest("start", "floor")).filter("start < stop")
    schema = _META + (", payload binary" if payloads else "")
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [field.strip().split(" ")[0] for field in (_META + ", payload binary").split(",")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        width = len(names) if payloads else len(names) - 1
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(zip(*rows, strict=True), kinds, strict=True))[:width]], names=names[:width])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, part, start, stop in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                store, place = open_store(path)
                rows, held = [], 0
                with store.open_input_file(place) as source:
                    for offset, end, fields, block in _owned(_Archive(source, length), start, stop):
                        rows.append(_row(path, part, offset, end, fields, block))
                        held += len(block)
                        if held >= CHUNK_BYTES or len(rows) >= 10_000:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return begun.select("path", "length", "part", "start", "stop").repartition(count, "path", "part").mapInArrow(read, schema)

