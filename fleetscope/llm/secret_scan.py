"""Secrets in texts: fixed patterns, and random strings told by how badly a vocabulary compresses them."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.shared import text_slices

# The base patterns and the shortest match of each that counts.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
KINDS = {"assign": 0, "access": 1, "hex": 2, "random": 3}

#: Runs of an alphabet that keys are written in, and the parts of a run between the marks that also join words.
RUN, PART = re.compile(r"[A-Za-z0-9+/_=-]+"), re.compile(r"[A-Za-z0-9+]+")
#: The shortest string that may be random, and the shortest that needs no digit beside its letters.
LEAST_LENGTH, PLAIN_LENGTH = 10, 16
#: Digests and identifiers that are no secrets: MD5, SHA-1, SHA-2 digests, integrity digests in base64, UUIDs, ULIDs, plain
#: numbers. Words, also with marks between them, are told by their characters per token alone.
KNOWN = re.compile(
    r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|(?:sha1|md5)-[A-Za-z0-9+/]{22,27}={0,2}|sha(?:256-[A-Za-z0-9+/]{43}|384-[A-Za-z0-9+/]{64}|512-[A-Za-z0-9+/]{86})={0,2}"
    r"|[0-7][0-9A-HJKMNP-TV-Z]{25}"
    r"|[0-9+/_=-]+"
)
#: What stands before embedded data and module checksums.
KNOWN_BEFORE = ("base64,", "h1:")
#: A candidate with fewer characters per token is taken as random; a short one needs still fewer.
MAX_CHARS_PER_TOKEN, MAX_SHORT_CHARS_PER_TOKEN = 2.0, 1.7
#: Characters that go to the vocabulary at once.
_PIECE = 4096


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base patterns, leftmost and without overlap within a kind."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _random(word: str, tokens, limit: float, least: int) -> bool:
    """Whether the vocabulary needs so many tokens for a string that it is taken as random."""
    if len(word) < least or KNOWN.fullmatch(word):
        return False
    if len(word) < PLAIN_LENGTH:
        if word.isalpha() or not re.search("[0-9]", word) or not re.search("[A-Za-z]", word):
            return False
        limit = min(limit, MAX_SHORT_CHARS_PER_TOKEN)
    return len(word) < limit * sum(len(tokens(word[at : at + _PIECE])) for at in range(0, len(word), _PIECE))


def random_spans(
    text: str, taken: list[tuple[int, int, str]], tokens, limit: float = MAX_CHARS_PER_TOKEN, least: int = LEAST_LENGTH
) -> list[tuple[int, int, str]]:
    """Spans of random strings outside the spans already ``taken``. ``tokens``: string -> ids.

    A run is tested whole; one that is not random is tested by its parts, as words around a key raise the
    characters per token. Runs and taken spans, put together where they overlap, are walked through once.
    """
    spans, at, ordered = [], 0, []
    for start, end, _ in sorted(taken):
        if ordered and start < ordered[-1][1]:
            ordered[-1][1] = max(ordered[-1][1], end)
        else:
            ordered.append([start, end])
    for m in RUN.finditer(text):
        start, end = m.span()
        if end - start < least or KNOWN.fullmatch(m.group()) or text.endswith(KNOWN_BEFORE, max(0, start - 8), start):
            continue
        while at < len(ordered) and ordered[at][1] <= start:
            at += 1
        near = []
        while at + len(near) < len(ordered) and ordered[at + len(near)][0] < end:
            near.append(ordered[at + len(near)])
        free = lambda lo, hi, near=near: not any(a < hi and lo < b for a, b in near)
        if free(start, end) and _random(m.group(), tokens, limit, least):
            spans.append((start, end, "random"))
            continue
        for part in PART.finditer(m.group()):
            lo, hi = start + part.start(), start + part.end()
            if hi - lo < end - start and free(lo, hi) and _random(part.group(), tokens, limit, least):
                spans.append((lo, hi, "random"))
    return spans


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS[s[2]], s[1])))


def find_secrets(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    max_chars_per_token: float = MAX_CHARS_PER_TOKEN,
    min_length: int = LEAST_LENGTH,
) -> DataFrame:
    """One row per document: ``doc_id``, ``base`` and ``added``, arrays of ``struct<start, end, kind>`` in
    code points with the end exclusive, and ``spans``, both in one string by start, then kind.

    The base patterns are assignments, access keys and long hex strings. The method adds strings of
    characters that the vocabulary in the file ``vocabulary`` (tiktoken ranks; ``pattern`` splits
    before the merges) needs a token for every one or two characters for, unless they look like a known
    digest, UUID, ULID or number, are embedded data, or overlap a base span. Strings of ``min_length`` to 15
    characters count where they have letters and digits and still fewer characters per token.

    Null and empty texts have no spans. Rows with equal ids are separate results; a null id stays null.
    Texts are read whole, one at a time.
    """
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        tokens = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        as_structs = lambda spans: [{"start": s, "end": e, "kind": k} for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS[x[2]]))]
        for whole in batches:
            for batch in text_slices(whole, 1):
                base, added, listed = [], [], []
                for content in batch.column(1).to_pylist():
                    first = base_spans(content) if content else []
                    more = random_spans(content, first, tokens, max_chars_per_token, min_length) if content else []
                    base.append(as_structs(first))
                    added.append(as_structs(more))
                    listed.append(_listed(first + more))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(base, pa.list_(struct)), pa.array(added, pa.list_(struct)), pa.array(listed, pa.string())],
                    names=["doc_id", "base", "added", "spans"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    spans = "array<struct<start:int,end:int,kind:string>>"
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base {spans}, added {spans}, spans string")


def digest_column(spans: str):
    """Lowercase SHA-256 of ``kind:start:end`` of an array of spans, comma-joined."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.sha2(F.array_join(parts, ","), 256)


def base_digest(text: str) -> str:
    return hashlib.sha256(_listed(base_spans(text)).encode()).hexdigest()
