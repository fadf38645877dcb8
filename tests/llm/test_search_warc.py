"""Ranked search and archives against brute force, on small tables with nulls, ties, repeated rows, long texts
and clashing columns."""

from __future__ import annotations

import collections
import gzip
import hashlib
import math
import random
import re
import zlib
from base64 import b32encode

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetscope.llm import lexical_search, warc

ODD = [None, "", " \n\t", "one", "One two THREE four", "Straße café\x0bnaïve 漢字 🙂", "a" * 3000, "one " * 4000, "one-two\x00one"]


# --- 11 ranked search ----------------------------------------------------------------------------


def ranked(docs, items, k):
    """The contract, document by document."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    found = [(d, collections.Counter(terms(t))) for d, t in docs]
    count, total = sum(1 for _, c in found if c), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(term for _, c in found for term in c)
    asked = collections.defaultdict(list)
    for item, text in items:
        asked[item] += terms(text)
    out = []
    for item, own in asked.items():
        scored = []
        for d, c in found:
            m = 100 - 75 + (75 * sum(c.values()) * count) // max(1, total)
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "cells"), [(lexical_search.BLOCK_BYTES, lexical_search._CELLS), (1, 7)])
def test_ranked_search(spark, frame, monkeypatch, block, cells):
    monkeypatch.setattr(lexical_search, "_CELLS", cells)  # how many scores a task keeps before it cuts them
    rng = random.Random(11)
    words = ["one", "two", "ONE", "é", "three", "x1", "漢字", "four", "the", "then", "he"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", ".\n", "  ", "'"]) for _ in range(n))
    docs = [*enumerate(ODD), *[(20 + i, text(rng.randrange(1, 60))) for i in range(120)]]
    docs += [(200 + i, docs[30][1]) for i in range(30)] + [docs[40], (docs[41][0], "the other"), (None, docs[42][1]), (None, None)]
    items = [(1, "one two two"), (2, None), (3, ""), (4, "absent"), (5, text(30)), (5, "the the then"), (6, "he"), (7, "é 漢字"), (None, "four"), (9, text(9)), (9, None)]
    got = lexical_search.ranked_documents(
        frame(docs).withColumn("rank", F.lit("x")).withColumn("term", F.lit("x")),
        spark.createDataFrame([(*i, "x", "x") for i in items], "item_id long, text string, item string, doc_id string"), block_bytes=block,
    )
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, items, 10)


@pytest.mark.parametrize("cells", [1, 5, 1 << 20])
def test_automaton(monkeypatch, cells):
    monkeypatch.setattr(lexical_search, "_CELLS", cells)
    rng = random.Random(3)
    words = [b"he", b"the", b"then", b"x", "é".encode()]
    items = [[rng.choice(words) for _ in range(rng.randrange(6))] for _ in range(9)]
    texts = [None, "", "the", "he the then THE x-he", "é", *[" ".join(rng.choice(words).decode() for _ in range(rng.randrange(20))) for _ in range(30)]]
    automaton = lexical_search.Automaton(items)
    n, row, term, tf = automaton.counts(pa.array(["skipped", *texts]).slice(1))
    own = [lexical_search.terms_of(t) for t in texts]
    assert n.tolist() == [len(o) for o in own]
    assert {(r, automaton.terms[t]): c for r, t, c in zip(row.tolist(), term.tolist(), tf.tolist(), strict=True)} == {
        (r, t): c for r, o in enumerate(own) for t, c in collections.Counter(o).items() if t in automaton.terms
    }
    got = {}
    for rows, found, points in automaton.scores(row, term, tf):
        for r, i, p in zip(rows.tolist(), found.tolist(), points.tolist(), strict=True):
            assert (r, i) not in got
            got[r, i] = p
    want = {(r, i): sum(o.count(t) for t in item) for r, o in enumerate(own) for i, item in enumerate(items)}
    assert got == {k: v for k, v in want.items() if v}


def test_ranked_search_of_nothing(spark, frame):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical_search.ranked_documents(frame([(1, "one")]).limit(0), items).count() == 0
    assert lexical_search.ranked_documents(frame([(1, "one")]), items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in lexical_search.ranked_documents(frame([(1, "one"), (2, "two")]), items, k=1).collect()] == [(1, 1, 1)]


# --- 13 archives ---------------------------------------------------------------------------------


def archived(pages, least=0):
    """What the archives of ``pages`` (page_id, url, html) hold."""
    payloads = [(p, (h or "").encode()) for p, _, h in pages]
    largest = {}
    for p, content in payloads:
        if p is not None:
            largest[content] = max(p, largest.get(content, p))
    out = []
    for p, content in payloads:
        stays = largest.get(content) if len(content) >= least else None
        again = stays is not None and p != stays
        out.append((p, len(content), b32encode(hashlib.sha1(content).digest()).decode(), "revisit" if again else "response", stays if again else None))
    return sorted(out, key=str)


def pages_of(rng):
    inner = b"".join(warc._member(warc.record(n, "http://inner/", b"<i>" * n, None, False)) for n in range(4)).decode("latin-1")
    pages = [(i, f"http://a.example/{i}\r\nX: y", t) for i, t in enumerate(ODD)]
    pages += [(30 + i, None, "<p>same</p>") for i in range(50)] + [(80, "u", "<p>same</p>"), (80, "u", "<p>same</p>"), (None, "u", "<p>same</p>"), (None, "u", "alone")]
    pages += [(100 + i, "u", inner + "".join(chr(rng.randrange(256)) for _ in range(rng.randrange(900)))) for i in range(20)]
    return pages + [(-7, "u", "\r\n\r\n"), (-8, "u", "WARC/1.1\r\nContent-Length: 0\r\n\r\n")]


@pytest.mark.parametrize("broadcast", [warc.BROADCAST_GROUPS, -1])
@pytest.mark.parametrize("split", [3000, 1 << 25])
def test_archives(spark, tmp_path, monkeypatch, split, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", broadcast)
    pages = pages_of(random.Random(13))
    df = spark.createDataFrame([(*p, "x", "x") for p in pages], "page_id long, url string, html string, key string, refers_to string").repartition(3)
    made = warc.write_archives(df, f"file:{tmp_path}/made")
    got = warc.read_archives(made.select("path", "length"), split)
    fields = ["page_id", "payload_bytes", "payload_digest", "warc_type", "refers_to"]
    assert sorted((tuple(r) for r in got.select(fields).collect()), key=str) == archived(pages)
    listed = warc.read_archives(warc.list_archives(spark, f"file:{tmp_path}/made"), split, payloads=False)
    assert sorted(tuple(r) for r in listed.select("offset", "end", "page_id").fillna(0).collect()) == sorted(
        tuple(r) for r in got.select("offset", "end", "page_id").fillna(0).collect()
    )
    for r in got.filter("warc_type = 'response'").select("payload", "payload_digest", "payload_bytes").collect():
        assert warc.payload_digest(bytes(r.payload)) == r.payload_digest and len(r.payload) == r.payload_bytes
    assert got.filter("warc_type = 'revisit' AND payload IS NOT NULL").count() == 0


def test_archives_least_bytes_and_none(spark, tmp_path):
    pages = pages_of(random.Random(14))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    made = warc.write_archives(df, str(tmp_path / "least"), min_bytes=5)
    got = warc.read_archives(made.select("path", "length"), payloads=False)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "warc_type", "refers_to").collect()), key=str) == archived(pages, 5)
    none = warc.write_archives(df.limit(0), str(tmp_path / "none"))
    assert none.count() == 0 and warc.read_archives(none.select("path", "length")).count() == 0


@pytest.mark.parametrize("split", [97, 1 << 20])
def test_members_inside_members(spark, tmp_path, monkeypatch, split):
    """Stored blocks hold whole members of another archive; rubbish and a torn record stand around."""
    inner = b"".join(warc._member(warc.record(n, "http://inner/", b"<i>" * n, None, False)) for n in range(5))

    def stored(content):
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        return packer.compress(content) + packer.flush()

    members = [stored(warc.record(1, "u", inner, None, False)), warc._member(warc.record(2, "u", b"two", None, False)), b"\x1f\x8b\x08 rubbish \x1f\x8b",
               gzip.compress(b"no record"), stored(warc.record(3, "u", inner + inner, None, False)), warc._member(warc.record(4, "u", b"", None, False))]
    content = b"".join(members) + members[0][:300]
    (tmp_path / "outer.warc.gz").write_bytes(content)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    got = warc.read_archives(warc.list_archives(spark, str(tmp_path)), split).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(1, inner), (2, b"two"), (3, inner + inner), (4, b"")]
    for r in got:
        fields, _ = warc.parse(gzip.decompress(content[r.offset : r.end]))
        assert fields["page-id"] == str(r.page_id)
    source = pa.BufferReader(content)
    whole = [r[:2] for r in warc._owned(warc._Archive(source, len(content)), 0, len(content))]
    assert whole == sorted((r.offset, r.end) for r in got)
    for chunk in (3, 4, 64, 1000):
        monkeypatch.setattr(warc, "CHUNK_BYTES", chunk)
        assert [r[:2] for r in warc._owned(warc._Archive(source, len(content)), 0, len(content))] == whole
        assert [r[:2] for r in warc._owned(warc._Archive(source, len(content)), whole[1][0], whole[2][0])] == whole[1:2]


def test_damaged_payload(spark, tmp_path):
    whole = warc.record(1, "u", b"payload", None, False).replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")
    (tmp_path / "bad.warc.gz").write_bytes(warc._member(whole))
    with pytest.raises(Exception, match="does not fit its digest"):
        warc.read_archives(warc.list_archives(spark, str(tmp_path))).collect()
