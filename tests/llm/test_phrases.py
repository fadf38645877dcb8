"""Collocations against brute force, on small tables with nulls, ties, repeated rows, long texts and clashing columns."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetscope.llm import phrases


def pieces(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def counted(docs):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in docs:
        for words in pieces(text):
            totals[lang or "und"] += len(words)
            for size in range(1, 5):
                counts[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return counts, totals


def mined(docs, least, top):
    """The contract, phrase by phrase."""
    counts, totals = counted(docs)
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            score, _, left, right = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            longer = [q for q in found if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if all(100 * found[q] < 80 * a for q in longer):
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus(seed, count):
    rng = random.Random(seed)
    words = ["The", "the", "of", "new", "york", "city", "é", "漢字", "a", "b", "x y", "rare"]
    parts = ["new york city hall", "of the", "a a a a a a", "b"]
    ends = [" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ! "]
    piece = lambda: (rng.choice(parts) if rng.random() < 0.4 else rng.choice(words)) + rng.choice(ends)
    docs = [("".join(piece() for _ in range(rng.randrange(30))), rng.choice(["en", "de", None, "und"])) for _ in range(count)]
    return docs + [docs[0]] * 40 + [(None, "en"), ("", "en"), (" . ", "fr"), ("one", "it"), ("a b " * 3000, "en"), (f"q{'z' * 3000} b a", None)]


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize(("least", "top"), [(3, 2000), (12, 7), (1, 60)])
def test_collocations(spark, monkeypatch, small, least, top):
    if small:  # every prefix is lengthened, and all filters let much through
        monkeypatch.setattr(phrases, "GROUP_ROWS", 8)
        monkeypatch.setattr(phrases, "MAX_GROUPS", 9)
        monkeypatch.setattr(phrases, "MAX_BITS", 1)
    docs = corpus(least, 150)
    df = spark.createDataFrame([(*d, 1, "x", "x") for d in docs], "text string, lang string, n int, w1 string, rank string").repartition(3)
    got = phrases.collocations(df, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == mined(docs, least, top)


def test_counts_of_long_suffixes(spark, monkeypatch):
    monkeypatch.setattr(phrases, "GROUP_ROWS", 8)
    docs = corpus(9, 60)
    counts, spelled, totals = phrases.phrase_counts(spark.createDataFrame(docs, "text string, lang string"), least=2)
    words = {r.id: (r.lang, r.word) for r in spelled.collect()}
    got = {}
    for *ids, n in counts.collect():
        lang = words[ids[0]][0]
        got[lang, tuple(words[i][1] for i in ids if i)] = n
    want, sizes = counted(docs)
    assert got == {(lang, p): n for lang, own in want.items() for p, n in own.items() if n >= 2}
    assert dict(totals.collect()) == {lang: n for lang, n in sizes.items() if n}


def test_nothing(spark):
    df = spark.createDataFrame([(None, "en"), ("a b", "en")], "text string, lang string")
    assert phrases.collocations(df).count() == 0 and phrases.collocations(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        phrases.phrase_counts(df, least=0)


def test_shared_hashes(spark, monkeypatch):
    """Two words under one hash are seen, and another seed is taken."""
    docs = corpus(5, 60)
    df = spark.createDataFrame(docs, "text string, lang string")
    plain, tried = phrases._count_pairs, []

    def doubled(rows, seed, least, frequent):
        found = plain(rows, seed, least, frequent)
        tried.append(seed)
        return found.union(found.filter("w2 IS NULL").limit(1).withColumn("word", F.lit("other"))) if seed == 0 else found

    monkeypatch.setattr(phrases, "_count_pairs", doubled)
    got = phrases.collocations(df, least=3)
    assert sorted(tuple(r) for r in got.collect()) == mined(docs, 3, 2000) and tried == [0, 1]


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 21])
def test_words(monkeypatch, piece):
    monkeypatch.setattr(phrases, "_PIECE", piece)
    monkeypatch.setattr(phrases, "_known", {})
    texts = ["A b", "b  \n c", "", None, ". d", "d." + " " * 40 + "e", "e" + " " * 40 + "f", "é" * 30 + " G", "...", "x"]
    words = phrases._Words(pa.array(["skipped", *texts]).slice(1), np.zeros(len(texts), np.uint64), 0)
    want = [(row, word, i > 0) for row, text in enumerate(texts) for own in pieces(text) for i, word in enumerate(own)]
    assert list(zip(words.row.tolist(), [words.text(i) for i in range(len(words.id))], words.joined.tolist(), strict=True)) == want
    spelled = collections.defaultdict(set)
    for i, (_, word, _) in enumerate(want):
        spelled[word].add(words.id[i])
    assert all(len(s) == 1 for s in spelled.values()) and len(set.union(*spelled.values())) == len(spelled)


def test_local_counts(monkeypatch):
    monkeypatch.setattr(phrases, "_LOCAL_ROWS", 10)
    counts, rng, got, want = phrases._Counts(), random.Random(1), collections.Counter(), collections.Counter()
    for _ in range(40):
        rows = [(rng.randrange(4), rng.randrange(4)) for _ in range(rng.randrange(6))]
        want.update(rows)
        counts.add([np.array([r[i] for r in rows], np.uint64) for i in (0, 1)])
        if counts.full():
            for a, b, n in zip(*counts.take(), strict=True):
                got[int(a), int(b)] += int(n)
    for a, b, n in zip(*(counts.take() or ([], [], [])), strict=True):
        got[int(a), int(b)] += int(n)
    assert got == want and counts.take() is None
