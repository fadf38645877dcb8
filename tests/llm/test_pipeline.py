"""The pipeline's stages against brute force, and the registered queries on the smallest tables."""

from __future__ import annotations

import pytest
from check import compare, connect
from pyspark.sql import functions as F
from test_operators import ODD, brute_components, edited, prose, shingles

import corpus_pipeline
from fleetscope.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
LANGS = {"en": prose, "de": lambda seed, n: " ".join(f"sch{w}keit" for w in prose(seed, n).split())}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    items = [(i, prose(500 + i, 20 + i)) for i in range(5)]
    docs = [(i, LANGS["de" if i % 3 == 0 else "en"](i, 40 + i), "de" if i % 3 == 0 else "en") for i in range(60)]
    base = prose(77, 150)
    docs += [(100 + i, edited(base, i, 60 + i), "en") for i in range(12)] + [(120, base, "en"), (121, base, "en"), (122, base, "en")]
    docs += [(130 + i, f"{prose(600 + i, 90)} {t}", "en") for i, t in items] + [(140 + i, t, None) for i, t in enumerate(ODD)]
    docs += [(150, "12 34", "en"), (None, prose(88, 50), "en"), (5, LANGS["en"](5, 45), "en")]
    rows = [(d, t, lang, "s", len(t or "")) for d, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    named = dict(corpus_pipeline.STAGES)
    assert list(named) == ["language ID", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE encoding and decoding"]

    kept = named["language ID"](spark, docs, folder)
    assert kept.columns == docs.columns
    left = {(r.doc_id, r.text) for r in kept.collect()}
    assert {d for d, t in left if t in (None, "", " \n\t", "12 34")} == set()
    assert {d for d, _ in left} >= set(range(60)) | set(range(100, 112)) | {120, 121, 122}

    exact = named["exact dedup"](spark, docs, folder)
    rows = [(r.doc_id, r.text) for r in exact.collect()]
    best = {}
    for r in docs.collect():
        best[r.text or ""] = max(best.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
    assert sorted((-1 if d is None else d, t or "") for d, t in rows) == sorted((d, t) for t, d in best.items())

    near = named["n-gram Jaccard join"](spark, docs, folder)
    roots, _ = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in near.collect()} == {d for d, root in roots.items() if d == root} | {None}

    clean = named["benchmark decontamination"](spark, docs, folder)
    items = [shingles(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = [(r.doc_id, r.text) for r in docs.collect() if not any(100 * len(i & shingles(r.text)) >= 75 * len(i) for i in items)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in clean.collect()) and len(want) < docs.count()


CLASHES = ["accepted", "__accepted", "lang_pred", "__lang", "score", "items_found", "component_id", "node", "token", "recipe", "rank", "row", "__kept", "n_tokens", "ids_sha256"]


def test_stages_with_clashing_columns(spark, folder):
    """Columns called like those that the operators add change no decision."""
    plain = docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.withColumns({name: F.lit(False) for name in CLASHES})
    for name, stage in corpus_pipeline.STAGES:
        want = stage(spark, plain, folder)
        got = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == docs.columns, name
        rows = lambda df: sorted(str((r.doc_id, r.text if "text" in df.columns else r.ids_sha256)) for r in df.collect())
        assert rows(got) == rows(want), name


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in out.collect()}
    assert 122 not in ids and 100 in ids and not ids & {130, 131, 132, 133, 134, 150}


def test_empty(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    ok, note = compare(spark, connect(FOLDER), QUERIES[name], FOLDER)
    assert ok, note


def test_near_stage_broadcasts_no_repeated_rows(spark, folder):
    """Sets that fit a broadcast join as they are, not in a copy for each sub-key."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = corpus_pipeline.near_stage(spark, docs, folder)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert not any(repeated in plan for repeated in ("Generate", "Expand", "__salt"))
