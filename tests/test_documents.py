"""JSON with repeated keys, against Python's reader."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from fleetscope.functions import documents
from fleetscope.sources import manifests, workspace

TEXTS = [
    '{"dependencies": {"a": "1", "a": "2", "b": 5, "c": {"x": 1, "x": 2}, "d": "5", "e": null, "f": true, "g": [1]}, "dependencies": {"a": "3", "z": "0", "z": "9"}}',
    '{"dependencies": {"a": 1, "a": "2", "b": "5", "b": 5}, "devDependencies": {"a": "7"}}', '{"dependencies": {"n": {"x": 1, "x": 2}, "a": "^1", "b": true}}',
    '{"dependencies": [1, 2], "devDependencies": {"q": "\\u00e9"}}', '{"dependencies": {"a"', "", " ", "{}", '{"dependencies": null}', '{"dependencies": {"a": "1"}, "dependencies": null}',
    '{"dependencies": {"a": "1",}}', "{'dependencies': {'a': '1'}}", '{"dependencies": {"a": "tab\there"}}', '﻿{"dependencies": {}}', '{"a": 1, "a": {"b": 1, "b"}}', '{"dependencies": {"true": "true", "t": true}}',
]


def expected(text):
    try:
        data = json.loads(text)
    except ValueError:
        return True, []
    out = []
    for section in ("dependencies", "devDependencies"):
        held = data.get(section)
        out += [(k, v if isinstance(v, str) else None) for k, v in held.items()] if isinstance(held, dict) else []
    return False, sorted(out, key=str)


def test_manifests_with_repeated_keys(spark):
    df = spark.createDataFrame([("r", f"{n}/package.json", t) for n, t in enumerate(TEXTS)] + [("r", "null/package.json", None)], "repo string, path string, content string")
    got = {r.manifest: (r.malformed, sorted([(e.dependency, e.spec) for e in r.entries], key=str)) for r in manifests.read_manifests(df).collect()}
    assert got.pop("null/package.json") == (True, [])
    assert got == {f"{n}/package.json": expected(t) for n, t in enumerate(TEXTS)}


def test_lists_with_repeated_keys(spark):
    texts = ['{"workspaces": ["a"], "workspaces": ["b", " ", "c/*"]}', '{"workspaces": {"packages": ["x"], "packages": ["y"]}}', '{"workspaces": 5}', '{"workspaces": ["a"', "[]", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.p for r in df.select(workspace.json_patterns(F.col("t"), "workspaces", "workspaces.packages").alias("p")).collect()]
    assert got == [["b", "c/*"], ["y"], None, None, None, None]
    assert [r.p for r in df.select(documents.string_list(F.col("t"), "nothing").alias("p")).collect()] == [None] * 6
