"""Folder trees and the paths that differ between two snapshots, against plain dictionaries."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import snapshot

SCHEMA = "repo string, path string, token string"


def folders_of(path):
    parts = path.split("/")
    return ["", *["/".join(parts[:n]) for n in range(1, len(parts))]]


def differing(new, old):
    out, below = set(), {}
    for key in {**new, **old}:
        if new.get(key) != old.get(key):
            out.add((key[0], "file", key[1], "new" if key not in old else "gone" if key not in new else "changed"))
    for repo, path in {**new, **old}:
        for folder in folders_of(path):
            below.setdefault((repo, folder), set()).add((repo, path))
    for (repo, folder), files in below.items():
        if any(new.get(f) != old.get(f) for f in files):
            held = [any(f in side for f in files) for side in (new, old)]
            out.add((repo, "folder", folder, "changed" if all(held) else "new" if held[0] else "gone"))
    return out


@pytest.mark.parametrize(("seed", "step"), [(1, 1), (2, 3), (3, 0), (4, 9)])
def test_changed_paths(spark, seed, step):
    rng = random.Random(seed)
    name = lambda: "/".join(rng.choice("ab") for _ in range(rng.randrange(0, 5))) + rng.choice(["/x", "/y", "/z"])
    old = {(rng.choice("rst"), name().lstrip("/")): str(rng.randrange(3)) for _ in range(60)}
    new = {k: v for k, v in old.items() if k[0] == "r" or rng.random() < 0.9}
    new |= {(rng.choice("stu"), name().lstrip("/")): str(rng.randrange(3)) for _ in range(8)}
    sides = [snapshot.file_digests(spark.createDataFrame([(*k, v) for k, v in side.items()], SCHEMA), F.col("token")) for side in (new, old)]
    assert {tuple(r) for r in snapshot.changed_paths(*sides, step=step).collect()} == differing(new, old)
    assert snapshot.changed_paths(sides[1], sides[1], step=step).count() == 0


def test_folder_tree(spark):
    df = spark.createDataFrame([("r", "a/b/x", "1"), ("r", "a/y", "2"), ("r", "z", "3"), ("s", "a/b/x", "1")], SCHEMA)
    tree = {(r.repo, r.folder): (r.files, r.fingerprint) for r in snapshot.folder_tree(snapshot.file_digests(df, F.col("token"))).collect()}
    assert {k: v[0] for k, v in tree.items()} == {("r", ""): 3, ("r", "a"): 2, ("r", "a/b"): 1, ("s", ""): 1, ("s", "a"): 1, ("s", "a/b"): 1}
    assert tree["r", "a/b"] == tree["s", "a/b"] != tree["s", "a"][1:] and len(tree["r", ""][1]) == 64
    top = snapshot.folder_tree(snapshot.file_digests(df, F.col("token")), depth=1).collect()
    assert {(r.repo, r.folder) for r in top} == {("r", ""), ("r", "a"), ("s", ""), ("s", "a")}


def test_every_digit_of_a_digest_counts(spark):
    digests = ["0" * n + "1" + "0" * (63 - n) for n in range(64)] + ["0" * 64]
    df = spark.createDataFrame([(n, "p", d) for n, d in enumerate(digests)], "repo int, path string, digest string")
    sums = df.groupBy("repo").agg(*snapshot._sums(F.col("digest"))).drop("repo").distinct().count()
    assert sums == 65
