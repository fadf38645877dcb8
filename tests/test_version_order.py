"""Versions in the order that their ecosystems define, and advisory ranges over them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetscope.functions import advisories, version_order
from fleetscope.functions.advisories import OSV_SCHEMA
from fleetscope.operators import packages

#: Rising; versions in one entry are equal.
ORDERS = {
    "npm": [
        ["0.0.1"], ["1.0.0-alpha"], ["1.0.0-alpha.1"], ["1.0.0-alpha.beta"], ["1.0.0-beta"], ["1.0.0-beta.2"], ["1.0.0-beta.11"], ["1.0.0-rc.1"],
        ["1.0.0", "v1.0.0", "1.0", "1", "1.0.0+build.7", " 1.0.0 ", "01.0.0"], ["1.0.1-0"], ["1.0.1"], ["1.2"], ["1.10.0"], ["2.0.0-rc"], ["20230101000000000000000000.1"],
    ],
    "Go": [["v0.0.0-20190101000000-abcdef"], ["v0.0.0-20200101000000-0abcde"], ["v0.0.0"], ["v0.1.0"], ["v1.0.0+incompatible", "1.0.0"]],
    "PyPI": [
        ["1.0.dev1"], ["1.0a1.dev2"], ["1.0a1", "1.0alpha1", "1.0.0-A1"], ["1.0a2.dev456"], ["1.0a12"], ["1.0b1.dev456"], ["1.0b2"], ["1.0b2.post345.dev456"],
        ["1.0b2.post345"], ["1.0rc1.dev456"], ["1.0rc1", "1.0c1", "1.0-preview1"], ["1.0", "1", "v1.0.0"], ["1.0+abc.5"], ["1.0+abc.7"], ["1.0+5"],
        ["1.0.post456.dev34"], ["1.0.post456", "1.0-456", "1.0.r456"], ["1.0.15"], ["1.1.dev1"], ["1.1"], ["10.0"], ["1!0.1"],
    ],
    "Maven": [
        ["1-alpha-1", "1.0.0alpha1", "1a1"], ["1-alpha2"], ["1-beta"], ["1-milestone-3", "1m3"], ["1-rc1", "1.0-CR1"], ["1-SNAPSHOT"],
        ["1", "1.0", "1.0.0", "1-ga", "1.0-final", "1.Final"], ["1-sp"], ["1-foo"], ["1-1", "1.0-1"], ["1-2"], ["1.0.1"], ["1.1"], ["1.10"], ["2.0-rc1"], ["2"],
    ],
    "RubyGems": [["1.0.a"], ["1.0.a.2"], ["1.0.b1"], ["1.0.pre.1", "1.0-1", "1.0-1.0"], ["1.0.rc1"], ["1.0", "1", "1.0.0"], ["1.0.1.a"], ["1.0.1"], ["1.2"], ["1.10"]],
    "Packagist": [
        ["1.0.0-dev"], ["1.0.0-alpha1", "1.0a1"], ["1.0.0-beta"], ["1.0.0-beta2"], ["1.0.0-RC1"], ["1.0.0", "v1.0", "1.0.0-stable"], ["1.0.0-patch1", "1.0.0-p1"], ["1.0.1"], ["1.12.0"],
    ],
}


@pytest.mark.parametrize("ecosystem", list(ORDERS))
def test_version_order(spark, ecosystem):
    rows = [(place, version) for place, equal in enumerate(ORDERS[ecosystem]) for version in equal]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "place int, version string")
    keyed = df.withColumn("key", version_order.version_key(F.lit(ecosystem), F.col("version")))
    assert keyed.filter("key IS NULL OR size(key) = 0").count() == 0
    pairs = keyed.alias("a").join(keyed.alias("b"), F.expr("(a.place < b.place) <> (a.key < b.key) OR (a.place = b.place) <> (a.key = b.key)"))
    assert pairs.select("a.version", "b.version").collect() == []


def test_versions_that_cannot_be_read(spark):
    rows = [("npm", "latest"), ("npm", ""), ("npm", None), ("PyPI", "1.0-what"), ("Packagist", "dev-main"), ("RubyGems", "x.1"), ("Maven", " ")]
    df = spark.createDataFrame(rows, "e string, v string")
    assert df.select(version_order.version_key(F.col("e"), F.col("v")).alias("k")).filter("k IS NOT NULL").count() == 0


def inside(place, events):
    """The rule of the advisory format over places in a list of versions."""
    affected = False
    for at, kind in sorted(events):
        if kind == 0 and place >= at:
            affected = True
        elif kind == 1 and place >= at or kind == 2 and place > at:
            affected = False
    return affected


@pytest.mark.parametrize("ecosystem", ["npm", "PyPI", "Maven", "RubyGems"])
def test_ranges_by_brute_force(spark, ecosystem):
    rng, order = random.Random(7), ORDERS[ecosystem]
    records, rules = [], {}
    for n in range(60):
        places = rng.sample(range(-1, len(order)), rng.choice([1, 2, 2, 3, 4]))
        events = [(p, 0 if i % 2 == 0 else rng.choice([1, 2, 1])) for i, p in enumerate(sorted(places))]
        kinds = {0: "introduced", 1: rng.choice(["fixed", "limit"]), 2: "last_affected"}
        shown = [{kinds[k]: rng.choice(order[p]) if p >= 0 else "0"} for p, k in events]
        rng.shuffle(shown)
        if any(p < 0 and k for p, k in events):
            continue
        listed = rng.sample([v for equal in order for v in equal], rng.choice([0, 0, 2]))
        package = f"k{n % 3}"
        rules[f"A{n}"] = (package, events, listed)
        ranges = [{"type": "ECOSYSTEM", "events": shown}, {"type": "GIT", "events": [{"introduced": "0"}]}]
        records.append({"id": f"A{n}", "affected": [{"package": {"name": package, "ecosystem": ecosystem}, "versions": listed, "ranges": ranges}]})
    known = spark.createDataFrame(records, OSV_SCHEMA)
    used = [(f"r{i}", ecosystem, f"k{i % 4}", version, bool(i % 2)) for i, version in enumerate([v for equal in order for v in equal] * 4)]
    df = spark.createDataFrame(used, "repo string, ecosystem string, name string, version string, exact boolean")
    got = {(r.repo, r.id, r.package) for r in packages.match_advisories(df, known).collect()}
    place = {version: at for at, equal in enumerate(order) for version in equal}
    want = {
        (repo, advisory, name) for repo, _, name, version, _ in used for advisory, (package, events, listed) in rules.items()
        if package == name and (version in listed or inside(place[version], events))
    }
    assert got == want and len(got) > 50


def test_intervals_of_odd_ranges(spark):
    rows = [
        ([], "none"), (None, "none"), ([{"introduced": "0"}, {"introduced": "1.0"}, {"fixed": "2.0"}], "one"), ([{"fixed": "2.0"}], "none"),
        ([{"introduced": "1.0"}, {"fixed": "?"}], "none"), ([{"introduced": "0"}, {"fixed": "1.0"}, {"last_affected": "3.0"}], "one"),
        ([{"introduced": "1.0", "fixed": "2.0"}, {"introduced": ""}], "one"), ([{"introduced": "0"}, {"fixed": "1"}, {"introduced": "2"}], "two"),
    ]
    records = [{"id": name, "affected": [{"package": {"name": "x", "ecosystem": "npm"}, "ranges": [{"events": events}]}]} for events, name in rows]
    known = spark.createDataFrame(records, OSV_SCHEMA)
    got = known.select("id", F.size(advisories.affected_intervals(F.lit("npm"), F.get("affected", 0)["ranges"])).alias("n")).collect()
    assert [r.n for r in got] == [{"none": 0, "one": 1, "two": 2}[r.id] for r in got]


def test_python_names_and_missing_parts(spark):
    known = spark.createDataFrame(
        [{"id": "A", "affected": [{"package": {"name": "ruamel.yaml", "ecosystem": "PyPI"}, "ranges": [{"events": [{"introduced": "0"}]}]}, {"versions": ["1"]}]}, {"id": "B"}], OSV_SCHEMA
    )
    used = spark.createDataFrame(
        [("r", "PyPI", "Ruamel_Yaml", "0.1", True), ("r", "npm", "ruamel.yaml", "0.1", True), ("s", "PyPI", "ruamel-yaml", None, True), (None, None, None, None, None)],
        "repo string, ecosystem string, name string, version string, exact boolean",
    )
    assert [(r.repo, r.package, r.confidence) for r in packages.match_advisories(used, known).collect()] == [("r", "Ruamel_Yaml", "HIGH")]
    assert packages.match_advisories(used.limit(0), known).count() == 0 and packages.match_advisories(used, known.limit(0)).count() == 0
