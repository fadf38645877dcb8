"""Order-dependent operators: the block-wise forms against plain Python on random histories."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import history, ordered

START = datetime(2026, 1, 1)
WORDS = ["add graph 1", "add graph 2", "Add Graph three", "wip", "solo", "tune cache", "tune cache 7.1", "a-b", "Fix typo x", "fixture data"]


def random_commits(seed: int, n: int = 300, repos: int = 3):
    rng = random.Random(seed)
    ticks = rng.sample(range(n * 50), n)
    return [
        (rng.choice("abc"[:repos]), f"{k:05d}", START + timedelta(minutes=ticks[k]), rng.choice(WORDS), rng.choice([None, k]))
        for k in range(n)
    ]


@pytest.fixture(scope="module")
def commits(spark):
    rows = random_commits(1)
    df = spark.createDataFrame(rows, "repo string, hash string, ts timestamp, subject string, mark int")
    df = df.withColumn("author", F.lit("x")).withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    return rows, df.cache()


def by_repo(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[2], r[1])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("block", [None, "day", "one"])
def test_carries(spark, commits, block):
    rows, df = commits
    blocks = {None: None, "day": F.to_date("ts"), "one": F.lit(0)}[block]
    keys, order = ["repo"], ["ts", "hash"]
    out = ordered.with_previous(df, keys, order, {"before": "subject"}, blocks)
    out = ordered.with_running_last(out, keys, order, {"last_mark": "mark"}, blocks)
    out = ordered.with_running_sum(out, keys, order, "mark", "total", blocks)
    got = {r["hash"]: (r.before, r.last_mark, r.total) for r in out.collect()}
    assert len(got) == len(rows)
    for group in by_repo(rows).values():
        before = mark = None
        total = None
        for _, name, _, subject, value in group:
            if value is not None:
                mark, total = value, (total or 0) + value
            assert got[name][:2] == (before, mark)
            assert (got[name][2] or 0) == (total or 0)
            before = subject


def collapsed(group):
    """Newest first, as (subject, commits, newest hash)."""
    out, index = [], 0
    group = group[::-1]
    base = lambda s: (m := re.match(r"^(.+?)\s+(\d+(?:\.\d+)*|\w+)$", s)) and m.group(1)
    while index < len(group):
        name, end = base(group[index][3]), index + 1
        while name and end < len(group) and (base(group[end][3]) or "").lower() == name.lower():
            end += 1
        n = end - index
        out.append((f"{name}: {n} iterations" if n > 1 else group[index][3], n, group[index][1]))
        index = end
    return out


@pytest.mark.parametrize("block", [None, "day"])
def test_collapse_runs(commits, block):
    rows, df = commits
    out = history.collapse_runs(df, block=F.to_date("ts") if block else None).orderBy(F.desc("ordering")).collect()
    for repo, group in by_repo(rows).items():
        assert [(r.subject, r.commits, r["hash"]) for r in out if r.repo == repo] == collapsed(group)


def test_timeline_limits_in_order(commits):
    rows, df = commits
    out = history.timeline(df.withColumn("date", F.to_date("ts")), keep=10).orderBy("position").collect()
    for repo, group in by_repo(rows).items():
        kept = [r for r in group if not re.match(r"(?i)(fix typo|wip|update|checkpoint|save|fix|refactor|cleanup|minor|test)", r[3])]
        assert [(r.subject, r.commits, r["hash"]) for r in out if r.repo == repo] == collapsed(kept)[:10]


def test_iterations_of_one_series(spark):
    rows = [("r", h, d, s) for h, d, s in [("4", "2026-01-15", "redesign graph 8.0"), ("3", "2026-01-12", "redesign graph 7.0"), ("2", "2026-01-10", "redesign graph 6.0"), ("1", "2026-01-09", "ship")]]
    df = spark.createDataFrame(rows, "repo string, hash string, date string, subject string").withColumn("ts", F.col("date")).withColumn("author", F.lit("a"))
    got = [(r.subject, r.date) for r in history.timeline(df).orderBy("position").collect()]
    assert got == [("redesign graph: 3 iterations", "2026-01-10 — 2026-01-15"), ("ship", "2026-01-09")]


def test_timeline_reaches_behind_noise_and_long_runs(spark):
    """Noise and runs of any length cost no row; whole blocks of one run are passed."""
    subjects = ["first", "second b"] + [f"graph {n}" for n in range(300)] + ["wip"] * 120 + [f"graph {n}" for n in range(40)] + ["minor"] * 200 + ["last"]
    rows = [("r", f"{n:04}", START + timedelta(hours=5 * n), s, "a") for n, s in enumerate(subjects)] + [("quiet", "x", START, "wip", "a"), ("r", "old", START - timedelta(days=9), "ancient", "a")]
    df = spark.createDataFrame(rows, "repo string, hash string, ts timestamp, subject string, author string").withColumn("date", F.to_date("ts"))
    got = [(r.subject, r.commits) for r in history.timeline(df, keep=3).orderBy("position").collect()]
    assert got == [("last", 1), ("graph: 340 iterations", 340), ("second b", 1)]
    assert [r.subject for r in history.timeline(df, keep=9).orderBy("position").collect()] == ["last", "graph: 340 iterations", "second b", "first", "ancient"]
    few = history.newest_blocks(history.drop_noise(df), ["repo"], "subject", "date", 1)
    assert few.filter("subject = 'ancient'").count() == 0 and few.count() > 300


@pytest.mark.parametrize("seed", range(3))
def test_timeline_against_whole_history(spark, seed):
    rng = random.Random(seed)
    words = ["graph 1", "graph 2", "Graph v3", "login a", "login b", "one", "wip", "two words", "fix"]
    rows = [(f"r{n % 3}", f"{n:04}", START + timedelta(hours=rng.randrange(900)), rng.choice(words), "a") for n in range(400)]
    df = spark.createDataFrame(rows, "repo string, hash string, ts timestamp, subject string, author string").withColumn("date", F.to_date("ts"))
    whole = history.collapse_runs(history.drop_noise(df))
    for keep in (1, 4, 30):
        want = {}
        for r in sorted(whole.collect(), key=lambda r: (r.ordering.ts, r.ordering.hash), reverse=True):
            want.setdefault(r.repo, []).append((r.subject, r.commits, r["hash"], r.date))
        got = {}
        for r in history.timeline(df, keep=keep).orderBy("position").collect():
            got.setdefault(r.repo, []).append((r.subject, r.commits, r["hash"], r.date))
        assert got == {repo: runs[:keep] for repo, runs in want.items()}


def test_clock_of_each_repository(spark):
    rows = [("a", "x", START), ("a", "y", START - timedelta(days=40)), ("b", "x", START), ("b", "y", datetime(2099, 1, 1)), ("c", "z", datetime(2098, 1, 1)), ("c", "w", datetime(2097, 1, 1))]
    df = spark.createDataFrame(rows, "repo string, path string, ts timestamp")
    assert {(r.repo, r.path) for r in history.churn(df).collect()} == {("a", "x"), ("b", "x"), ("b", "y"), ("c", "z")}
    assert {(r.repo, r.path) for r in history.churn(df, clock=[]).collect()} == {("a", "x"), ("b", "x"), ("b", "y"), ("c", "z"), ("c", "w")}
    late = F.lit(datetime(2100, 1, 1)).cast("timestamp")
    assert {tuple(r) for r in history.clocks(df, latest=late).collect()} == {("a", START), ("b", datetime(2099, 1, 1)), ("c", datetime(2098, 1, 1))}
    assert history.churn(df.limit(0)).count() == 0
    modules = history.module_churn(df.withColumn("path", F.concat(F.lit("src/"), "path")), eligible=df.filter("path <> 'x'").withColumn("path", F.concat(F.lit("src/"), "path")))
    assert {(r.repo, r.changes) for r in modules.collect()} == {("a", 1), ("b", 1), ("c", 1)}


def test_noise_has_no_word_boundary(spark):
    df = spark.createDataFrame([("r", s) for s in ["fixture data", "Testimonials page", "WIP", "Add tests", "Minor"]], "repo string, subject string")
    assert [r.subject for r in history.drop_noise(df).collect()] == ["Add tests"]
    assert list(history.noise_counts(df).first()) == ["r", 5, 1, 4]


@pytest.mark.parametrize("minimum", [2, 3, 4])
def test_bursts_against_brute_force(spark, minimum):
    rng = random.Random(minimum)
    rows, want = [], {}
    for key in range(60):
        times = [rng.randrange(0, 40_000) for _ in range(rng.randrange(1, 14))]
        if key == 7:
            times = [1800 * n * 10 for n in range(20)]
        if key == 8:
            times = [100, 1000, 1900][: max(3, minimum)]
        if key == 9:
            times = [1000] * 50
        rows += [(key, START + timedelta(seconds=s)) for s in times]
        times.sort()
        want[key] = any(times[i + minimum - 1] - times[i] <= 1800 for i in range(len(times) - minimum + 1))
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(rows, "k int, ts timestamp_ntz").withColumn("ts", F.col("ts").cast(kind))
        got = {r.k: r.burst for r in history.bursts(df, ["k"], minimum=minimum).collect()}
        assert got == want
    assert any(want.values()) and not all(want.values())


def test_hotspots_and_matrix(spark):
    touches = [("a", p) for p in ["x"] * 3 + ["b"] * 3 + ["c"] * 2 + ["d", "e", "f"]] + [("z", "q")] * 4
    df = spark.createDataFrame(touches, "repo string, path string").withColumn("ts", F.lit(START))
    counts = history.churn(df)
    top = history.hotspots(counts).filter("repo = 'a'").orderBy("rank").collect()
    assert [(r.path, r.changes) for r in top] == [("b", 3), ("x", 3), ("c", 2), ("d", 1), ("e", 1)]
    matrix = history.hotspot_matrix(counts, limit=3).orderBy("rank").collect()
    assert [(r["rank"], r.repo, r.path) for r in matrix] == [(1, "z", "q"), (2, "a", "b"), (3, "a", "x")]
    assert [r.path for r in history.hotspot_matrix(counts).orderBy("rank").collect()] == ["q", "b", "x", "c", "d", "e", "f"]
    assert [r.path for r in history.sort_hotspots(counts, "path").collect()] == ["b", "c", "d", "e", "f", "q", "x"]
    with pytest.raises(ValueError):
        history.hotspots(counts, k=0)


def test_churn_window(spark):
    rows = [("r", "old", START), ("r", "new", START + timedelta(days=40)), ("r", "edge", START + timedelta(days=10))]
    df = spark.createDataFrame(rows, "repo string, path string, ts timestamp")
    assert {r.path for r in history.churn(df).collect()} == {"new", "edge"}
    late = F.lit(START + timedelta(days=60)).cast("timestamp")
    assert {r.path for r in history.churn(df, as_of=late).collect()} == {"new"}


def test_parts_bound_groups_and_lose_nothing(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4500, "hot").otherwise("cold").alias("k"), "id")
    sizes = ordered.with_part(df, ["k"], F.col("id"), 100).groupBy("k", "part").count().collect()
    assert sum(r["count"] for r in sizes) == 5000
    assert max(r["count"] for r in sizes) < 200
    assert {r.k for r in sizes} == {"hot", "cold"}


def test_repeated_groups_are_never_broadcast(spark):
    """Groups within the limit of broadcasts are sent once, not in 32 copies; those above it are not sent, nor where
    the columns that are read would fit."""
    rows = spark.range(50).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 7)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "100000")
    try:
        for count, sent in ((3_000, True), (20_000, False), (7_000, False)):
            groups = spark.range(count).selectExpr("id AS k", "id + 1 AS n", "id + 2 AS m")
            joined = ordered.join_groups(rows, groups, ["k"], F.col("v"), how="left").drop("m")
            plan = joined._jdf.queryExecution().sparkPlan().toString()
            assert ("BroadcastHashJoin" in plan, "Generate" in plan or "Expand" in plan) == (sent, not sent)
            assert sorted((r.k, r.v, r.n) for r in joined.collect()) == [(k, 7 * k, k + 1) for k in range(50)]
    finally:
        spark.conf.set(limit, before)
