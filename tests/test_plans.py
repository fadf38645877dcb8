"""What the plans of the scale-critical queries must look like."""

from __future__ import annotations

import re

import pytest

from fleetscope.plans.catalog import CATALOGUE

FOLDER = "/root/testdata/sf0.001"
PYTHON_ALLOWED = {"manifest_packages": "MapInPandas", "risk_union": "MapInPandas", "manifest_dependencies": "MapInPandas", "manifest_errors": "MapInPandas", "text_entropy": "ArrowEvalPython"}


@pytest.fixture(scope="module")
def plan(spark):
    def text(name: str) -> str:
        return CATALOGUE[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()

    return text


def check_plan(name: str, text: str) -> None:
    """No pairs, no row-wise Python, nothing gathered into one task; asked of every query."""
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    python = re.findall(r"MapInPandas|ArrowEvalPython|FlatMapGroupsInPandas", text)
    assert set(python) <= {PYTHON_ALLOWED.get(name)}
    for gathered in text.split("Exchange SinglePartition")[1:]:
        below = gathered.splitlines()[1]
        allowed = "functions=[partial_max(" in below or name == "hotspot_matrix"
        assert allowed, f"one task would see everything: {below}"


@pytest.mark.parametrize(
    "name", ["line_explode", "marker_scan", "secret_scan", "text_entropy", "inline_signature", "path_refs", "version_specs", "commit_log", "commit_meta", "eligible_source"]
)
def test_row_wise_scans_do_not_shuffle(plan, name):
    assert "Exchange" not in plan(name)


@pytest.mark.parametrize("name", ["hotspots", "topk_per_group", "history_window", "commit_timeline", "burst_detect", "top_contributors"])
def test_rank_limits_run_before_the_shuffle(plan, name):
    assert "WindowGroupLimit" in plan(name)


def test_columns_and_filters_reach_the_scan(plan):
    assert re.search(r"ReadSchema: struct<doc_id:bigint,source:string,n_chars:bigint>", plan("missing_tests"))
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>", plan("burst_detect"))
    assert "EqualTo(toxic,1)" in plan("unified_risks")


def test_only_checked_sides_are_broadcast():
    """No operator forces a broadcast: Spark's statistics or a measured size decide."""
    from pathlib import Path

    import fleetscope

    for file in Path(fleetscope.__file__).parent.rglob("*.py"):
        if file.parent.name == "llm":  # an optional part with rules and tests of its own
            continue
        source = file.read_text()
        assert "broadcast(" not in source, file
        assert ".collect()" not in source and "localCheckpoint" not in source, file


@pytest.mark.parametrize(
    "name", ["ownership_lines", "module_totals", "ownership_shares", "top_contributors", "ai_line_share", "module_ownership"]
)
def test_blame_lines_are_dealt_over_a_fixed_number_of_tasks(plan, name):
    """Adaptive execution would join partitions up to a size in bytes, of which the counts take many times as much."""
    assert re.search(r"hashpartitioning\(l_orderkey#\d+L?, 256\), REPARTITION_BY_NUM", plan(name))


@pytest.mark.parametrize("name", ["vulnerability_ranges", "vulnerability_join", "manifest_dependencies", "manifest_packages"])
def test_costly_rows_of_small_tables_are_dealt(plan, name):
    assert re.search(r"hashpartitioning\(p_partkey#\d+L?, 64\), REPARTITION_BY_NUM", plan(name))


@pytest.mark.parametrize("name", ["manifest_dependencies", "manifest_packages"])
def test_manifests_are_parsed_once(plan, name):
    assert not [line for line in plan(name).splitlines() if re.match(r"[ :+-]*Filter ", line) and "try_parse_json" in line]


def test_version_keys_are_made_of_distinct_versions(plan):
    """A filter on the key below the distinct would read the version of every package row."""
    below = [line for line in plan("vulnerability_ranges").splitlines() if re.match(r"[ :+-]*Filter ", line) and "l_partkey" in line]
    assert below and not [line for line in below if "alpha" in line]
