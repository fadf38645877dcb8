"""Findings as risk rows, their union, filters, counts and the checklist built from them.

A risk row is ``(repo, source, position, severity, message, confidence)`` and what it is about, ``path, line_no,
package, detail``, each NULL where it has none; ``position`` is the fixed place of its source in the report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import confidence, paths
from fleetscope.session import Workspace

SEVERITIES = ["critical", "warning", "info"]
# Report order of the sources.
POSITIONS = {
    "secrets": 1,
    "markers": 2,
    "missing-tests": 3,
    "dependency-conflicts": 4,
    "external": 5,
    "manifests": 6,
    "skipped": 7,
    "vulnerabilities": 8,
}
#: What a risk is about; ``detail`` holds the versions of a conflict and the identifier of an advisory.
IDENTITY = {"path": "string", "line_no": "long", "package": "string", "detail": "string"}
REPORTED = ["source", "severity", "message", "confidence"]
# The words of the report.
MISSING_TESTS = "Missing tests directory (`tests/`, `test/`, or `__tests__/`)."
SKIPPED_CHECK = "Skipping remote vulnerability check (offline/timeout)"
DEFAULT_STEP = "Review the sections above and validate the project setup."
DEFAULT_FLEET_STEP = "Review the system sections above and validate each service setup."


def risk_rows(
    df: DataFrame,
    source: Column | str,
    severity: Column | str,
    message: Column,
    level: Column | str,
    keys: Sequence[str] = ("repo",),
    position: Column | None = None,
    **about: Column | str,
) -> DataFrame:
    """``about`` names columns of :data:`IDENTITY`."""
    lit = lambda value: F.lit(value) if isinstance(value, str) else value
    place = F.lit(POSITIONS.get(source, POSITIONS["external"])) if isinstance(source, str) else position
    identity = [
        (F.lit(None) if name not in about else F.col(about[name]) if isinstance(about[name], str) else about[name]).cast(kind).alias(name)
        for name, kind in IDENTITY.items()
    ]
    return df.select(
        *keys, lit(source).alias("source"), place.alias("position"), lit(severity).alias("severity"), message.alias("message"),
        lit(level).alias("confidence"), *identity,
    )


def _place(path: str, line: str) -> Column:
    return F.concat_ws(":", F.col(path).cast("string"), F.col(line).cast("string"))


def secret_risks(
    findings: DataFrame, keys: Sequence[str] = ("repo",), path: str = "path", line: str = "line_no",
    in_test: Column | None = None,
) -> DataFrame:
    """Critical, or a warning below a test or fixture folder."""
    fixture = paths.test_path(F.col(path).cast("string")) if in_test is None else in_test
    message = F.concat(
        F.when(fixture, "Hard-coded secret-like value in test/example file ").otherwise("Hard-coded secret in "),
        _place(path, line),
    )
    severity = F.when(fixture, "warning").otherwise("critical")
    return risk_rows(findings, "secrets", severity, message, F.col("confidence"), keys, path=path, line_no=line)


def marker_risks(
    findings: DataFrame, keys: Sequence[str] = ("repo",), path: str = "path", line: str = "line_no"
) -> DataFrame:
    message = F.concat(F.col("marker"), F.lit(" in "), _place(path, line))
    return risk_rows(findings, "markers", "info", message, F.col("confidence"), keys, path=path, line_no=line)


def finding_risks(
    findings: DataFrame, keys: Sequence[str] = ("repo",), path: str = "path", line: str = "line_no", in_test: Column | None = None
) -> DataFrame:
    """Risk rows of :func:`fleetscope.operators.lines.scan_findings`, without reading it twice."""
    secret = F.col("kind") == "secrets"
    fixture = paths.test_path(F.col(path).cast("string")) if in_test is None else in_test
    message = F.concat(
        F.when(~secret, F.concat(F.col("marker"), F.lit(" in ")))
        .when(fixture, F.lit("Hard-coded secret-like value in test/example file "))
        .otherwise(F.lit("Hard-coded secret in ")),
        _place(path, line),
    )
    severity = F.when(~secret, "info").when(fixture, "warning").otherwise("critical")
    position = F.when(secret, POSITIONS["secrets"]).otherwise(POSITIONS["markers"])
    return risk_rows(findings, F.col("kind"), severity, message, F.col("confidence"), keys, position, path=path, line_no=line)


def missing_tests(
    files: DataFrame, keys: Sequence[str] = ("repo",), path: Column | None = None,
    roots: Sequence[str] = paths.TEST_ROOTS,
) -> DataFrame:
    """Per repository: no file below a root test folder. (An empty folder has no row to be seen by.)"""
    name = F.col("path") if path is None else path
    below = paths.any_of([name.startswith(f"{root}/") for root in roots])
    return files.groupBy(*keys).agg((~F.coalesce(F.bool_or(below), F.lit(False))).alias("missing_tests"))


def missing_tests_risks(flags: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    return risk_rows(flags.filter("missing_tests"), "missing-tests", "warning", F.lit(MISSING_TESTS), "HIGH", keys)


def conflict_risks(conflicts: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    message = F.concat(
        F.lit("Duplicate dependency `"), F.col("package"), F.lit("` with conflicting versions: "),
        F.array_join("versions", ", "), F.lit("."),
    )
    return risk_rows(conflicts, "dependency-conflicts", "warning", message, "MEDIUM", keys, package="package", detail=F.array_join("versions", ", "))


def manifest_risks(warnings: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    return risk_rows(warnings, "manifests", "warning", F.col("message"), "HIGH", keys, path="manifest")


def skipped_check_risks(repos: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """The notice for repositories whose advisories could not be looked up."""
    return risk_rows(repos.select(*keys).distinct(), "skipped", "info", F.lit(SKIPPED_CHECK), "HIGH", keys)


def vulnerability_message() -> Column:
    fix = F.when(F.col("fixed_in") != "", F.concat(F.lit(" (fix: "), F.col("fixed_in"), F.lit(")"))).otherwise("")
    return F.concat(F.col("id"), F.lit(" in `"), F.col("package"), F.lit("`: "), F.col("summary"), fix)


def vulnerability_risks(findings: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    return risk_rows(findings, "vulnerabilities", F.col("severity"), vulnerability_message(), F.col("confidence"), keys, package="package", detail="id")


def risk_map(parts: Sequence[DataFrame], minimum: str = "medium") -> DataFrame:
    """Union of risk rows at or above the minimum confidence; the filter runs inside every part."""
    kept = [part.filter(confidence.meets(F.col("confidence"), minimum)) for part in parts]
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def search_risks(risks: DataFrame, severity: str = "all", level: str = "all", text: str = "") -> DataFrame:
    """Severity and confidence filters (``all`` passes) and a case-insensitive substring."""
    out = risks
    if severity != "all":
        out = out.filter(F.col("severity") == severity)
    if level != "all":
        out = out.filter(F.col("confidence") == level)
    if text:
        out = out.filter(F.contains(F.lower("message"), F.lit(text.lower())))
    return out


def risk_counts(risks: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Risks per severity and in total."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return risks.groupBy(*keys).agg(*counts, F.count(F.lit(1)).alias("total"))


def risk_status(counts: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    status = confidence.risk_status(F.col("critical"), F.col("warning"), F.col("info"))
    return counts.select(*keys, status["label"].alias("label"), status["color"].alias("color"))


def unified_risks(risks: DataFrame, vulnerabilities: DataFrame | None = None, service: str = "repo") -> DataFrame:
    """Fleet view: messages prefixed with their service. Vulnerabilities are listed once more, under
    their own severity and unfiltered."""
    prefix = F.concat(F.lit("["), F.col(service).cast("string"), F.lit("] "))
    out = risks.select(service, "severity", F.concat(prefix, F.col("message")).alias("message"), "confidence")
    if vulnerabilities is None:
        return out
    listed = vulnerabilities.select(
        service,
        F.lit("vulnerabilities").alias("severity"),
        F.concat(prefix, vulnerability_message()).alias("message"),
        F.lit("HIGH").alias("confidence"),
    )
    return out.unionByName(listed)


def _steps(df: DataFrame, section: int, step: Column, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.lit(section).alias("section"), step.alias("step"))


def risk_steps(risks: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Actions for secrets, missing tests and conflicts, from what the risks are about."""
    at = F.concat(F.col("path"), F.lit(" (line "), F.col("line_no").cast("string"), F.lit(")"))
    source, severity = F.col("source"), F.col("severity")
    step = (
        F.when((source == "secrets") & (severity == "critical"), F.concat(F.lit("Review and rotate hard-coded credentials in "), at, F.lit(".")))
        .when(
            source == "secrets",
            F.concat(F.lit("Confirm the secret-like value in "), at, F.lit(" is a test fixture, not a live credential.")),
        )
        .when(source == "missing-tests", F.lit("Add a `tests/` directory and cover critical paths."))
        .when(
            source == "dependency-conflicts",
            F.concat(F.lit("Resolve version conflict for `"), F.col("package"), F.lit("`: "), F.col("detail"), F.lit(".")),
        )
    )
    return _steps(risks, 1, step, keys).filter(F.col("step").isNotNull())


def checklist(
    repos: DataFrame,
    risks: DataFrame,
    vulnerabilities: DataFrame | None = None,
    frameworks: DataFrame | None = None,
    hotspots: DataFrame | None = None,
    drift: DataFrame | None = None,
    keys: Sequence[str] = ("repo",),
    minimum: str = "medium",
    incremental: bool = False,
    default: str = DEFAULT_STEP,
    workspace: Workspace | None = None,
) -> DataFrame:
    """Ordered actions per repository as (keys, section, step).

    Sections: 1 risks, 2 upgrades, 3 frameworks, 4 hotspots, 5 stale paths, 6 stack documentation,
    7 environment documentation; 8 is the default of a repository without any. With a ``workspace`` the
    steps are made once for both.
    """
    keys = list(keys)
    parts = [risk_steps(risks, keys)]
    if vulnerabilities is not None:
        usable = vulnerabilities.filter((F.col("fixed_in") != "") & confidence.meets(F.col("confidence"), minimum))
        step = F.concat(F.lit("Upgrade `"), F.col("package"), F.lit("` to "), F.col("fixed_in"), F.lit(" ("), F.col("id"), F.lit(")."))
        parts.append(_steps(usable, 2, step, keys))
    if frameworks is not None:
        step = F.concat(F.lit("Set up the development environment for "), F.col("framework"), F.lit("."))
        parts.append(_steps(frameworks, 3, step, keys))
    if hotspots is not None:
        words = ("Review changed file in diff: ", " line changes).") if incremental else (
            "Review frequently changed file: ", " edits in 30 days).")
        step = F.concat(
            F.lit(words[0]), F.col("path").cast("string"), F.lit(" ("), F.col("changes").cast("string"), F.lit(words[1])
        )
        parts.append(_steps(hotspots, 4, step, keys))
    if drift is not None:
        warnings = drift.filter(F.col("severity") == "warning")
        stale = warnings.filter(F.col("kind") == "path").groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        step = F.concat(F.lit("Review "), F.col("__n").cast("string"), F.lit(" stale path reference(s) in documentation."))
        parts.append(_steps(stale, 5, step, keys))
        update = F.concat(F.lit("Update documentation: "), F.col("message"))
        stack = warnings.filter(F.col("kind") == "stack").select(*keys, "message").distinct()
        parts.append(_steps(stack, 6, update, keys))
        parts.append(_steps(warnings.filter(F.col("kind") == "env"), 7, update, keys))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if workspace is not None:
        out = workspace.table("steps", out)
    idle = repos.select(*keys).distinct().join(out.select(*keys).distinct(), keys, "left_anti")
    return out.unionByName(_steps(idle, 8, F.lit(default), keys))


def unified_checklist(steps: DataFrame, service: str = "repo") -> DataFrame:
    """Steps prefixed with their service."""
    prefix = F.concat(F.lit("["), F.col(service).cast("string"), F.lit("] "))
    return steps.select(service, "section", F.concat(prefix, F.col("step")).alias("step"))
