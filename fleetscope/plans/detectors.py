"""Risk detectors as table functions.

A detector turns the scan's tables into rows ``severity, message, confidence`` per repository. The
registry resolves names, and a detector that fails contributes nothing but a warning.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fleetscope.functions import secrets
from fleetscope.operators import lines, packages, risks
from fleetscope.session import Workspace

RISK_COLUMNS = ("severity", "message", "confidence")


@dataclass(frozen=True)
class Settings:
    """Options of a scan, checked when made."""

    entropy_cutoff: float = secrets.ENTROPY_CUTOFF
    secret_patterns: Sequence[tuple[str, str]] = ()
    markers: Sequence[str] = tuple(lines.MARKERS)
    min_confidence: str = "medium"
    max_hotspots: int = 5

    def __post_init__(self) -> None:
        if self.entropy_cutoff <= 0:
            raise ValueError("entropy_cutoff must be positive")
        if self.max_hotspots < 1:
            raise ValueError("max_hotspots must be at least 1")
        for _, level in self.secret_patterns:
            if level not in ("HIGH", "MEDIUM", "LOW"):
                raise ValueError(f"invalid confidence of a secret pattern: {level!r}")


@dataclass(frozen=True)
class Context:
    """Tables a detector may read: ``files`` and whatever else the scan made."""

    tables: Mapping[str, DataFrame]
    settings: Settings = field(default_factory=Settings)
    keys: Sequence[str] = ("repo",)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


@dataclass(frozen=True)
class Detector:
    name: str
    description: str
    scan: Callable[[Context], DataFrame]


def _told(context: Context, kind: str) -> DataFrame | None:
    """The findings of a kind where a scan has made them already."""
    found = context.tables.get("findings")
    return None if found is None else risks.finding_risks(found.filter(F.col("kind") == kind), context.keys)


def _secrets(context: Context) -> DataFrame:
    if (told := _told(context, "secrets")) is not None:
        return told
    options = context.settings
    found = lines.scan_secrets(
        context["files"], keep=[*context.keys, "path"], cutoff=options.entropy_cutoff, custom=options.secret_patterns
    )
    return risks.secret_risks(found, context.keys)


def _markers(context: Context) -> DataFrame:
    if (told := _told(context, "markers")) is not None:
        return told
    found = lines.scan_markers(context["files"], keep=[*context.keys, "path"], markers=context.settings.markers)
    return risks.marker_risks(found, context.keys)


def _line_findings(context: Context) -> DataFrame:
    """Both kinds of line findings in one pass, or from the table ``findings`` where a scan has made it."""
    options = context.settings
    found = context.tables.get("findings")
    if found is None:
        found = lines.scan_findings(
            context["files"], keep=[*context.keys, "path"], markers=options.markers,
            cutoff=options.entropy_cutoff, custom=options.secret_patterns,
        )
    return risks.finding_risks(found, context.keys)


def _missing_tests(context: Context) -> DataFrame:
    return risks.missing_tests_risks(risks.missing_tests(context["files"], context.keys), context.keys)


def _conflicts(context: Context) -> DataFrame:
    found = packages.dependency_conflicts(context["requirements"], [*context.keys, "manifest"])
    return risks.conflict_risks(found, context.keys)


BUILT_IN = [
    Detector("secrets", "Hard-coded credentials in source files", _secrets),
    Detector("markers", "Open work markers in source files", _markers),
    Detector("missing-tests", "Repositories without a root tests folder", _missing_tests),
    Detector("dependency-conflicts", "Packages one manifest asks for in several versions", _conflicts),
]


def resolve(
    external: Iterable[Detector] = (), disabled: Iterable[str] = (), built_in: Sequence[Detector] = tuple(BUILT_IN)
) -> list[Detector]:
    """Built-in detectors first; disabled names are left out, taken names are refused with a warning."""
    off = {name.strip() for name in disabled}
    out: dict[str, Detector] = {}
    for detector in [*built_in, *external]:
        if detector.name in off:
            continue
        if detector.name in out:
            warnings.warn(f"detector {detector.name!r} skipped: the name is taken", stacklevel=2)
            continue
        out[detector.name] = detector
    return list(out.values())


def _shaped(detector: Detector, context: Context) -> DataFrame:
    rows = detector.scan(context)
    missing = {*context.keys, *RISK_COLUMNS} - set(rows.columns)
    if missing:
        raise ValueError(f"columns {sorted(missing)} are missing")
    about = {name: name for name in risks.IDENTITY if name in rows.columns}
    return risks.risk_rows(rows, detector.name, F.col("severity"), F.col("message"), F.col("confidence"), context.keys, **about)


@dataclass
class Outcome:
    """What detectors have found: the union of their rows, the failures and, where parts were written, the
    number of rows, both by detector name."""

    rows: DataFrame | None = None
    failures: dict[str, str] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    def __iter__(self):  # noqa: ANN204
        return iter((self.rows, self.failures))


def run(detectors: Sequence[Detector], context: Context, workspace: Workspace | None = None) -> Outcome:
    """Rows and failures of all detectors; one that fails contributes nothing but a warning.

    Spark is lazy: building a plan catches errors of names, types and Python code alone. With a ``workspace``
    each detector writes its own part, once, so that one that fails on the data, even on its last row, is
    left out whole as well, and the rows of the others are read from their parts.
    """
    built_in = {d.name: d for d in BUILT_IN}
    fused = [d for d in detectors if d in BUILT_IN[:2]]
    jobs: list[tuple[str, Callable[[], DataFrame]]] = []
    if len(fused) == 2:
        # both read every line: one pass serves them
        jobs.append(("secrets, markers", lambda: _line_findings(context)))
        detectors = [d for d in detectors if d not in fused]
    jobs += [(d.name, lambda d=d: d.scan(context) if built_in.get(d.name) == d else _shaped(d, context)) for d in detectors]
    out = Outcome()
    for number, (name, build) in enumerate(jobs):
        try:
            rows = build()
            if workspace is not None:
                seen = Observation(f"rows of {name}")
                rows = workspace.table(f"risks-{number}", rows.observe(seen, F.count(F.lit(1)).alias("rows")))
                out.counts[name] = seen.get["rows"]
        except Exception as error:  # noqa: BLE001  one detector must not end the scan
            out.failures[name] = f"{type(error).__name__}: {error}"
            warnings.warn(f"detector {name!r} failed: {out.failures[name]}", stacklevel=2)
            if workspace is not None:
                workspace.drop(f"risks-{number}")
            continue
        out.rows = rows if out.rows is None else out.rows.unionByName(rows)
    return out


def describe(detectors: Sequence[Detector]) -> list[dict[str, Any]]:
    built = {d.name for d in BUILT_IN}
    return [
        {"name": d.name, "description": d.description, "source": "built-in" if d.name in built else "external"}
        for d in detectors
    ]
