"""The whole scan: fact tables of a fleet in, every report table out, as one lazy plan per table.

Inputs (all with a leading ``repo`` column):

``files``       repo, path, size, content                        (:mod:`fleetscope.sources.files`)
``commits``     repo, hash, author, email, ts, date, subject, message
``touches``     repo, hash, ts, path                             one row per (commit, file)
``blame``       repo, path, line_no, author, sha
``advisories``  OSV records, optional
``changed``     repo, path, optional: restricts the scan to a change set
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import paths
from fleetscope.operators import drift, fleet, history, lines, ownership, packages, risks, scope, tokens
from fleetscope.plans import detectors
from fleetscope.plans.facts import content_facts
from fleetscope.session import Workspace
from fleetscope.sources import files as file_source
from fleetscope.sources import manifests, sinks

REPO = ["repo"]


@dataclass(frozen=True)
class Facts:
    files: DataFrame
    commits: DataFrame
    touches: DataFrame
    blame: DataFrame | None = None
    advisories: DataFrame | None = None
    changed: DataFrame | None = None


@dataclass
class Scan:
    """Report tables of a fleet. Every attribute is a DataFrame that is only computed when used.

    With a ``workspace`` contents are read once: what is read off them, the visible files, the manifests and the
    risks are kept as tables, from which counts, status, checklist and payload are made, until it is closed.
    """

    facts: Facts
    settings: detectors.Settings = detectors.Settings()
    external: Iterable[detectors.Detector] = ()
    disabled: Iterable[str] = ()
    as_of: Column | None = None
    workspace: Workspace | None = None

    # facts ------------------------------------------------------------------------------------------

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        return df if self.workspace is None else self.workspace.table(name, df)

    @cached_property
    def content_facts(self) -> DataFrame:
        """The one pass over the contents; everything below reads its narrow rows."""
        return self._kept("facts", content_facts(self.facts.files, self.settings))

    @cached_property
    def all_files(self) -> DataFrame:
        """A row per file, with the content of the small files that are read further."""
        return self.content_facts.filter("line_no = 0").drop("line_no", "kind", "marker", "confidence")

    # scope ------------------------------------------------------------------------------------------

    @cached_property
    def repos(self) -> DataFrame:
        return self.all_files.select("repo").union(self.facts.commits.select("repo")).distinct()

    @cached_property
    def visible(self) -> DataFrame:
        """Files that no ignore rule hides."""
        rules = scope.ignore_rules(self.all_files)
        return self._kept("visible", scope.drop_ignored(self.all_files, rules=rules))

    @cached_property
    def scanned(self) -> DataFrame:
        """Visible files within the change set, if there is one."""
        return self.visible if self.facts.changed is None else scope.changed_only(self.visible, self.facts.changed)

    @cached_property
    def scope_counts(self) -> DataFrame:
        return scope.scope_counts(self.all_files.select("repo", "path"), self.facts.changed)

    @cached_property
    def context_files(self) -> DataFrame:
        return file_source.context_files(self.all_files)

    @cached_property
    def findings(self) -> DataFrame:
        """Markers and secrets of the scanned text files."""
        names = self.scanned.filter("is_text").select("repo", "path")
        found = self.content_facts.filter("kind IS NOT NULL").select("repo", "path", "line_no", "kind", "marker", "confidence")
        return found.join(names, ["repo", "path"], "left_semi")

    # stack ------------------------------------------------------------------------------------------

    @cached_property
    def manifests(self) -> DataFrame:
        return self._kept("manifests", manifests.read_manifests(self.scanned))

    @cached_property
    def packages(self) -> DataFrame:
        return packages.distinct_packages(manifests.packages(self.manifests))

    @cached_property
    def dependencies(self) -> DataFrame:
        return manifests.dependencies(self.manifests)

    @cached_property
    def languages(self) -> DataFrame:
        return packages.languages(self.scanned)

    @cached_property
    def frameworks(self) -> DataFrame:
        return packages.frameworks(self.dependencies, self.scanned)

    @cached_property
    def stack(self) -> DataFrame:
        return packages.stack_summary(self.repos, self.languages, self.frameworks, self.dependencies)

    @cached_property
    def vulnerabilities(self) -> DataFrame | None:
        if self.facts.advisories is None:
            return None
        return self._kept("vulnerabilities", packages.match_advisories(self.packages, self.facts.advisories))

    # history ----------------------------------------------------------------------------------------

    @cached_property
    def timeline(self) -> DataFrame:
        return history.timeline(self.facts.commits)

    @cached_property
    def churn(self) -> DataFrame:
        return history.churn(self.facts.touches, as_of=self.as_of)

    @cached_property
    def hotspots(self) -> DataFrame:
        return history.hotspots(self.churn, k=self.settings.max_hotspots)

    @cached_property
    def ownership(self) -> DataFrame | None:
        """One row per module; None without blame."""
        if self.facts.blame is None:
            return None
        keys = ["repo", "module"]
        wanted = self.visible.select("repo", "path").filter(paths.eligible_source(F.col("path")))
        owned = self.facts.blame.join(wanted, ["repo", "path"], "left_semi")
        counts = ownership.line_counts(owned.withColumn("module", paths.module_key(F.col("path"))), keys)
        tagged = ownership.tag_commits(self.facts.commits.withColumnRenamed("hash", "sha"))
        signed = self.visible.filter("signed")
        return ownership.module_ownership(
            ownership.top_contributors(ownership.shares(ownership.owned_lines(counts, keys), keys), keys),
            ownership.ai_lines(counts, tagged, keys, inline_files=signed),
            history.module_churn(self.facts.touches, eligible=wanted, as_of=self.as_of),
            ownership.module_tools(counts, tagged, keys),
            ownership.module_bursts(counts, tagged, keys),
            keys,
        )

    # documentation ----------------------------------------------------------------------------------

    @cached_property
    def docs(self) -> DataFrame:
        return drift.documents(self.visible)

    @cached_property
    def _paths_checked(self) -> DataFrame:
        counted, listed = (drift.reference_counts(lines.path_references(self.docs, skip_fenced=skip)) for skip in (True, False))
        names = list(packages.MANIFEST_LANGUAGES)
        found = self.scanned.filter(paths.basename(F.col("path")).isin(names)).select("repo", "path")
        return drift.checked_references(counted, drift.existing_paths(self.all_files), found, listed)

    @cached_property
    def _stack_checked(self) -> DataFrame:
        detected = drift.detected_stack(self.dependencies, self.frameworks, self.languages)
        return drift.stack_conflicts(drift.keyword_hits(self.docs), detected)

    @cached_property
    def _env_gaps(self) -> DataFrame:
        examples = self.all_files.filter(F.col("path").isin(drift.ENV_EXAMPLES))
        return drift.env_gaps(lines.env_definitions(examples, "content"), lines.env_references(self.docs))

    @cached_property
    def drift(self) -> DataFrame:
        return drift.drift_items(
            drift.path_items(self._paths_checked), drift.stack_items(self._stack_checked), drift.env_items(
                self._env_gaps.join(drift.env_example(self.all_files), "repo"), example=F.col("example")
            )
        )

    @cached_property
    def freshness(self) -> DataFrame:
        is_doc = drift.documentation_name(F.col("path")).isNotNull()
        documented = self.docs.select("repo").distinct()
        recent = drift.recency(self.facts.touches, is_doc, as_of=self.as_of)
        return drift.freshness(
            self.repos,
            drift.path_ratio(self._paths_checked),
            drift.stack_ratio(self._stack_checked),
            drift.env_ratio(self._env_gaps).join(documented, "repo", "left_semi"),
            recent.join(documented, "repo", "left_semi"),
        )

    # risks ------------------------------------------------------------------------------------------

    @cached_property
    def _detected(self) -> detectors.Outcome:
        tables = {
            "files": scope.text_files(self.facts.files.join(self.scanned.select("repo", "path"), ["repo", "path"], "left_semi")),
            "findings": self.findings,
            "requirements": manifests.conflict_requirements(self.scanned),
            "touches": self.facts.touches,
            "commits": self.facts.commits,
            "dependencies": self.dependencies,
            "frameworks": self.frameworks,
        }
        context = detectors.Context(tables, self.settings)
        built_in = [
            detectors.Detector(d.name, d.description, self._missing_tests) if d.name == "missing-tests" else d
            for d in detectors.BUILT_IN
        ]
        return detectors.run(detectors.resolve(self.external, self.disabled, built_in), context, self.workspace)

    def _missing_tests(self, context: detectors.Context) -> DataFrame:
        """Over all files of a repository: the folder counts even where nothing in it is scanned."""
        return risks.missing_tests_risks(risks.missing_tests(self.all_files))

    @property
    def failures(self) -> dict[str, str]:
        return self._detected.failures

    @cached_property
    def all_risks(self) -> DataFrame:
        """Risks of all sources and confidences; with a workspace the table that everything below reads."""
        parts = [risks.manifest_risks(manifests.manifest_errors(self.manifests))]
        if self._detected.rows is not None:
            parts.insert(0, self._detected.rows)
        if self.vulnerabilities is not None:
            parts.append(risks.vulnerability_risks(self.vulnerabilities))
        else:
            parts.append(risks.skipped_check_risks(self.repos))
        return self._kept("risks", risks.risk_map(parts, "low"))

    @cached_property
    def risks(self) -> DataFrame:
        return risks.risk_map([self.all_risks], self.settings.min_confidence)

    @cached_property
    def risk_counts(self) -> DataFrame:
        """Every repository, also those without risks."""
        return self.repos.join(risks.risk_counts(self.risks), "repo", "left").na.fill(0, [*risks.SEVERITIES, "total"])

    @cached_property
    def status(self) -> DataFrame:
        return risks.risk_status(self.risk_counts)

    @cached_property
    def checklist(self) -> DataFrame:
        return risks.checklist(
            self.repos, self.risks, self.vulnerabilities, self.frameworks, self.hotspots, self.drift,
            minimum=self.settings.min_confidence, incremental=self.facts.changed is not None, workspace=self.workspace,
        )

    # volumes and fleet ------------------------------------------------------------------------------

    @cached_property
    def tokens(self) -> DataFrame:
        return tokens.corpus_tokens(self.scanned.filter("tokens IS NOT NULL"), estimate=F.col("tokens"))

    @cached_property
    def hotspot_matrix(self) -> DataFrame:
        return history.hotspot_matrix(self.churn)

    @cached_property
    def unified_risks(self) -> DataFrame:
        return risks.unified_risks(self.risks, self.vulnerabilities)

    @cached_property
    def unified_checklist(self) -> DataFrame:
        return risks.unified_checklist(self.checklist)

    @cached_property
    def shared_dependencies(self) -> DataFrame:
        return packages.shared_dependencies(self.packages)

    @cached_property
    def tiers(self) -> DataFrame:
        signals = fleet.infra_signals(self.all_files).groupBy("repo").agg(F.array_sort(F.collect_set("signal")).alias("signals"))
        none = F.array().cast("array<string>")
        services = self.stack.select("repo", "frameworks").join(signals, "repo", "left")
        return fleet.service_tiers(services.withColumn("signals", F.coalesce("signals", none)))

    @cached_property
    def architecture(self) -> DataFrame:
        return fleet.architecture_line(self.tiers.withColumn("system", F.lit("fleet")))

    #: sections of the payload and the tables they hold
    SECTIONS = (
        "risks", "hotspots", "timeline", "checklist", "drift", "freshness", "stack", "dependencies", "packages",
        "risk_counts", "ownership",
    )

    def payload(self, sections: Iterable[str] = SECTIONS, per_part: int = sinks.ITEMS_PER_PART) -> DataFrame:
        """The chosen tables as JSON documents per repository and section."""
        tables = {name: getattr(self, name) for name in sections}
        return sinks.report_payload({n: df for n, df in tables.items() if df is not None}, per_part=per_part)
