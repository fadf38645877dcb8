"""Packages, their conflicts, their advisories, and what they say about the stack."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions import advisories as adv
from fleetscope.functions import paths
from fleetscope.functions.version_order import version_key
from fleetscope.operators.ordered import FEW_SALTS, join_groups

# Manifests and their languages.
MANIFEST_LANGUAGES = {
    "package.json": "JavaScript/TypeScript",
    "requirements.txt": "Python",
    "poetry.lock": "Python",
    "pyproject.toml": "Python",
    "go.mod": "Go",
    "Cargo.toml": "Rust",
    "pom.xml": "Java",
    "build.gradle": "Java",
    "build.gradle.kts": "Kotlin",
    "composer.json": "PHP",
    "Gemfile": "Ruby",
}
# Files that give a framework away.
FRAMEWORK_FILES = {
    "next.config.js": "Next.js",
    "next.config.mjs": "Next.js",
    "manage.py": "Django",
    "nuxt.config.js": "Nuxt.js",
    "nuxt.config.ts": "Nuxt.js",
    "vite.config.js": "Vite",
    "vite.config.ts": "Vite",
    "angular.json": "Angular",
    "svelte.config.js": "Svelte",
    "remix.config.js": "Remix",
    "artisan": "Laravel",
}
# Dependency signals of frameworks.
FRAMEWORK_SIGNALS = [
    ("react", "React"),
    ("next", "Next.js"),
    ("vue", "Vue"),
    ("@angular/core", "Angular"),
    ("svelte", "Svelte"),
    ("express", "Express"),
    ("@nestjs/core", "NestJS"),
    ("@remix-run/node", "Remix"),
    ("django", "Django"),
    ("djangorestframework", "Django REST Framework"),
    ("fastapi", "FastAPI"),
    ("flask", "Flask"),
    ("gin-gonic/gin", "Gin"),
    ("labstack/echo", "Echo"),
    ("gofiber/fiber", "Fiber"),
    ("actix-web", "Actix Web"),
    ("axum", "Axum"),
    ("rocket", "Rocket"),
    ("spring-boot", "Spring Boot"),
    ("quarkus", "Quarkus"),
    ("micronaut", "Micronaut"),
    ("laravel/framework", "Laravel"),
    ("symfony/framework-bundle", "Symfony"),
    ("slim/slim", "Slim"),
    ("rails", "Rails"),
    ("sinatra", "Sinatra"),
]
LONG_SIGNAL = 7


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value of a fixed table, NULL for other keys; folds into the projection, no join."""
    out = None
    for name, value in table.items():
        out = (F if out is None else out).when(key == name, F.lit(value))
    return out


def distinct_packages(
    packages: DataFrame,
    keys: Sequence[str] = ("repo", "ecosystem", "name", "version"),
    first_by: Sequence[str] = ("manifest", "spec"),
    carry: Sequence[str] = ("exact", "spec"),
) -> DataFrame:
    """One row per package version, from its first manifest."""
    first = F.min_by(F.struct(*carry), F.struct(*first_by))
    return packages.groupBy(*keys).agg(first.alias("__first")).select(*keys, "__first.*")


def dependency_conflicts(
    requirements: DataFrame,
    keys: Sequence[str] = ("repo", "manifest"),
    package: str = "package",
    spec: str = "spec",
) -> DataFrame:
    """Packages that one manifest asks for in several ways, with the sorted specifications.

    Copies are removed before anything is collected, and only conflicting packages are.
    """
    named = requirements.select(*keys, F.lower(F.col(package)).alias("package"), F.col(spec).alias("spec"))
    return (
        named.distinct()
        .groupBy(*keys, "package")
        .agg(F.array_sort(F.collect_list("spec")).alias("versions"))
        .filter(F.size("versions") > 1)
    )


def shared_dependencies(
    packages: DataFrame,
    keys: Sequence[str] = ("ecosystem", "name"),
    version: str = "version",
) -> DataFrame:
    """Packages with two or more occurrences; several versions make a mismatch.

    Occurrences are counted, not listed: a popular package occurs in a large part of the fleet.
    :func:`shared_occurrences` gives the list as rows.
    """
    return (
        packages.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("occurrences"),
            F.count_distinct(version).alias("versions"),
        )
        .filter(F.col("occurrences") >= 2)
        .withColumn("kind", F.when(F.col("versions") > 1, "mismatch").otherwise("duplicate"))
    )


def mismatch_first(shared: DataFrame, package: str = "name") -> DataFrame:
    return shared.orderBy(F.when(F.col("kind") == "mismatch", 0).otherwise(1), F.asc(package))


def shared_occurrences(
    packages: DataFrame,
    keys: Sequence[str] = ("ecosystem", "name"),
    service: str = "repo",
    version: str = "version",
) -> DataFrame:
    """Every occurrence of a shared package with the package's kind."""
    kinds = shared_dependencies(packages, keys, version).select(*keys, "kind")
    return join_groups(packages, kinds, keys, F.col(service)).select(*keys, "kind", service, version)


def _package_key(ecosystem: Column, name: Column) -> Column:
    """The name under which an ecosystem knows a package."""
    return F.when(ecosystem == "PyPI", F.lower(F.regexp_replace(name, "[-_.]+", "-"))).otherwise(name)


def versions_in_ranges(versions: DataFrame, ranges: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """``keys, version`` and the other columns of ``ranges`` for every version within a range: an interval join
    that makes no pair that does not match.

    ``versions`` are distinct and have a sort key ``key``; ``ranges`` have ``lo``, ``hi`` and ``closed`` (see
    :func:`fleetscope.functions.advisories.affected_intervals`). The versions of a package and the ends of its ranges
    are sorted together, which turns each end into a number of versions before it and a range into a
    span of numbers, and the span's numbers meet the versions by equality.
    """
    keys = list(keys)
    carried = [c for c in ranges.columns if c not in keys]
    # At one version: what starts or ends before it, the version itself, what ends after it.
    ends = F.array(
        F.struct(F.lit("first").alias("end"), F.col("lo").alias("key"), F.lit(0).alias("kind")),
        F.struct(F.lit("last").alias("end"), F.col("hi").alias("key"), F.when(F.col("closed"), 2).otherwise(0).alias("kind")),
    )
    ranged = F.struct(*[F.col(f"`{c}`") for c in carried])
    bounds = ranges.select(*keys, ranged.alias("range"), F.explode(ends).alias("e")).select(
        *keys, "range", F.col("e.end").alias("end"), F.col("e.key").alias("key"), F.col("e.kind").alias("kind"), F.lit(None).cast("string").alias(version)
    )
    kind = bounds.schema["range"].dataType
    points = versions.filter("key IS NOT NULL").select(
        *keys, F.lit(None).cast(kind).alias("range"), F.lit(None).cast("string").alias("end"), "key", F.lit(1).alias("kind"), version
    )
    order = Window.partitionBy(*keys).orderBy(F.col("key").asc_nulls_last(), "kind", version)
    before = F.count(version).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = points.unionByName(bounds).withColumn("place", before)
    spans = placed.filter("end IS NOT NULL").groupBy(*keys, "range").agg(
        (F.max(F.when(F.col("end") == "first", F.col("place"))) + 1).alias("first"), F.max(F.when(F.col("end") == "last", F.col("place"))).alias("last")
    )
    inside = spans.filter("first <= last").select(*keys, "range", F.explode(F.sequence("first", "last")).alias("place"))
    # Asked for the range as well, so that both sides have the same columns and read one shuffle.
    found = placed.filter("end IS NULL AND range IS NULL").select(*keys, "place", version)
    return inside.join(found, [*keys, "place"]).select(*keys, version, "range.*")


def match_advisories(
    packages: DataFrame,
    advisories: DataFrame,
    repo: str = "repo",
) -> DataFrame:
    """Packages that an advisory lists by version or that lie in one of its ranges.

    ``advisories`` is OSV shaped (:data:`fleetscope.functions.advisories.OSV_SCHEMA`). Ranges are compared by
    the order of the ecosystem; Python package names in their normal form. The distinct versions of a
    package meet its advisories, and only those that are affected meet the packages again, dealt over
    sub-keys, so that a version that a large part of the fleet uses is joined in many tasks.
    """
    keys = ["ecosystem", "__package"]
    found = ["advisory", "severity", "fixed_in", "summary"]
    affected = advisories.select("*", F.explode("affected").alias("__hit"))
    named = affected.select(
        F.col("__hit.package.ecosystem").alias("ecosystem"),
        _package_key(F.col("__hit.package.ecosystem"), F.col("__hit.package.name")).alias("__package"),
        F.col("__hit.versions").alias("versions"),
        F.col("__hit.ranges").alias("ranges"),
        adv.resolved_id(F.col("id"), F.col("aliases")).alias("advisory"),
        adv.severity(F.col("severity"), F.col("database_specific.severity")).alias("severity"),
        adv.fixed_version(F.col("affected"), F.col("__hit.package.name")).alias("fixed_in"),
        adv.summary(F.col("summary"), F.col("details")).alias("summary"),
    ).filter("ecosystem IS NOT NULL AND __package IS NOT NULL")
    used = packages.select(repo, "ecosystem", "name", "version", "exact", _package_key(F.col("ecosystem"), F.col("name")).alias("__package"))
    seen = used.select(*keys, "version").filter("version IS NOT NULL").distinct()
    # Made by a generator, so that no filter on the key is moved below the distinct and reads every row's version.
    key = F.struct(version_key(F.col("ecosystem"), F.col("version")).alias("key"))
    keyed = seen.select("*", F.inline_outer(F.array(key)))
    ranges = named.select(*keys, *found, F.inline(adv.affected_intervals(F.col("ecosystem"), F.col("ranges")))).distinct()
    ranged = versions_in_ranges(keyed, ranges, keys).select(*keys, "version", *found)
    listed = named.select(*keys, F.explode(F.array_distinct("versions")).alias("version"), *found)
    hits = ranged.unionByName(listed.join(seen, [*keys, "version"], "left_semi")).distinct()
    return dedupe_vulnerabilities(join_groups(used, hits, [*keys, "version"], F.col(repo), FEW_SALTS), repo)


def dedupe_vulnerabilities(found: DataFrame, repo: str = "repo") -> DataFrame:
    """One finding per (repository, advisory, package), from the smallest version string; HIGH when
    that package version was pinned exactly."""
    first = F.min_by(F.struct("exact", "severity", "fixed_in", "summary"), F.struct("version", "exact"))
    return (
        found.groupBy(repo, "advisory", "name")
        .agg(first.alias("__f"))
        .select(
            repo,
            F.col("advisory").alias("id"),
            F.col("name").alias("package"),
            "__f.severity",
            "__f.fixed_in",
            "__f.summary",
            F.when(F.col("__f.exact"), "HIGH").otherwise("MEDIUM").alias("confidence"),
        )
    )


def signal_matches(dependency: Column, signal: str) -> Column:
    """Equal; or contained, if the dependency is a path or coordinate, or the signal has a dash or is long."""
    dep, sig = F.lower(dependency), signal.lower()
    inside = F.contains(dep, F.lit(sig))
    if "-" in sig or len(sig) >= LONG_SIGNAL:
        return inside
    return (dep == sig) | (dep.rlike("[/:]") & inside)


def dependency_frameworks(
    dependencies: DataFrame,
    keys: Sequence[str] = ("repo",),
    dependency: str = "dependency",
    rules: Sequence[tuple[str, str]] = FRAMEWORK_SIGNALS,
) -> DataFrame:
    """Frameworks implied by dependency names. The rules are literals tested in the row."""
    tests = [F.when(signal_matches(F.col(dependency), signal), F.lit(name)) for signal, name in rules]
    return (
        dependencies.select(*keys, dependency)
        .distinct()
        .select(*keys, F.explode(F.array_compact(F.array(*tests))).alias("framework"))
        .distinct()
    )


def file_frameworks(
    files: DataFrame,
    keys: Sequence[str] = ("repo",),
    path: str = "path",
    table: Mapping[str, str] = FRAMEWORK_FILES,
) -> DataFrame:
    named = files.select(*keys, lookup(paths.basename(F.col(path)), table).alias("framework"))
    return named.filter(F.col("framework").isNotNull()).distinct()


def frameworks(
    dependencies: DataFrame,
    files: DataFrame | None = None,
    keys: Sequence[str] = ("repo",),
    dependency: str = "dependency",
    rules: Sequence[tuple[str, str]] = FRAMEWORK_SIGNALS,
) -> DataFrame:
    found = dependency_frameworks(dependencies, keys, dependency, rules)
    return found if files is None else found.unionByName(file_frameworks(files, keys)).distinct()


def languages(
    files: DataFrame,
    keys: Sequence[str] = ("repo",),
    name: Column | None = None,
    table: Mapping[str, str] = MANIFEST_LANGUAGES,
) -> DataFrame:
    """Distinct languages by manifest name."""
    named = paths.basename(F.col("path")) if name is None else name
    found = files.select(*keys, lookup(named, table).alias("language"))
    return found.filter(F.col("language").isNotNull()).distinct()


def stack_summary(
    repos: DataFrame,
    languages_of: DataFrame,
    frameworks_of: DataFrame,
    dependencies: DataFrame,
    keys: Sequence[str] = ("repo",),
    dependency: str = "dependency",
) -> DataFrame:
    """One row per repository: sorted languages and frameworks (both bounded by their tables) and the
    number of distinct dependencies, which stay rows. ``is_empty``: none of the three."""
    keys = list(keys)
    none = F.array().cast("array<string>")
    langs = languages_of.groupBy(*keys).agg(F.array_sort(F.collect_set("language")).alias("languages"))
    works = frameworks_of.groupBy(*keys).agg(F.array_sort(F.collect_set("framework")).alias("frameworks"))
    deps = dependencies.groupBy(*keys).agg(F.count_distinct(dependency).alias("dependencies"))
    joined = repos.select(*keys).distinct()
    for part in (langs, works, deps):
        joined = joined.join(part, keys, "left")
    return joined.select(
        *keys,
        F.coalesce("languages", none).alias("languages"),
        F.coalesce("frameworks", none).alias("frameworks"),
        F.coalesce("dependencies", F.lit(0)).alias("dependencies"),
        (F.col("languages").isNull() & F.col("frameworks").isNull() & F.col("dependencies").isNull()).alias("is_empty"),
    )
