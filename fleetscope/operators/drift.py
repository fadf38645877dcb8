"""Documentation drift: technologies, paths and environment keys that docs and code disagree on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import labels, paths
from fleetscope.functions.labels import quote_regex
from fleetscope.functions.moments import epoch_micros
from fleetscope.operators.history import recent_touches
from fleetscope.operators.packages import lookup

# Fixed values: (word in documentation, family, display name).
TECHNOLOGY_WORDS = [
    ("vue", "frontend", "Vue"),
    ("vue 2", "frontend", "Vue"),
    ("vue 3", "frontend", "Vue"),
    ("react", "frontend", "React"),
    ("angular", "frontend", "Angular"),
    ("svelte", "frontend", "Svelte"),
    ("next.js", "meta_framework", "Next.js"),
    ("nextjs", "meta_framework", "Next.js"),
    ("nuxt", "meta_framework", "Nuxt"),
    ("remix", "meta_framework", "Remix"),
    ("webpack", "bundler", "Webpack"),
    ("vite", "bundler", "Vite"),
    ("rollup", "bundler", "Rollup"),
    ("parcel", "bundler", "Parcel"),
    ("django", "python_web", "Django"),
    ("flask", "python_web", "Flask"),
    ("fastapi", "python_web", "FastAPI"),
    ("express", "node_web", "Express"),
    ("nestjs", "node_web", "NestJS"),
    ("spring boot", "java_web", "Spring Boot"),
    ("laravel", "php_web", "Laravel"),
    ("rails", "ruby_web", "Rails"),
    ("typescript", "language", "TypeScript"),
    ("javascript", "language", "JavaScript"),
    ("python", "language", "Python"),
    ("go", "language", "Go"),
    ("golang", "language", "Go"),
    ("rust", "language", "Rust"),
    ("java", "language", "Java"),
    ("kotlin", "language", "Kotlin"),
    ("php", "language", "PHP"),
    ("ruby", "language", "Ruby"),
]
# Fixed values: (dependency signal, family, display name).
STACK_SIGNALS = [
    ("react", "frontend", "React"),
    ("vue", "frontend", "Vue"),
    ("@angular/core", "frontend", "Angular"),
    ("angular", "frontend", "Angular"),
    ("svelte", "frontend", "Svelte"),
    ("next", "meta_framework", "Next.js"),
    ("nuxt", "meta_framework", "Nuxt"),
    ("@remix-run/node", "meta_framework", "Remix"),
    ("remix", "meta_framework", "Remix"),
    ("vite", "bundler", "Vite"),
    ("webpack", "bundler", "Webpack"),
    ("django", "python_web", "Django"),
    ("flask", "python_web", "Flask"),
    ("fastapi", "python_web", "FastAPI"),
    ("express", "node_web", "Express"),
    ("@nestjs/core", "node_web", "NestJS"),
    ("spring-boot", "java_web", "Spring Boot"),
    ("laravel/framework", "php_web", "Laravel"),
    ("rails", "ruby_web", "Rails"),
]
# Thresholds.
CATALOG_RIVALS = 2
CATALOG_MANIFESTS = 3
ACTIVE_GRACE_DAYS = 30
QUIET_GRACE_DAYS = 90
ACTIVE_COMMITS = 10
# Documentation and environment example files.
ROOT_DOCS = ["README.md", "CONTRIBUTING.md", ".cursorrules", "CLAUDE.md", "AGENTS.md"]
ENV_EXAMPLES = [".env.example", "env.example", ".env.sample", ".env.template"]

ITEM_COLUMNS = ["severity", "confidence", "kind", "source", "message"]


def keyword_hits(
    docs: DataFrame,
    text: str = "text",
    keep: Sequence[str] = ("repo", "source"),
    words: Sequence[tuple[str, str, str]] = TECHNOLOGY_WORDS,
) -> DataFrame:
    """Whole-word technology mentions, one row per (keep, family, display name), with the longest
    word that hit.

    The dictionary is literal: one alternation pass decides whether a text has any of the words, and
    only then the words are tested one by one, in the row and without a join.
    """
    longest_first = sorted(words, key=lambda w: len(w[0]), reverse=True)
    anyword = r"(?iU)\b(?:" + "|".join(quote_regex(w) for w, _, _ in longest_first) + r")\b"
    tests = [
        F.when(
            F.col(text).rlike(rf"(?iU)\b{quote_regex(word)}\b"),
            F.struct(
                F.lit(n).alias("n"), F.lit(word).alias("keyword"), F.lit(family).alias("family"), F.lit(name).alias("display")
            ),
        )
        for n, (word, family, name) in enumerate(longest_first)
    ]
    hits = (
        docs.filter(F.col(text).rlike(anyword))
        .select(*keep, F.explode(F.array_compact(F.array(*tests))).alias("__hit"))
        .select(*keep, "__hit.*")
    )
    return (
        hits.groupBy(*keep, "family", "display")
        .agg(F.min_by("keyword", "n").alias("keyword"))
    )


def signal_families(
    dependencies: DataFrame,
    keys: Sequence[str] = ("repo",),
    dependency: str = "dependency",
    signals: Sequence[tuple[str, str, str]] = STACK_SIGNALS,
) -> DataFrame:
    """Detected (family, display) by any dependency that contains a signal."""
    dep = F.lower(F.col(dependency))
    tests = [
        F.when(F.contains(dep, F.lit(signal)), F.struct(F.lit(family).alias("family"), F.lit(name).alias("display")))
        for signal, family, name in signals
    ]
    return (
        dependencies.select(*keys, F.explode(F.array_compact(F.array(*tests))).alias("__s"))
        .select(*keys, "__s.*")
        .distinct()
    )


def framework_families(frameworks: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Family of a detected framework: by its display name, else by a signal it contains or is part
    of, else ``frontend`` under its own name."""
    name = F.lower("framework")
    chain = F
    for _, family, display in STACK_SIGNALS:
        chain = chain.when(name == display.lower(), F.struct(F.lit(family).alias("family"), F.lit(display).alias("display")))
    for signal, family, display in STACK_SIGNALS:
        near = F.contains(name, F.lit(signal)) | F.contains(F.lit(signal), name)
        chain = chain.when(near, F.struct(F.lit(family).alias("family"), F.lit(display).alias("display")))
    other = F.struct(F.lit("frontend").alias("family"), F.col("framework").alias("display"))
    return frameworks.select(*keys, chain.otherwise(other).alias("__f")).select(*keys, "__f.*").distinct()


def detected_stack(
    dependencies: DataFrame,
    frameworks: DataFrame | None = None,
    languages: DataFrame | None = None,
    keys: Sequence[str] = ("repo",),
    dependency: str = "dependency",
    signals: Sequence[tuple[str, str, str]] = STACK_SIGNALS,
) -> DataFrame:
    """Every detected (family, display) per repository."""
    out = signal_families(dependencies, keys, dependency, signals)
    if frameworks is not None:
        out = out.unionByName(framework_families(frameworks, keys))
    if languages is not None:
        out = out.unionByName(
            languages.select(*keys, F.lit("language").alias("family"), F.col("language").alias("display"))
        )
    return out.distinct()


def catalog_families(
    hits: DataFrame, keys: Sequence[str] = ("repo", "source"), rivals: int = CATALOG_RIVALS
) -> DataFrame:
    """(source, family) pairs that name several rivals: a comparison or catalogue, not a claim."""
    return (
        hits.groupBy(*keys, "family")
        .agg(F.count_distinct(F.lower("display")).alias("__n"))
        .filter(F.col("__n") >= rivals)
        .drop("__n")
    )


def stack_conflicts(
    hits: DataFrame,
    detected: DataFrame,
    keys: Sequence[str] = ("repo",),
    source: str = "source",
    skip_catalogs: bool = True,
    rivals: int = CATALOG_RIVALS,
) -> DataFrame:
    """Documented technologies in families the project has, with ``conflict`` when none of the detected
    names equals, contains or is contained in the documented one.

    ``detected`` holds a handful of names per (repository, family) -- the signal table bounds it --
    so they travel as one array per family.
    """
    keys = list(keys)
    claims = hits
    if skip_catalogs:
        claims = hits.join(catalog_families(hits, [*keys, source], rivals), [*keys, source, "family"], "left_anti")
    known = detected.groupBy(*keys, "family").agg(F.array_sort(F.collect_set("display")).alias("detected"))
    claim = F.lower("display")
    agrees = F.exists(
        "detected", lambda d: F.contains(F.lower(d), claim) | F.contains(claim, F.lower(d))
    )
    return claims.join(known, [*keys, "family"]).select(
        *keys, source, "family", "display", "detected", (~agrees).alias("conflict")
    )


def stack_items(conflicts: DataFrame, keys: Sequence[str] = ("repo",), source: str = "source") -> DataFrame:
    named = F.array_join(F.transform("detected", lambda d: F.concat(F.lit('"'), d, F.lit('"'))), ", ")
    message = F.concat(
        F.col(source).cast("string"), F.lit(' references "'), F.col("display"), F.lit('" but project depends on '), named
    )
    return conflicts.filter("conflict").select(
        *keys,
        F.lit("warning").alias("severity"),
        F.lit("HIGH").alias("confidence"),
        F.lit("stack").alias("kind"),
        F.col(source).cast("string").alias("source"),
        message.alias("message"),
    )


def stack_ratio(conflicts: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """1 - conflicts / documented."""
    return conflicts.groupBy(*keys).agg(
        F.bround(1 - F.count_if("conflict") / F.count(F.lit(1)), 4).alias("stack_ratio")
    )


def reference_counts(
    references: DataFrame,
    keys: Sequence[str] = ("repo", "source"),
    raw: str = "raw",
    roots: Sequence[str] = paths.ROOT_SEGMENTS,
    check_form: bool = True,
) -> DataFrame:
    """Normalised references with their number of occurrences; counted before any join."""
    form = paths.path_like(F.col(raw), roots) if check_form else F.lit(True)
    clean = references.filter(form).select(*keys, paths.normalize_reference(F.col(raw)).alias("path"))
    return (
        clean.filter(F.col("path").isNotNull() & ~paths.optional_reference(F.col("path")))
        .groupBy(*keys, "path")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def existing_paths(files: DataFrame, repo: str = "repo", path: str = "path") -> DataFrame:
    """Files and every folder above them; folders repeat."""
    every = F.concat(paths.parent_folders(F.col(path)), F.array(paths.posix(F.col(path))))
    return files.select(repo, F.explode(every).alias("path"))


def checked_references(
    counted: DataFrame,
    existing: DataFrame,
    manifests: DataFrame | None = None,
    listed: DataFrame | None = None,
    repo: str = "repo",
    source: str = "source",
    catalog: int = CATALOG_MANIFESTS,
) -> DataFrame:
    """Adds ``valid``; drops the well-known file names of sources that list several missing ones.

    A path is valid when it exists or when its name is the name of a scanned manifest. ``listed`` are the
    references that make a list, also those in fences (default: ``counted``). The existing paths, which are many
    more than the referenced ones, are cut down to those before they are made distinct.
    """
    every = counted if listed is None else counted.withColumn("__own", F.lit(True)).unionByName(listed.withColumn("__own", F.lit(False)))
    asked = every.select(repo, "path").distinct()
    here = existing.select(repo, "path").join(asked, [repo, "path"], "left_semi").distinct().withColumn("__here", F.lit(True))
    joined = every.join(here, [repo, "path"], "left").withColumn("__name", F.lower(paths.basename(F.col("path"))))
    if manifests is None:
        valid = F.col("__here").isNotNull()
    else:
        names = manifests.select(repo, F.lower(paths.basename(F.col("path"))).alias("__name")).distinct()
        joined = joined.join(names.withColumn("__manifest", F.lit(True)), [repo, "__name"], "left")
        valid = F.col("__here").isNotNull() | F.col("__manifest").isNotNull()
    known_name = ~F.contains("path", F.lit("/")) & F.lower("path").isin(paths.KNOWN_FILENAMES)
    own = F.lit(True) if listed is None else F.col("__own")
    judged = joined.select(
        repo, source, "path", "occurrences", valid.alias("valid"), known_name.alias("__known"), own.alias("__own")
    )
    lists = (
        judged.filter(F.col("__known") & ~F.col("valid") & (F.lit(listed is None) | ~F.col("__own")))
        .groupBy(repo, source)
        .agg(F.sum("occurrences").alias("__n"))
        .filter(F.col("__n") >= catalog)
        .select(repo, source, F.lit(True).alias("__list"))
    )
    return judged.filter("__own").join(lists, [repo, source], "left").filter(
        ~(F.coalesce("__list", F.lit(False)) & F.col("__known"))
    ).drop("__known", "__list", "__own")


def path_ratio(checked: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Valid share of all occurrences."""
    valid = F.sum(F.when(F.col("valid"), F.col("occurrences")).otherwise(0))
    total = F.sum("occurrences")
    return checked.groupBy(*keys).agg(
        valid.alias("valid_refs"), total.alias("total_refs"), F.bround(valid / total, 4).alias("path_ratio")
    )


def path_items(checked: DataFrame, keys: Sequence[str] = ("repo",), source: str = "source") -> DataFrame:
    """One warning per missing (source, path)."""
    message = F.concat(
        F.col(source).cast("string"), F.lit(" references `"), F.col("path"),
        F.lit("` which no longer exists in the codebase"),
    )
    return checked.filter(~F.col("valid")).select(
        *keys,
        F.lit("warning").alias("severity"),
        F.lit("HIGH").alias("confidence"),
        F.lit("path").alias("kind"),
        F.col(source).cast("string").alias("source"),
        message.alias("message"),
    )


def env_gaps(
    defined: DataFrame, documented: DataFrame, keys: Sequence[str] = ("repo",), key: str = "key"
) -> DataFrame:
    """Every key of either side with ``gap`` = missing_in_docs / extra_in_docs / NULL.

    A repository that defines nothing is not compared.
    """
    keys = list(keys)
    d = defined.select(*keys, key).distinct().withColumn("__d", F.lit(True))
    m = documented.select(*keys, key).distinct().withColumn("__m", F.lit(True))
    m = m.join(d.select(*keys).distinct(), keys, "left_semi")
    gap = F.when(F.col("__m").isNull(), "missing_in_docs").when(F.col("__d").isNull(), "extra_in_docs")
    return d.join(m, [*keys, key], "full_outer").select(*keys, key, gap.alias("gap"))


def env_ratio(gaps: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    return gaps.groupBy(*keys).agg(
        F.count("gap").alias("gaps"),
        F.count(F.lit(1)).alias("keys"),
        F.bround(1 - F.count("gap") / F.count(F.lit(1)), 4).alias("env_ratio"),
    )


def env_example(files: DataFrame, repo: str = "repo", path: str = "path") -> DataFrame:
    """``repo, example``: the example file that findings are reported under, the first of the fixed order."""
    place = F.array_position(paths.literals(ENV_EXAMPLES), F.col(path))
    found = files.filter(F.col(path).isin(ENV_EXAMPLES))
    return found.groupBy(repo).agg(F.min_by(path, place).alias("example"))


def env_items(
    gaps: DataFrame, keys: Sequence[str] = ("repo",), key: str = "key", example: Column | None = None
) -> DataFrame:
    example = F.lit(ENV_EXAMPLES[0]) if example is None else example
    missing = F.col("gap") == "missing_in_docs"
    name = F.col(key).cast("string")
    message = F.when(
        missing,
        F.concat(F.lit("`.env.example` defines `"), name, F.lit("` but it is not documented in project docs")),
    ).otherwise(
        F.concat(F.lit("Documentation references env var `"), name, F.lit("` but it is missing from `.env.example`"))
    )
    return gaps.filter(F.col("gap").isNotNull()).select(
        *keys,
        F.when(missing, "warning").otherwise("info").alias("severity"),
        F.lit("MEDIUM").alias("confidence"),
        F.lit("env").alias("kind"),
        F.when(missing, example).otherwise("documentation").alias("source"),
        message.alias("message"),
    )


def drift_items(*items: DataFrame) -> DataFrame:
    out = items[0]
    for more in items[1:]:
        out = out.unionByName(more)
    return out


def recency(
    touches: DataFrame,
    is_doc: Column,
    keys: Sequence[str] = ("repo",),
    ts: str = "ts",
    commit: str = "hash",
    as_of: Column | None = None,
    active_days: float = ACTIVE_GRACE_DAYS,
    quiet_days: float = QUIET_GRACE_DAYS,
    active_commits: int = ACTIVE_COMMITS,
) -> DataFrame:
    """1 while the newest documentation touch is within the grace of the newest commit, then falling to
    0 over one more grace; repositories that are busy before ``as_of``, by default before their own newest
    commit, get the shorter grace. No documentation gives 1."""
    keys = list(keys)
    latest = touches.groupBy(*keys).agg(F.max(F.when(is_doc, F.col(ts))).alias("__doc"), F.max(ts).alias("__code"))
    busy = recent_touches(touches, int(active_days), ts, as_of, keys).groupBy(*keys).agg(F.count_distinct(commit).alias("__recent"))
    judged = latest.join(busy, keys, "left")
    grace = F.when(F.col("__recent") >= active_commits, F.lit(float(active_days))).otherwise(float(quiet_days))
    lag = F.greatest(F.lit(0.0), (epoch_micros(judged, "__code") - epoch_micros(judged, "__doc")) / 86_400_000_000)
    decayed = F.when(lag <= grace, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - (lag - grace) / grace))
    return judged.select(*keys, F.coalesce(F.bround(decayed, 4), F.lit(1.0)).alias("recency_ratio"))


def freshness(
    repos: DataFrame,
    path: DataFrame | None = None,
    stack: DataFrame | None = None,
    env: DataFrame | None = None,
    recent: DataFrame | None = None,
    keys: Sequence[str] = ("repo",),
) -> DataFrame:
    """Score and label per repository; a component without findings counts as 1."""
    keys = list(keys)
    out = repos.select(*keys).distinct()
    parts = {"path_ratio": path, "stack_ratio": stack, "env_ratio": env, "recency_ratio": recent}
    for name, part in parts.items():
        out = out.join(part.select(*keys, name), keys, "left") if part is not None else out.withColumn(name, F.lit(1.0))
    out = out.select(*keys, *[F.coalesce(name, F.lit(1.0)).alias(name) for name in parts])
    scored = out.withColumn("freshness_score", labels.freshness_score(*[F.col(name) for name in parts]))
    return scored.withColumn("freshness_label", labels.freshness_label(F.col("freshness_score")))


def documentation_name(path: Column) -> Column:
    """Canonical name of a documentation file, NULL for any other file."""
    root = lookup(F.lower(path), {name.lower(): name for name in ROOT_DOCS})
    nested = (path.startswith("docs/") & path.endswith(".md")) | (
        path.startswith(".cursor/rules/") & F.lower(path).endswith(".mdc")
    )
    return F.coalesce(root, F.when(nested & ~paths.ignored(path), path))


def documents(files: DataFrame, path: str = "path", content: str = "content", repo: str = "repo") -> DataFrame:
    """The documentation set of each repository as (repo, source, text)."""
    named = files.withColumn("source", documentation_name(F.col(path)))
    return named.filter(F.col("source").isNotNull()).select(repo, "source", F.col(content).alias("text"))
