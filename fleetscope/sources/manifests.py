"""Package manifests to dependency rows.

All line, JSON, XML and Gradle formats are expressions: one pass over the files builds the entries of
each manifest in its row, whatever its format. Only TOML needs a parser from outside Spark; those two
file names go through one ``mapInPandas`` over the standard library's reader.
"""

from __future__ import annotations

import sys
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import documents, paths, versions
from fleetscope.functions.text import let, lines, strip

ENTRY = "array<struct<ecosystem:string,dependency:string,name:string,spec:string>>"

# Line formats.
REQUIREMENT_NAME = "^([A-Za-z0-9][A-Za-z0-9._-]*)"
REQUIREMENT_CONFLICT = r"(?U)^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(.*)$"
REQUIREMENT_OPTIONS = "^(?:#|-r|--requirement|-e|--editable)"
GO_BLOCK = r"(?msU)^\s*require \(\s*$(.*?)(?:^\s*\)\s*$|\z)"
GO_ENTRY = r"(?U)^(\S+)\s+(\S+)"
GEM = r"(?U)^gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?"
GRADLE = (
    r"(?U)(?:implementation|api|compile|compileOnly|runtimeOnly)\s*(?:\(\s*)?['\"]([^'\"]+)['\"]"
)
XML_COMMENT = r"(?s)<!--.*?-->"
XML_EXCLUSIONS = r"(?s)<(?:[\w.-]+:)?exclusions\b.*?</(?:[\w.-]+:)?exclusions\s*>"
XML_DEPENDENCY = r"(?s)<(?:[\w.-]+:)?dependency(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?dependency\s*>"

JSON_SECTIONS = {
    "package.json": ("npm", ["dependencies", "devDependencies"]),
    "composer.json": ("Packagist", ["require", "require-dev"]),
}
TOML_FILES = ["Cargo.toml", "pyproject.toml"]

# The TOML helper travels to the workers by value, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _entry(ecosystem: str, dependency: Column, name: Column, spec: Column) -> Column:
    return F.struct(
        F.lit(ecosystem).alias("ecosystem"),
        dependency.alias("dependency"),
        name.alias("name"),
        spec.alias("spec"),
    )


def _stripped_lines(text: Column) -> Column:
    return F.filter(F.transform(lines(text), strip), lambda row: row != "")


def json_entries(content: Column, ecosystem: str, sections: list[str]) -> Column:
    """Every key of the sections is a dependency; only string values carry a specification."""

    def of(section: str) -> Column:
        return F.transform(
            documents.members(content, section),
            lambda e: _entry(ecosystem, e["key"], e["key"], F.when(e["is_string"], e["text"])),
        )

    listed = F.concat(*[of(section) for section in sections])
    return F.when(documents.malformed_json(content), F.array().cast(ENTRY)).otherwise(listed)


def requirements_entries(content: Column) -> Column:
    kept = F.filter(_stripped_lines(content), lambda row: ~row.rlike(REQUIREMENT_OPTIONS))
    entries = F.transform(
        kept,
        lambda row: _entry(
            "PyPI",
            F.coalesce(
                let(versions.pypi_spec(row), lambda p: p["name"]),
                F.nullif(F.regexp_extract(row, REQUIREMENT_NAME, 1), F.lit("")),
            ),
            F.lit(""),
            row,
        ),
    )
    return F.filter(entries, lambda e: e["dependency"].isNotNull())


def go_entries(content: Column) -> Column:
    """Requirements inside ``require (...)`` blocks and on single ``require`` lines, indirect ones left out."""
    block_text = F.array_join(F.regexp_extract_all(content, F.lit(GO_BLOCK), F.lit(1)), "\n")
    outside = F.filter(
        _stripped_lines(F.regexp_replace(content, GO_BLOCK, "")), lambda row: row.startswith("require ")
    )
    single = F.transform(outside, lambda row: strip(F.regexp_replace(row, "^require ", "")))
    inside = F.filter(_stripped_lines(block_text), lambda row: ~row.rlike(r"(?U)^(?://|module\s|go\s)"))
    rows = F.filter(
        F.concat(inside, single), lambda row: ~row.contains("// indirect") & row.rlike(GO_ENTRY)
    )

    def entry(row: Column) -> Column:
        name = F.regexp_extract(row, GO_ENTRY, 1)
        return _entry("Go", name, name, F.regexp_extract(row, GO_ENTRY, 2))

    return F.transform(rows, entry)


def gemfile_entries(content: Column) -> Column:
    gems = F.filter(_stripped_lines(content), lambda row: row.rlike(GEM))

    def entry(row: Column) -> Column:
        name = F.regexp_extract(row, GEM, 1)
        return _entry("RubyGems", name, name, F.nullif(F.regexp_extract(row, GEM, 2), F.lit("")))

    return F.transform(gems, entry)


def gradle_entries(content: Column) -> Column:
    found = F.regexp_extract_all(content, F.lit(GRADLE), F.lit(1))
    return F.transform(found, lambda c: _entry("Gradle", c, F.lit(""), c))


def xml_malformed(content: Column) -> Column:
    parsed = F.from_xml(
        content, "_bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    return parsed["_bad"].isNotNull() | (strip(content) == "")


def pom_entries(content: Column) -> Column:
    """Every ``dependency`` element at any depth and under any namespace prefix."""
    clean = F.regexp_replace(F.regexp_replace(content, XML_COMMENT, ""), XML_EXCLUSIONS, "")
    blocks = F.regexp_extract_all(clean, F.lit(XML_DEPENDENCY), F.lit(1))

    def tag(block: Column, name: str) -> Column:
        return strip(F.regexp_extract(block, rf"(?s)<(?:[\w.-]+:)?{name}(?:\s[^>]*)?>([^<]*)<", 1))

    entries = F.transform(
        blocks,
        lambda b: _entry(
            "Maven",
            tag(b, "artifactId"),
            F.concat_ws(":", tag(b, "groupId"), tag(b, "artifactId")),
            F.nullif(tag(b, "version"), F.lit("")),
        ),
    )
    named = F.filter(entries, lambda e: e["dependency"] != "")
    return F.when(~xml_malformed(content), named).otherwise(F.array().cast(ENTRY))


def _poetry_requirement(name: str, version: object) -> str | None:
    if isinstance(version, dict):
        version = version.get("version")
    if not isinstance(version, str):
        return None
    return f"{name}>={version[1:]}" if version[:1] in ("^", "~") else f"{name}{version}"


def _toml_table(document: dict, *names: str) -> dict:
    for name in names:
        document = document.get(name) if isinstance(document, dict) else None
    return document if isinstance(document, dict) else {}


def _toml_entries(file: str, document: dict) -> list[tuple[str, str, str, str | None]]:
    """(ecosystem, dependency, name, spec) of one parsed manifest."""
    rows: list[tuple[str, str, str, str | None]] = []
    if file == "Cargo.toml":
        for section in ("dependencies", "dev-dependencies"):
            for name, value in _toml_table(document, section).items():
                version = value.get("version") if isinstance(value, dict) else value
                rows.append(("crates.io", name, name, str(version) if isinstance(value, (str, dict)) and version is not None else None))
        return rows
    project = _toml_table(document, "project")
    groups = [project.get("dependencies"), *_toml_table(project, "optional-dependencies").values()]
    for group in groups:
        rows.extend(("PyPI", str(item), "", str(item)) for item in (group if isinstance(group, list) else []))
    for name, value in _toml_table(document, "tool", "poetry", "dependencies").items():
        if name.lower() != "python":
            rows.append(("PyPI", name, "", _poetry_requirement(name, value)))
    return rows


def _read_toml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        entries, malformed = [], []
        for name, content in zip(batch["__name"], batch["content"]):
            try:
                rows = _toml_entries(name, tomllib.loads(content if content is not None else "\0"))
                malformed.append(False)
            except tomllib.TOMLDecodeError:
                rows = []
                malformed.append(True)
            entries.append([dict(zip(("ecosystem", "dependency", "name", "spec"), row)) for row in rows])
        yield batch.drop(columns=["content", "__name"]).assign(malformed=malformed, entries=entries)


def read_manifests(files: DataFrame, repo: str = "repo", path: str = "path", content: str = "content") -> DataFrame:
    """``repo, manifest, malformed, entries`` of every manifest file."""
    name = paths.basename(F.col(path))
    text = F.col(content)
    npm, packagist = JSON_SECTIONS["package.json"], JSON_SECTIONS["composer.json"]
    entries = (
        F.when(name == "package.json", json_entries(text, *npm))
        .when(name == "composer.json", json_entries(text, *packagist))
        .when(name == "requirements.txt", requirements_entries(text))
        .when(name == "go.mod", go_entries(text))
        .when(name == "Gemfile", gemfile_entries(text))
        .when(name.isin("build.gradle", "build.gradle.kts"), gradle_entries(text))
        .when(name == "pom.xml", pom_entries(text))
        .when(name == "poetry.lock", F.array().cast(ENTRY))
    )
    malformed = F.when(name.isin(list(JSON_SECTIONS)), documents.malformed_json(text)).otherwise(
        (name == "pom.xml") & xml_malformed(text)
    )
    plain_names = [
        "package.json", "requirements.txt", "poetry.lock", "go.mod", "pom.xml", "build.gradle",
        "build.gradle.kts", "composer.json", "Gemfile",
    ]
    plain = files.filter(name.isin(plain_names)).select(
        repo, F.col(path).alias("manifest"), malformed.alias("malformed"), entries.alias("entries")
    )
    toml = files.filter(name.isin(TOML_FILES)).select(
        repo, F.col(path).alias("manifest"), text.alias("content"), name.alias("__name")
    )
    key_type = files.schema[repo].dataType.simpleString()
    parsed = toml.mapInPandas(_read_toml, f"{repo} {key_type}, manifest string, malformed boolean, entries {ENTRY}")
    return plain.unionByName(parsed)


def _listed(manifests: DataFrame, columns: list[str], structs: Column) -> DataFrame:
    """One row per struct of a list. The outer generator has no test for empty lists added to it, which would
    parse every manifest once more, and where the file is read."""
    marked = F.transform(structs, lambda s: F.struct(s.alias("s"), F.lit(True).alias("__there")))
    return manifests.select(*columns, F.inline_outer(marked)).filter("__there").select(*columns, "s.*")


def dependencies(manifests: DataFrame, repo: str = "repo") -> DataFrame:
    """Distinct dependency names per repository."""
    names = F.transform("entries", lambda e: F.struct(e["dependency"].alias("dependency")))
    return _listed(manifests, [repo], names).distinct()


def packages(manifests: DataFrame, repo: str = "repo") -> DataFrame:
    """Every versioned entry: ``repo, manifest, name, version, ecosystem, exact, spec``."""
    parsed = F.transform(
        F.filter("entries", lambda e: e["spec"].isNotNull()),
        lambda e: versions.package_spec(e["ecosystem"], e["name"], e["spec"]),
    )
    return _listed(manifests, [repo, "manifest"], F.filter(parsed, lambda p: p.isNotNull()))


def go_metadata(files: DataFrame, repo: str = "repo", path: str = "path", content: str = "content") -> DataFrame:
    """Module name and language version of Go manifests."""
    return files.filter(paths.basename(F.col(path)) == "go.mod").select(
        repo,
        F.col(path).alias("manifest"),
        F.nullif(F.regexp_extract(content, r"(?mU)^\s*module\s+(\S+)", 1), F.lit("")).alias("module"),
        F.nullif(F.regexp_extract(content, r"(?mU)^\s*go\s+(\S+)", 1), F.lit("")).alias("go_version"),
    )


def manifest_errors(manifests: DataFrame, repo: str = "repo") -> DataFrame:
    """A warning per malformed manifest; the others are read regardless."""
    name = paths.basename(F.col("manifest"))
    message = F.concat(F.lit("Malformed manifest: "), F.col("manifest"), F.lit(" (Could not parse "), name, F.lit(")"))
    return manifests.filter("malformed").select(repo, "manifest", message.alias("message"))


def conflict_requirements(files: DataFrame, repo: str = "repo", path: str = "path", content: str = "content") -> DataFrame:
    """``repo, manifest, package, spec`` of the root manifests that are checked for conflicts.

    Unlike packages, any text after the name counts as a specification, ``*`` if there is none.
    """
    npm = json_entries(F.col(content), *JSON_SECTIONS["package.json"])
    from_json = files.filter(F.col(path) == "package.json").select(
        repo, F.col(path).alias("manifest"), F.explode(npm).alias("__e")
    ).filter(F.col("__e.spec").isNotNull()).select(
        repo, "manifest", F.col("__e.name").alias("package"), F.col("__e.spec").alias("spec")
    )
    kept = F.filter(
        _stripped_lines(F.col(content)), lambda row: ~row.rlike(REQUIREMENT_OPTIONS) & row.rlike(REQUIREMENT_CONFLICT)
    )
    rest = strip(F.regexp_extract("__l", REQUIREMENT_CONFLICT, 2))
    from_text = (
        files.filter(F.col(path) == "requirements.txt")
        .select(repo, F.col(path).alias("manifest"), F.explode(kept).alias("__l"))
        .select(
            repo, "manifest", F.regexp_extract("__l", REQUIREMENT_CONFLICT, 1).alias("package"),
            F.coalesce(F.nullif(rest, F.lit("")), F.lit("*")).alias("spec"),
        )
    )
    return from_json.unionByName(from_text)
