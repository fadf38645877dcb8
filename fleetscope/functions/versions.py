"""Version specifications of eight package ecosystems.

Each ``*_spec`` returns ``struct<name, version, ecosystem, exact, spec>`` or NULL when the text pins
no comparable version.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscope.functions.text import let, strip

# Specifications that name no version.
UNVERSIONED = ["*", "latest", "x", "X"]
UNVERSIONED_PREFIX = r"(?i)^(?:workspace:|file:|link:|git\+|github:|npm:)"

SPEC_TYPE = "struct<name:string,version:string,ecosystem:string,exact:boolean,spec:string>"


def unversioned(spec: Column) -> Column:
    text = strip(spec)
    return (text == "") | text.isin(UNVERSIONED) | text.rlike(UNVERSIONED_PREFIX)


def bare_version(version: Column) -> Column:
    return F.regexp_replace(version, "^[vV]+", "")


def _spec(name: Column, version: Column, ecosystem: str, exact: Column, spec: Column) -> Column:
    return F.struct(
        name.alias("name"),
        version.alias("version"),
        F.lit(ecosystem).alias("ecosystem"),
        exact.alias("exact"),
        spec.alias("spec"),
    )


def _ranged(name: Column, spec: Column, ecosystem: str, operators: str) -> Column:
    """npm-like specs: a digit pins, one of ``operators`` opens a range, anything else is no version."""

    def parsed(text: Column) -> Column:
        opened = text.rlike(f"^(?:{operators})")
        version = bare_version(
            F.when(opened, strip(F.regexp_replace(text, f"^(?:{operators})", ""))).otherwise(text)
        )
        usable = ~unversioned(text) & (opened | text.rlike(r"(?U)^\d"))
        spec_of = let(version, lambda v: F.when(v != "", _spec(name, v, ecosystem, ~opened, text)))
        return F.when(usable, spec_of)

    return let(strip(spec), parsed)


def npm_spec(name: Column, spec: Column) -> Column:
    return let(_ranged(name, spec, "npm", r"\^|~|>=|>"), lambda p: F.when(~unversioned(p["version"]), p))


def packagist_spec(name: Column, spec: Column) -> Column:
    platform = F.lower(name).rlike("^(?:php$|ext-)")
    return F.when((name != "") & ~platform, _ranged(name, spec, "Packagist", r"\^|~|>="))


def pypi_name(requirement: Column) -> Column:
    return F.regexp_extract(strip(requirement), r"^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)", 1)


def pypi_spec(requirement: Column) -> Column:
    """One requirement line, name included."""

    def parsed(r: Column) -> Column:
        text, name = r["text"], r["name"]
        rest = strip(F.substring(text, F.length(name) + 1, F.length(text)))
        return let(rest, lambda tail: versioned(text, name, tail))

    def versioned(text: Column, name: Column, rest: Column) -> Column:
        version = bare_version(
            F.when(rest.startswith("="), F.regexp_extract(rest, r"(?U)^==?\s*([^\s,;]+)", 1))
            .when(rest.startswith(">="), F.regexp_extract(rest, r"(?U)^>=\s*([^\s,;]+)", 1))
            .otherwise(F.regexp_extract(rest, r"(?U)(?:==|>=|<=|>|<|!=|~=)\s*([^\s,;]+)", 1))
        )
        exact = rest.startswith("=")
        return let(version, lambda v: F.when((name != "") & (v != ""), _spec(name, v, "PyPI", exact, text)))

    return let(F.struct(strip(requirement).alias("text"), pypi_name(requirement).alias("name")), parsed)


def go_spec(name: Column, version: Column) -> Column:
    spec = F.concat_ws(" ", name, version)
    return let(
        bare_version(version),
        lambda v: F.when((name != "") & (v != "") & ~v.isin(UNVERSIONED), _spec(name, v, "Go", F.lit(True), spec)),
    )


def cargo_spec(name: Column, spec: Column) -> Column:
    """A version string, or an inline table holding one."""

    def parsed(text: Column) -> Column:
        inline = F.regexp_extract(text, r'version\s*=\s*"([^"]+)"', 1)
        quoted = F.regexp_replace(text, '^"+|"+$', "")
        version = bare_version(F.when(text.startswith("{"), inline).otherwise(quoted))
        return let(
            version,
            lambda v: F.when((name != "") & (v != ""), _spec(name, v, "crates.io", v.rlike(r"^\d+\.\d+\.\d+"), text)),
        )

    return F.when(spec != "", let(strip(spec), parsed))


def maven_spec(name: Column, version: Column) -> Column:
    """``name`` is ``group:artifact``, both parts given."""
    usable = name.rlike("(?s)^[^:]+:.+$") & ~version.startswith("${")
    spec = F.concat_ws(":", name, version)
    return F.when(
        usable, let(bare_version(strip(version)), lambda v: F.when(v != "", _spec(name, v, "Maven", F.lit(True), spec)))
    )


def gradle_spec(coordinate: Column) -> Column:
    """``group:artifact:version``; what follows a third colon is left out."""
    return let(
        F.split(coordinate, ":"),
        lambda p: F.when(F.size(p) >= 3, maven_spec(F.concat_ws(":", F.get(p, 0), F.get(p, 1)), F.get(p, 2))),
    )


def gem_spec(name: Column, version: Column) -> Column:
    spec = F.concat_ws(" ", name, version)
    bare = bare_version(F.regexp_replace(strip(version), "^['\"]+|['\"]+$", ""))
    return let(bare, lambda v: F.when((name != "") & (v != ""), _spec(name, v, "RubyGems", F.lit(True), spec)))


def package_spec(ecosystem: Column, name: Column, spec: Column) -> Column:
    """Dispatch on the ecosystem column. PyPI requirements carry the name in ``spec``, Gradle the
    whole coordinate; Maven names are ``group:artifact``."""

    def parsed(row: Column) -> Column:
        kind, who, text = row["e"], row["n"], row["s"]
        return (
            F.when(kind == "npm", npm_spec(who, text))
            .when(kind == "PyPI", pypi_spec(text))
            .when(kind == "Go", go_spec(who, text))
            .when(kind == "crates.io", cargo_spec(who, text))
            .when(kind == "Packagist", packagist_spec(who, text))
            .when(kind == "Maven", maven_spec(who, text))
            .when(kind == "Gradle", gradle_spec(text))
            .when(kind == "RubyGems", gem_spec(who, text))
        )

    return let(F.struct(ecosystem.alias("e"), name.alias("n"), spec.alias("s")), parsed)
