"""Manifest parsing and version specifications over texts derived from parts: every part is a manifest
whose format follows from its key and whose versions follow from its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import versions
from fleetscope.operators.ordered import FEW_DEALT, deal
from fleetscope.plans.catalog.base import Registry, Tables
from fleetscope.sources import manifests

QUERIES = Registry()

# file name -> content; {k} is the part key, {s} its size
TEMPLATES = [
    (
        "package.json",
        '{"dependencies": {"old{k}": "9"}, "dependencies": {"d{k}": "^0.1", "e{k}": 5, "d{k}": "^1.{s}.0"}, "name": "n", "name": "m", '
        '"devDependencies": {"w{k}": "workspace:*", "x{k}": "2.{s}"}}',
    ),
    ("composer.json", '{"require": {"php": ">=8", "a/d{k}": "~1.{s}"}, "require-dev": [], "require-dev": {"a/x{k}": 3, "a/x{k}": "2.{s}"}}'),
    ("requirements.txt", "# all\n-r base.txt\nd{k}==1.{s}\n\nx{k}[y]>=2.{s};python\nplain{k}\n"),
    ("go.mod", "module m{k}\n\ngo 1.22\nrequire one/d{k} v1.{s}.0\nrequire (\n\ttwo/x{k} v2.{s}.0\n\t// note\n\tthree/i v1 // indirect\n)\n"),
    ("Gemfile", "gem 'd{k}', '~> 1.{s}'\n  gem \"plain{k}\"\n# gem 'z'\n"),
    ("build.gradle", "implementation 'g:d{k}:1.{s}'\nruntimeOnly(\"g:x{k}\")\ncompileOnly (\"g:y{k}:v2.{s}\")\n"),
    (
        "pom.xml",
        '<project xmlns="http://maven.example/4"><dependencies><dependency><groupId>g</groupId><artifactId> d{k} </artifactId>'
        "<version>1.{s}</version><exclusions><exclusion><artifactId>no</artifactId></exclusion></exclusions></dependency></dependencies>"
        "<!-- <dependency><artifactId>old</artifactId></dependency> --><profile><dependency><groupId>g</groupId><artifactId>x{k}</artifactId>"
        "<version>${v}</version></dependency></profile></project>",
    ),
    ("Cargo.toml", '[package]\nname = "c"\nversion = "9.9.9"\n[dependencies]\nd{k} = "1.{s}.0"\nx{k} = { version = "1.{s}", features = ["f"] }\n[dev-dependencies]\ny{k} = { path = "../y" }\n'),
    ("pyproject.toml", '[project]\ndependencies = ["d{k}>=1.{s}"]\n[project.optional-dependencies]\ndev = ["o{k}==3.{s}"]\n[tool.poetry.dependencies]\npython = "^3.11"\nx{k} = "^2.{s}"\n'),
    ("poetry.lock", "[[package]]\nname = \"d{k}\"\n"),
]
BROKEN = {"package.json": '{"dependencies": {"d', "composer.json": '{"require": ', "pom.xml": "<project><a></project>", "Cargo.toml": "[dependencies\n", "pyproject.toml": "[project"}


def files(t: Tables) -> DataFrame:
    """``repo, path, content``; parts of sizes 11, 22, 33 and 44 are broken where the format can be.

    Parts are dealt first: a part is a few bytes, its manifest takes far longer to make and to parse."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    kind = F.col("p_partkey") % len(TEMPLATES)
    content: Column | None = None
    name: Column | None = None
    for n, (file, template) in enumerate(TEMPLATES):
        text = F.replace(F.replace(F.lit(template), F.lit("{k}"), key), F.lit("{s}"), size)
        if file in BROKEN:
            text = F.when(F.col("p_size") % 11 == 0, F.lit(BROKEN[file])).otherwise(text)
        content = (F if content is None else content).when(kind == n, text)
        name = (F if name is None else name).when(kind == n, F.lit(file))
    parts = deal(t("part").select("p_partkey", "p_size", "p_brand"), ["p_partkey"], FEW_DEALT)
    return parts.select(
        F.col("p_brand").alias("repo"), F.concat(F.lit("m"), key, F.lit("/"), name).alias("path"), content.alias("content")
    )


#: parts(repo, manifest, kind, k, s, broken)
PARTS = """
names AS (SELECT unnest(range(10)) AS kind, unnest(['package.json','composer.json','requirements.txt','go.mod','Gemfile','build.gradle','pom.xml','Cargo.toml','pyproject.toml','poetry.lock']) AS file),
parts AS (
    SELECT p_brand AS repo, 'm' || p_partkey || '/' || file AS manifest, kind, file, CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS s,
           p_size % 11 = 0 AND kind IN (0, 1, 6, 7, 8) AS broken
    FROM part JOIN names ON p_partkey % 10 = kind)
"""


@QUERIES.query("manifest_packages", f"""
WITH {PARTS},
rows AS (
    SELECT repo, manifest, broken, unnest(CASE kind
        WHEN 0 THEN [{{'name': 'd' || k, 'version': '1.' || s || '.0', 'ecosystem': 'npm', 'exact': false, 'spec': '^1.' || s || '.0'}},
                     {{'name': 'x' || k, 'version': '2.' || s, 'ecosystem': 'npm', 'exact': true, 'spec': '2.' || s}}]
        WHEN 1 THEN [{{'name': 'a/d' || k, 'version': '1.' || s, 'ecosystem': 'Packagist', 'exact': false, 'spec': '~1.' || s}},
                     {{'name': 'a/x' || k, 'version': '2.' || s, 'ecosystem': 'Packagist', 'exact': true, 'spec': '2.' || s}}]
        WHEN 2 THEN [{{'name': 'd' || k, 'version': '1.' || s, 'ecosystem': 'PyPI', 'exact': true, 'spec': 'd' || k || '==1.' || s}},
                     {{'name': 'x' || k, 'version': '2.' || s, 'ecosystem': 'PyPI', 'exact': false, 'spec': 'x' || k || '[y]>=2.' || s || ';python'}}]
        WHEN 3 THEN [{{'name': 'one/d' || k, 'version': '1.' || s || '.0', 'ecosystem': 'Go', 'exact': true, 'spec': 'one/d' || k || ' v1.' || s || '.0'}},
                     {{'name': 'two/x' || k, 'version': '2.' || s || '.0', 'ecosystem': 'Go', 'exact': true, 'spec': 'two/x' || k || ' v2.' || s || '.0'}}]
        WHEN 4 THEN [{{'name': 'd' || k, 'version': '~> 1.' || s, 'ecosystem': 'RubyGems', 'exact': true, 'spec': 'd' || k || ' ~> 1.' || s}}]
        WHEN 5 THEN [{{'name': 'g:d' || k, 'version': '1.' || s, 'ecosystem': 'Maven', 'exact': true, 'spec': 'g:d' || k || ':1.' || s}},
                     {{'name': 'g:y' || k, 'version': '2.' || s, 'ecosystem': 'Maven', 'exact': true, 'spec': 'g:y' || k || ':v2.' || s}}]
        WHEN 6 THEN [{{'name': 'g:d' || k, 'version': '1.' || s, 'ecosystem': 'Maven', 'exact': true, 'spec': 'g:d' || k || ':1.' || s}}]
        WHEN 7 THEN [{{'name': 'd' || k, 'version': '1.' || s || '.0', 'ecosystem': 'crates.io', 'exact': true, 'spec': '1.' || s || '.0'}},
                     {{'name': 'x' || k, 'version': '1.' || s, 'ecosystem': 'crates.io', 'exact': false, 'spec': '1.' || s}}]
        WHEN 8 THEN [{{'name': 'd' || k, 'version': '1.' || s, 'ecosystem': 'PyPI', 'exact': false, 'spec': 'd' || k || '>=1.' || s}},
                     {{'name': 'o' || k, 'version': '3.' || s, 'ecosystem': 'PyPI', 'exact': true, 'spec': 'o' || k || '==3.' || s}},
                     {{'name': 'x' || k, 'version': '2.' || s, 'ecosystem': 'PyPI', 'exact': false, 'spec': 'x' || k || '>=2.' || s}}]
        END) AS p FROM parts)
SELECT repo, manifest, p.name, p.version, p.ecosystem, p.exact, p.spec FROM rows WHERE NOT broken""")
def manifest_packages(t: Tables) -> DataFrame:
    return manifests.packages(manifests.read_manifests(files(t)))


@QUERIES.query("manifest_dependencies", f"""
WITH {PARTS},
rows AS (
    SELECT repo, broken, unnest(CASE kind
        WHEN 0 THEN ['d' || k, 'e' || k, 'w' || k, 'x' || k] WHEN 1 THEN ['php', 'a/d' || k, 'a/x' || k]
        WHEN 2 THEN ['d' || k, 'x' || k, 'plain' || k] WHEN 3 THEN ['one/d' || k, 'two/x' || k] WHEN 4 THEN ['d' || k, 'plain' || k]
        WHEN 5 THEN ['g:d' || k || ':1.' || s, 'g:x' || k, 'g:y' || k || ':v2.' || s] WHEN 6 THEN ['d' || k, 'x' || k]
        WHEN 7 THEN ['d' || k, 'x' || k, 'y' || k] WHEN 8 THEN ['d' || k || '>=1.' || s, 'o' || k || '==3.' || s, 'x' || k] END) AS dependency
    FROM parts)
SELECT DISTINCT repo, dependency FROM rows WHERE NOT broken""")
def manifest_dependencies(t: Tables) -> DataFrame:
    return manifests.dependencies(manifests.read_manifests(files(t)))


@QUERIES.query("manifest_errors", f"""
WITH {PARTS} SELECT repo, manifest, 'Malformed manifest: ' || manifest || ' (Could not parse ' || file || ')' AS message FROM parts WHERE broken""")
def manifest_errors(t: Tables) -> DataFrame:
    return manifests.manifest_errors(manifests.read_manifests(files(t)))


@QUERIES.query("go_modules", f"WITH {PARTS} SELECT repo, manifest, 'm' || k AS module, '1.22' AS go_version FROM parts WHERE kind = 3")
def go_modules(t: Tables) -> DataFrame:
    return manifests.go_metadata(files(t))


# ecosystem, name, specification, expected version and exactness; {s} is the part's size
SPECS = [
    ("npm", "n", "^1.{s}.0", "1.{s}.0", False),
    ("npm", "n", " ~v1.{s} ", "1.{s}", False),
    ("npm", "n", ">= 1.{s}", "1.{s}", False),
    ("npm", "n", "1.{s}", "1.{s}", True),
    ("npm", "n", "git+https://x/{s}", None, None),
    ("npm", "n", "<2.{s}", None, None),
    ("PyPI", "", "pkg==1.{s}", "1.{s}", True),
    ("PyPI", "", "pkg >= v1.{s}, <2", "1.{s}", False),
    ("PyPI", "", "pkg!=1.{s}", "1.{s}", False),
    ("PyPI", "", "pkg", None, None),
    ("Go", "x/y", "v1.{s}.0", "1.{s}.0", True),
    ("Go", "x/y", "latest", None, None),
    ("crates.io", "c", "\"1.{s}.7\"", "1.{s}.7", True),
    ("crates.io", "c", "{ path = \"x\", version = \"1.{s}\" }", "1.{s}", False),
    ("Packagist", "a/b", "^1.{s}", "1.{s}", False),
    ("Packagist", "ext-x", "1.{s}", None, None),
    ("Packagist", "a/b", "1.{s}", "1.{s}", True),
    ("Maven", "g:a", "1.{s}", "1.{s}", True),
    ("Maven", "g:a", "${v.{s}}", None, None),
    ("Gradle", "", "g:a:V1.{s}", "1.{s}", True),
    ("Gradle", "", "g:a", None, None),
    ("RubyGems", "r", "'1.{s}'", "1.{s}", True),
]


def _sql_text(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


SPEC_ROWS = ", ".join(
    f"({n}, {_sql_text(eco)}, {_sql_text(spec)}, {_sql_text(version)}, {'NULL' if exact is None else str(exact).lower()})"
    for n, (eco, _, spec, version, exact) in enumerate(SPECS)
)


@QUERIES.query("version_specs", f"""
WITH styles(style, ecosystem, spec, version, exact) AS (VALUES {SPEC_ROWS})
SELECT p_partkey, ecosystem, replace(spec, '{{s}}', CAST(p_size AS VARCHAR)) AS spec,
       coalesce(replace(version, '{{s}}', CAST(p_size AS VARCHAR)), 'none') AS version, coalesce(exact, false) AS exact
FROM part JOIN styles ON p_partkey % {len(SPECS)} = style""")
def version_specs(t: Tables) -> DataFrame:
    """Specification styles of all ecosystems, one per part."""
    style, size = F.col("p_partkey") % len(SPECS), F.col("p_size").cast("string")
    fields: dict[str, Column | None] = {"ecosystem": None, "name": None, "spec": None}
    for n, values in enumerate(SPECS):
        for field, value in zip(fields, values):
            text = F.replace(F.lit(value), F.lit("{s}"), size)
            fields[field] = (F if fields[field] is None else fields[field]).when(style == n, text)
    rows = t("part").select("p_partkey", *[column.alias(field) for field, column in fields.items()])
    parsed = versions.package_spec(F.col("ecosystem"), F.col("name"), F.col("spec"))
    shown = rows.select("p_partkey", "ecosystem", "spec", F.explode(F.array(parsed)).alias("p"))
    return shown.select(
        "p_partkey", "ecosystem", "spec", F.coalesce("p.version", F.lit("none")).alias("version"), F.coalesce("p.exact", F.lit(False)).alias("exact")
    )
