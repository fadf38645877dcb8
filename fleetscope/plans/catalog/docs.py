"""Documentation drift in its whole form, change scopes, and the unions of all risk sources and steps.

Every document is a documentation file of its source, whose text follows from its language and length, and a
file of the same source.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.operators import drift, lines, packages, risks, scope
from fleetscope.plans.catalog import commerce, manifests, risk, stream
from fleetscope.plans.catalog.base import Registry, Tables
from fleetscope.session import Workspace
from fleetscope.sources import gitlog
from fleetscope.sources import manifests as manifest_source

QUERIES = Registry()

#: By a document's key: its text, the references in it that no fence hides, and the paths that come of them with their
#: number. {l} is the language, {n} a digit.
TEXTS = [
    (
        "See `src/app/{l}.ts` and [guide](docs/{l}.md#top).\n```\n`src/inside/x.ts`\n```\nafter src/lib/m{n}.py end",
        ["src/app/{l}.ts", "src/app/{l}.ts", "docs/{l}.md#top", "docs/{l}.md", "src/lib/m{n}.py"],
        [("src/app/{l}.ts", 2), ("docs/{l}.md", 2), ("src/lib/m{n}.py", 1)],
    ),
    (
        "```py\n`src/first.py`\n```\nmid `lib/a{n}.js`\n```\nopen `src/open/{l}.js`",
        ["lib/a{n}.js", "lib/a{n}.js", "src/open/{l}.js", "src/open/{l}.js"], [("lib/a{n}.js", 2), ("src/open/{l}.js", 2)],
    ),
    (
        "Reads `package.json`, `go.mod`, `Cargo.toml`, `pom.xml` and `Gemfile`.", ["package.json", "go.mod", "Cargo.toml", "pom.xml", "Gemfile"],
        [("package.json", 1), ("go.mod", 1), ("Cargo.toml", 1), ("pom.xml", 1), ("Gemfile", 1)],
    ),
    (
        "Words: `{l}`, `two words`, `config`, `--flag`, `run()`, `https://x.org/a.md`, `README.md`",
        ["{l}", "two words", "config", "--flag", "run()", "https://x.org/a.md", "README.md"], [("README.md", 1)],
    ),
    (
        "Skip `.fleetscope/x.json`, `mcp.json`, ![i](assets/i.png) and [o](https://a.b/c.md), see `docs`",
        [".fleetscope/x.json", "mcp.json", "assets/i.png", "assets/i.png", "https://a.b/c.md", "docs"], [],
    ),
    ("Uses ./docs/{l}.md, `src/app/` and `requirements.txt`.", ["./docs/{l}.md", "src/app/", "src/app/", "requirements.txt"], [("docs/{l}.md", 1), ("src/app", 2), ("requirements.txt", 1)]),
    ("```\n`go.mod` `pom.xml`\n```\n`Gemfile` and `Cargo.toml`, `src/{l}.py`", ["Gemfile", "Cargo.toml", "src/{l}.py", "src/{l}.py"], [("src/{l}.py", 2)]),
]


def _filled(template: str) -> Column:
    text = F.replace(F.lit(template), F.lit("{l}"), F.col("lang"))
    return F.replace(text, F.lit("{n}"), (F.col("n_chars") % 7).cast("string"))


def docs(t: Tables) -> DataFrame:
    """``repo, source, text``."""
    kind, text = F.col("doc_id") % len(TEXTS), None
    for n, (template, _, _) in enumerate(TEXTS):
        text = (F if text is None else text).when(kind == n, _filled(template))
    name = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return t("documents").select(F.col("source").alias("repo"), name.alias("source"), text.alias("text"))


def files(t: Tables) -> DataFrame:
    """``repo, path``: sources, guides, and manifests in a folder."""
    kind = F.col("n_chars") % 3
    manifest = F.when(F.col("lang") == "de", "sub/requirements.txt").when(F.col("lang") == "fr", "sub/package.json").otherwise("sub/x.txt")
    path = F.when(kind == 0, F.concat(F.lit("src/app/"), "lang", F.lit(".ts"))).when(kind == 1, F.concat(F.lit("docs/"), "lang", F.lit(".md"))).otherwise(manifest)
    return t("documents").select(F.col("source").alias("repo"), path.alias("path")).distinct()


def _sql_filled(template: str) -> str:
    text = template.replace("'", "''")
    return f"replace(replace('{text}', '{{l}}', lang), '{{n}}', CAST(n_chars % 7 AS VARCHAR))"


_RAWS = " ".join(f"WHEN {n} THEN [{', '.join(map(_sql_filled, raws))}]" for n, (_, raws, _) in enumerate(TEXTS))
_PATHS = " ".join(
    f"WHEN {n} THEN [" + ", ".join(f"{{'path': {_sql_filled(path)}, 'n': {count}}}" for path, count in found) + "]"
    for n, (_, _, found) in enumerate(TEXTS) if found
)
#: doc_paths(repo, source, path, occurrences), checked_paths(the same, valid)
DOC_PATHS = f"""
doc_lists AS (SELECT source AS repo, 'docs/' || doc_id || '.md' AS source, unnest(CASE doc_id % {len(TEXTS)} {_PATHS} ELSE [] END) AS p FROM documents),
doc_paths AS (SELECT repo, source, p.path AS path, CAST(p.n AS BIGINT) AS occurrences FROM doc_lists),
held AS (
    SELECT DISTINCT source AS repo, CASE n_chars % 3 WHEN 0 THEN 'src/app/' || lang || '.ts' WHEN 1 THEN 'docs/' || lang || '.md'
           ELSE 'sub/' || CASE lang WHEN 'de' THEN 'requirements.txt' WHEN 'fr' THEN 'package.json' ELSE 'x.txt' END END AS path FROM documents),
held_names AS (SELECT repo, path FROM held UNION SELECT repo, 'src/app' FROM held WHERE path LIKE 'src/app/%'),
manifest_names AS (SELECT repo, substr(path, 5) AS name FROM held WHERE path IN ('sub/requirements.txt', 'sub/package.json')),
judged AS (
    SELECT d.*, EXISTS (SELECT 1 FROM held_names h WHERE h.repo = d.repo AND h.path = d.path) OR EXISTS (SELECT 1 FROM manifest_names m WHERE m.repo = d.repo AND m.name = d.path) AS valid
    FROM doc_paths d),
missing_names AS (
    SELECT repo, source FROM judged WHERE NOT valid AND path IN ('package.json', 'go.mod', 'Cargo.toml', 'pom.xml', 'Gemfile', 'README.md', 'requirements.txt')
    GROUP BY ALL HAVING sum(occurrences) >= 3),
checked_paths AS (
    SELECT j.* FROM judged j LEFT JOIN missing_names m ON m.repo = j.repo AND m.source = j.source
    WHERE m.repo IS NULL OR path NOT IN ('package.json', 'go.mod', 'Cargo.toml', 'pom.xml', 'Gemfile', 'README.md', 'requirements.txt'))
"""


@QUERIES.query("doc_references", f"""
SELECT source AS repo, 'docs/' || doc_id || '.md' AS source, unnest(CASE doc_id % {len(TEXTS)} {_RAWS} END) AS raw FROM documents""")
def doc_references(t: Tables) -> DataFrame:
    """All ways that prose names a path, outside paired fences."""
    return lines.path_references(docs(t))


def checked(t: Tables) -> DataFrame:
    counted, listed = (drift.reference_counts(lines.path_references(docs(t), skip_fenced=skip)) for skip in (True, False))
    found = files(t)
    named = found.filter(F.substring_index("path", "/", -1).isin(list(packages.MANIFEST_LANGUAGES)))
    return drift.checked_references(counted, drift.existing_paths(found), named, listed)


@QUERIES.query("doc_paths", f"WITH {DOC_PATHS} SELECT * FROM checked_paths")
def doc_paths(t: Tables) -> DataFrame:
    return checked(t)


@QUERIES.query("doc_drift", f"""
WITH {DOC_PATHS}
SELECT repo, CAST(coalesce(sum(occurrences) FILTER (valid), 0) AS BIGINT) AS valid_refs, CAST(sum(occurrences) AS BIGINT) AS total_refs,
       round_even(coalesce(sum(occurrences) FILTER (valid), 0) / sum(occurrences), 4) AS path_ratio
FROM checked_paths GROUP BY repo""")
def doc_drift(t: Tables) -> DataFrame:
    return drift.path_ratio(checked(t))


#: claims(repo, source, family, display, detected, conflict) of parts, catalogues left out
_STACK = """
stack_words AS (
    SELECT unnest(['ring','bolt','widget','rod','red','blue','small','large']) AS w,
           unnest(['shape','shape','shape','shape','colour','colour','size','size']) AS family,
           unnest(['Ring','Bolt','Widget','Rod','Red','Blue','Small','Large']) AS display),
stack_claims AS (SELECT p_brand AS repo, p_partkey AS source, family, display FROM part JOIN stack_words ON list_contains(string_split(p_name, ' '), w)),
stack_lists AS (SELECT repo, source, family FROM stack_claims GROUP BY ALL HAVING count(DISTINCT display) >= 3),
stack_known AS (
    SELECT repo, family, list(display ORDER BY display) AS detected FROM (
        SELECT DISTINCT p_brand AS repo, family, display FROM part JOIN stack_words ON contains(p_name, w) WHERE p_size <= 2) GROUP BY ALL),
stack_judged AS (
    SELECT c.repo, c.source, c.family, c.display, k.detected, NOT list_contains(k.detected, c.display) AS conflict
    FROM stack_claims c JOIN stack_known k ON k.repo = c.repo AND k.family = c.family
    LEFT JOIN stack_lists l ON l.repo = c.repo AND l.source = c.source AND l.family = c.family WHERE l.repo IS NULL)
"""


def claims(t: Tables) -> DataFrame:
    named = t("part").select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("source"), F.col("p_name").alias("text"))
    small = t("part").filter("p_size <= 2").select(F.col("p_brand").alias("repo"), F.col("p_name").alias("dependency"))
    return drift.stack_conflicts(drift.keyword_hits(named, words=commerce.WORDS), drift.detected_stack(small, signals=commerce.WORDS))


@QUERIES.query("stack_ratio", f"""
WITH {_STACK} SELECT repo, round_even(1 - count(*) FILTER (conflict) / count(*), 4) AS stack_ratio FROM stack_judged GROUP BY repo""")
def stack_ratio(t: Tables) -> DataFrame:
    return drift.stack_ratio(claims(t))


def drift_rows(t: Tables) -> DataFrame:
    """Items of all three kinds; the example file of a user depends on the user."""
    gaps = stream.gaps(t).withColumn("example", F.when(F.col("repo") % 2 == 0, ".env.sample").otherwise(".env.example")).withColumn("repo", F.col("repo").cast("string"))
    return drift.drift_items(drift.path_items(checked(t)), drift.stack_items(claims(t)), drift.env_items(gaps, example=F.col("example")))


_ITEMS = f"""
{DOC_PATHS}, {_STACK}, {stream.GAPS},
items AS (
    SELECT repo, 'warning' AS severity, 'HIGH' AS confidence, 'path' AS kind, source, source || ' references `' || path || '` which no longer exists in the codebase' AS message
    FROM checked_paths WHERE NOT valid
    UNION ALL
    SELECT repo, 'warning', 'HIGH', 'stack', CAST(source AS VARCHAR),
           source || ' references "' || display || '" but project depends on ' || array_to_string(list_transform(detected, lambda d: '"' || d || '"'), ', ')
    FROM stack_judged WHERE conflict
    UNION ALL
    SELECT CAST(repo AS VARCHAR), CASE gap WHEN 'missing_in_docs' THEN 'warning' ELSE 'info' END, 'MEDIUM', 'env',
           CASE gap WHEN 'missing_in_docs' THEN CASE WHEN repo % 2 = 0 THEN '.env.sample' ELSE '.env.example' END ELSE 'documentation' END,
           CASE gap WHEN 'missing_in_docs' THEN '`.env.example` defines `' || key || '` but it is not documented in project docs'
                ELSE 'Documentation references env var `' || key || '` but it is missing from `.env.example`' END
    FROM gaps WHERE gap IS NOT NULL)
"""


@QUERIES.query("drift_report", f"WITH {_ITEMS} SELECT * FROM items")
def drift_report(t: Tables) -> DataFrame:
    return drift_rows(t)


@QUERIES.query("diff_scope", """
WITH named AS (
    SELECT source AS repo, 'k' || (n_chars % 60) || '/' || doc_id AS path, lang = 'fr' OR n_chars % 5 = 0 AS changed FROM documents)
SELECT repo, count(*) FILTER (changed) AS files_scanned, count(*) AS files_total FROM named GROUP BY repo""")
def diff_scope(t: Tables) -> DataFrame:
    """Changed paths as a version-control tool lists them, with blank lines, repeats, back slashes and files that are
    gone; counted against all files."""
    found = risk.files(t)
    return scope.scope_counts(found.select("repo", "path"), changes(t))


def changes(t: Tables) -> DataFrame:
    folder = F.concat(F.lit("k"), (F.col("n_chars") % 60).cast("string"))
    name = F.col("doc_id").cast("string")
    listed = F.when((F.col("lang") == "fr") | (F.col("n_chars") % 5 == 0), F.concat(F.lit("  "), folder, F.lit("\\"), name)).otherwise(F.concat(F.lit("gone/"), name))
    text = t("documents").select(F.col("source").alias("repo"), F.explode(F.array(listed, F.lit(" "), listed)).alias("line"))
    return gitlog.parse_touched_paths(text, keep=["repo"])


@QUERIES.query("diff_findings", risk.RISKS + """
SELECT r.repo, r.source, r.severity, r.message, r.confidence
FROM risks r JOIN paths p ON starts_with(r.message, 'Hard-coded secret') AND r.repo = p.repo AND contains(r.message, ' ' || p.path || ':')
JOIN documents d USING (doc_id) WHERE d.lang = 'fr' OR d.n_chars % 5 = 0
UNION ALL
SELECT r.repo, r.source, r.severity, r.message, r.confidence
FROM risks r JOIN paths p ON r.source = 'markers' AND r.repo = p.repo AND contains(r.message, ' in ' || p.path || ':')
JOIN documents d USING (doc_id) WHERE d.lang = 'fr' OR d.n_chars % 5 = 0""")
def diff_findings(t: Tables) -> DataFrame:
    """Line findings of the changed files alone."""
    kept = scope.changed_only(risk.files(t), changes(t))
    found = lines.scan_findings(kept, markers=risk.MARKER_WORDS)
    return risk.reported(risks.finding_risks(found, in_test=F.col("path").rlike("^k[0-9]/")))


def conflicts(t: Tables) -> DataFrame:
    asked = commerce.requirements(t).withColumn("repo", F.concat(F.lit("s"), F.col("repo").cast("string")))
    return packages.dependency_conflicts(asked)


def every_risk(t: Tables) -> list[DataFrame]:
    """Risk rows of all eight sources, from as many tables."""
    external = t("documents").filter("n_chars > 20000").select(
        F.col("source").alias("repo"), F.lit("info").alias("severity"), F.concat(F.lit("long text "), F.col("doc_id").cast("string")).alias("message"), F.lit("MEDIUM").alias("confidence")
    )
    errors = manifest_source.manifest_errors(manifest_source.read_manifests(manifests.files(t)))
    suppliers = t("supplier").filter("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("repo"))
    return [
        *risk.parts(t),
        risks.conflict_risks(conflicts(t)),
        risks.risk_rows(external, "long-texts", F.col("severity"), F.col("message"), F.col("confidence")),
        risks.manifest_risks(errors),
        risks.skipped_check_risks(suppliers),
        risks.vulnerability_risks(risk.flagged(t)),
    ]


_CONFLICTS = """
conflicts AS (
    SELECT 's' || l_suppkey AS repo, 'p' || l_partkey AS package, string_agg(DISTINCT '==' || l_returnflag, ', ' ORDER BY '==' || l_returnflag) AS detail
    FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(DISTINCT l_returnflag) > 1)
"""


@QUERIES.query("risk_union", risk.RISKS + f""",
{manifests.PARTS.replace("parts AS (", "manifest_parts AS (")}, {_CONFLICTS},
every AS (
    SELECT repo, source, CASE source WHEN 'secrets' THEN 1 WHEN 'markers' THEN 2 ELSE 3 END AS position, severity, message, confidence,
           nullif(regexp_extract(message, '(k[0-9]+/[0-9]+):', 1), '') AS path, TRY_CAST(nullif(regexp_extract(message, ':([0-9]+)$', 1), '') AS BIGINT) AS line_no,
           NULL AS package, NULL AS detail FROM risks
    UNION ALL SELECT repo, 'dependency-conflicts', 4, 'warning', 'Duplicate dependency `' || package || '` with conflicting versions: ' || detail || '.', 'MEDIUM', NULL, NULL, package, detail FROM conflicts
    UNION ALL SELECT source, 'long-texts', 5, 'info', 'long text ' || doc_id, 'MEDIUM', NULL, NULL, NULL, NULL FROM documents WHERE n_chars > 20000
    UNION ALL SELECT repo, 'manifests', 6, 'warning', 'Malformed manifest: ' || manifest || ' (Could not parse ' || file || ')', 'HIGH', manifest, NULL, NULL, NULL FROM manifest_parts WHERE broken
    UNION ALL SELECT 's' || s_suppkey, 'skipped', 7, 'info', 'Skipping remote vulnerability check (offline/timeout)', 'HIGH', NULL, NULL, NULL, NULL FROM supplier WHERE s_acctbal < 0
    UNION ALL SELECT source, 'vulnerabilities', 8, 'critical', 'ADV-' || doc_id || ' in `' || lang || '`: toxic text (fix: 2.0)', CASE WHEN quality = 1 THEN 'HIGH' ELSE 'LOW' END, NULL, NULL, lang, 'ADV-' || doc_id
              FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT * FROM every WHERE confidence <> 'LOW'""")
def risk_union(t: Tables) -> DataFrame:
    """Secrets, markers, missing tests, conflicts, an external detector, malformed manifests, skipped checks, vulnerabilities."""
    return risks.risk_map(every_risk(t), "medium")


@QUERIES.query("checklist_sections", risk.RISKS + f""",
{_CONFLICTS}, {_ITEMS},
steps AS (
    SELECT repo, 1 AS section, CASE
        WHEN starts_with(message, 'Hard-coded secret in ') THEN 'Review and rotate hard-coded credentials in '
             || regexp_extract(message, ' in ([^:]*):', 1) || ' (line ' || regexp_extract(message, ':(.*)$', 1) || ').'
        WHEN starts_with(message, 'Hard-coded secret-like') THEN 'Confirm the secret-like value in '
             || regexp_extract(message, 'file ([^:]*):', 1) || ' (line ' || regexp_extract(message, ':(.*)$', 1)
             || ') is a test fixture, not a live credential.'
        ELSE 'Add a `tests/` directory and cover critical paths.' END AS step
    FROM risks WHERE confidence <> 'LOW'
    UNION ALL SELECT repo, 1, 'Resolve version conflict for `' || package || '`: ' || detail || '.' FROM conflicts
    UNION ALL SELECT source, 2, 'Upgrade `' || lang || '` to 2.0 (ADV-' || doc_id || ').' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 1
    UNION ALL SELECT DISTINCT source, 3, 'Set up the development environment for ' || lang || '.' FROM documents WHERE lang <> 'en'
    UNION ALL SELECT source, 4, 'Review changed file in diff: ' || lang || ' (' || count(*) || ' line changes).' FROM documents WHERE lang = 'en' GROUP BY source, lang
    UNION ALL SELECT repo, 5, 'Review ' || count(*) || ' stale path reference(s) in documentation.' FROM items WHERE kind = 'path' GROUP BY repo
    UNION ALL SELECT DISTINCT repo, 6, 'Update documentation: ' || message FROM items WHERE kind = 'stack'
    UNION ALL SELECT repo, 7, 'Update documentation: ' || message FROM items WHERE kind = 'env' AND severity = 'warning')
SELECT repo, section, step FROM steps
UNION ALL SELECT s.repo, 8, 'Review the sections above and validate the project setup.' FROM (SELECT 's' || s_suppkey AS repo FROM supplier) s
WHERE s.repo NOT IN (SELECT repo FROM steps)
UNION ALL SELECT DISTINCT source, 8, 'Review the sections above and validate the project setup.' FROM documents WHERE source NOT IN (SELECT repo FROM steps)""")
def checklist_sections(t: Tables) -> DataFrame:
    """All sections: risks with conflicts, upgrades, frameworks, files of a diff, stale paths, stack, environment, and the
    default. The steps are made once, as a table in the shared folder, which stays for the result."""
    named = t("documents").select(F.col("source").alias("repo"), "lang")
    works = named.filter("lang <> 'en'").select("repo", F.col("lang").alias("framework")).distinct()
    spots = named.filter("lang = 'en'").groupBy("repo", F.col("lang").alias("path")).agg(F.count("*").alias("changes"))
    found = risks.risk_map([*risk.parts(t), risks.conflict_risks(conflicts(t))], "medium")
    repos = named.select("repo").union(t("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))).distinct()
    kept = Workspace(t.spark, tempfile.mkdtemp(prefix="steps-"))
    return risks.checklist(repos, found, risk.flagged(t), works, spots, drift_rows(t), incremental=True, workspace=kept)
