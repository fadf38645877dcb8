"""Findings over documents: source = repository, document = file."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.operators import lines, packages, risks
from fleetscope.plans import detectors
from fleetscope.plans.catalog.base import LINES, MARKER_WORDS, MARKERS, SECRETS, Registry, Tables
from fleetscope.sources import sinks

QUERIES = Registry()
TEST_ROOTS = ["k0", "k7"]


def files(t: Tables) -> DataFrame:
    """``repo, path, content``: a document's folder comes from its length, its name from its id."""
    folder = F.concat(F.lit("k"), (F.col("n_chars") % 60).cast("string"))
    return t("documents").select(
        F.col("source").alias("repo"),
        F.concat_ws("/", folder, F.col("doc_id").cast("string")).alias("path"),
        F.col("text").alias("content"),
    )


def parts(t: Tables) -> list[DataFrame]:
    found = files(t)
    fixture = F.col("path").rlike("^k[0-9]/")
    return [
        risks.finding_risks(lines.scan_findings(found, markers=MARKER_WORDS), in_test=fixture),
        risks.missing_tests_risks(risks.missing_tests(found, roots=TEST_ROOTS)),
    ]


def reported(rows: DataFrame) -> DataFrame:
    return rows.select("repo", *risks.REPORTED)


#: risks(repo, source, severity, message, confidence), all confidences
RISKS = f"""
WITH {SECRETS}, {MARKERS},
paths AS (SELECT doc_id, source AS repo, 'k' || (n_chars % 60) || '/' || doc_id AS path FROM documents),
risks AS (
    SELECT repo, 'secrets' AS source,
           CASE WHEN regexp_matches(path, '^k[0-9]/') THEN 'warning' ELSE 'critical' END AS severity,
           CASE WHEN regexp_matches(path, '^k[0-9]/') THEN 'Hard-coded secret-like value in test/example file '
                ELSE 'Hard-coded secret in ' END || path || ':' || line_no AS message,
           confidence
    FROM secrets JOIN paths USING (doc_id)
    UNION ALL
    SELECT repo, 'markers', 'info', marker || ' in ' || path || ':' || line_no, 'LOW' FROM markers JOIN paths USING (doc_id)
    UNION ALL
    SELECT repo, 'missing-tests', 'warning', 'Missing tests directory (`tests/`, `test/`, or `__tests__/`).', 'HIGH'
    FROM paths GROUP BY repo HAVING NOT bool_or(starts_with(path, 'k0/') OR starts_with(path, 'k7/')))
"""


@QUERIES.query("risk_counts", RISKS + """
SELECT repo, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning,
       count(*) FILTER (severity = 'info') AS info, count(*) AS total FROM risks GROUP BY repo""")
def risk_counts(t: Tables) -> DataFrame:
    return risks.risk_counts(risks.risk_map(parts(t), "low"))


@QUERIES.query("risk_map", RISKS + "SELECT * FROM risks WHERE confidence IN ('MEDIUM', 'HIGH')")
def risk_map(t: Tables) -> DataFrame:
    return reported(risks.risk_map(parts(t), "medium"))


@QUERIES.query("confidence_filter", RISKS + "SELECT * FROM risks WHERE confidence = 'HIGH'")
def confidence_filter(t: Tables) -> DataFrame:
    return reported(risks.risk_map(parts(t), "high"))


@QUERIES.query("risk_search", RISKS + """
SELECT repo, severity, message, confidence FROM risks
WHERE severity = 'info' AND confidence = 'LOW' AND contains(lower(message), 'mit in k1')""")
def risk_search(t: Tables) -> DataFrame:
    found = risks.search_risks(risks.risk_map(parts(t), "low"), "info", "LOW", "MIT in K1")
    return found.select("repo", "severity", "message", "confidence")


@QUERIES.query("risk_status", RISKS + """,
counts AS (SELECT repo, count(*) FILTER (severity = 'critical') AS c, count(*) AS n FROM risks GROUP BY repo)
SELECT repo, CASE WHEN c > 0 THEN c || ' critical' ELSE n || ' risks' END AS label,
       CASE WHEN c > 0 THEN 'red' ELSE 'yellow' END AS color FROM counts
UNION ALL SELECT DISTINCT source, 'clean', 'brightgreen' FROM documents WHERE source NOT IN (SELECT repo FROM risks)""")
def risk_status(t: Tables) -> DataFrame:
    counts = risks.risk_counts(risks.risk_map(parts(t), "low"))
    every = t("documents").select(F.col("source").alias("repo")).distinct()
    filled = every.join(counts, "repo", "left").na.fill(0, risks.SEVERITIES)
    return risks.risk_status(filled)


@QUERIES.query("unified_risks", RISKS + """
SELECT repo, severity, '[' || repo || '] ' || message AS message, confidence FROM risks WHERE confidence <> 'LOW'
UNION ALL
SELECT source, 'vulnerabilities', '[' || source || '] ADV-' || doc_id || ' in `' || lang || '`: toxic text (fix: 2.0)', 'HIGH'
FROM documents JOIN labels USING (doc_id) WHERE toxic = 1""")
def unified_risks(t: Tables) -> DataFrame:
    return risks.unified_risks(risks.risk_map(parts(t), "medium"), flagged(t))


def flagged(t: Tables) -> DataFrame:
    """Toxic documents in the shape of vulnerability findings."""
    toxic = t("labels").filter("toxic = 1").select("doc_id", "quality")
    return t("documents").select("doc_id", "source", "lang").join(toxic, "doc_id").select(
        F.col("source").alias("repo"),
        F.concat(F.lit("ADV-"), F.col("doc_id").cast("string")).alias("id"),
        F.col("lang").alias("package"),
        F.lit("critical").alias("severity"),
        F.lit("2.0").alias("fixed_in"),
        F.lit("toxic text").alias("summary"),
        F.when(F.col("quality") == 1, "HIGH").otherwise("LOW").alias("confidence"),
    )


@QUERIES.query("checklist", RISKS + """,
steps AS (
    SELECT repo, 1 AS section, CASE
        WHEN starts_with(message, 'Hard-coded secret in ') THEN 'Review and rotate hard-coded credentials in '
             || regexp_extract(message, ' in ([^:]*):', 1) || ' (line ' || regexp_extract(message, ':(.*)$', 1) || ').'
        WHEN starts_with(message, 'Hard-coded secret-like') THEN 'Confirm the secret-like value in '
             || regexp_extract(message, 'file ([^:]*):', 1) || ' (line ' || regexp_extract(message, ':(.*)$', 1)
             || ') is a test fixture, not a live credential.'
        ELSE 'Add a `tests/` directory and cover critical paths.' END AS step
    FROM risks WHERE confidence <> 'LOW'
    UNION ALL
    SELECT source, 2, 'Upgrade `' || lang || '` to 2.0 (ADV-' || doc_id || ').'
    FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 1
    UNION ALL
    SELECT DISTINCT source, 3, 'Set up the development environment for ' || lang || '.' FROM documents WHERE lang <> 'en'
    UNION ALL
    SELECT source, 4, 'Review frequently changed file: ' || lang || ' (' || count(*) || ' edits in 30 days).'
    FROM documents GROUP BY source, lang HAVING lang = 'en')
SELECT repo, section, step FROM steps
UNION ALL SELECT DISTINCT source, 8, 'Review the sections above and validate the project setup.' FROM documents
WHERE source NOT IN (SELECT repo FROM steps)""")
def checklist(t: Tables) -> DataFrame:
    docs = t("documents").select(F.col("source").alias("repo"), "lang")
    works = docs.filter("lang <> 'en'").select("repo", F.col("lang").alias("framework")).distinct()
    spots = docs.filter("lang = 'en'").groupBy("repo", F.col("lang").alias("path")).agg(F.count("*").alias("changes"))
    return risks.checklist(
        docs.select("repo"), risks.risk_map(parts(t), "medium"), flagged(t), works, spots
    )


@QUERIES.query("missing_tests", """
SELECT source AS repo, NOT bool_or(n_chars % 60 IN (0, 7)) AS missing_tests FROM documents GROUP BY source""")
def missing_tests(t: Tables) -> DataFrame:
    return risks.missing_tests(files(t), roots=TEST_ROOTS)


@QUERIES.query("detector_registry", RISKS + """
SELECT repo, source, severity, count(*) AS findings FROM risks WHERE source <> 'missing-tests' GROUP BY ALL
UNION ALL
SELECT source, 'long-files', 'info', count(*) FROM documents WHERE length(text) > 3000 GROUP BY source""")
def detector_registry(t: Tables) -> DataFrame:
    """Built-in detectors with one disabled, one external that works, one that fails, one whose name is taken."""

    def long_files(context: detectors.Context) -> DataFrame:
        return context["files"].filter(F.length("content") > 3000).select(
            "repo", F.lit("info").alias("severity"), F.col("path").alias("message"), F.lit("HIGH").alias("confidence")
        )

    def broken(context: detectors.Context) -> DataFrame:
        return context["no_such_table"]

    external = [
        detectors.Detector("long-files", "Files of more than 3000 characters", long_files),
        detectors.Detector("broken", "Fails while it is planned", broken),
        detectors.Detector("markers", "Name of a built-in detector", broken),
    ]

    def fixture_secrets(context: detectors.Context) -> DataFrame:
        return risks.secret_risks(lines.scan_secrets(context["files"]), in_test=F.col("path").rlike("^k[0-9]/"))

    built_in = [detectors.Detector("secrets", "Credentials, k0 to k9 being fixtures", fixture_secrets), *detectors.BUILT_IN[1:]]
    context = detectors.Context({"files": files(t)}, detectors.Settings(markers=MARKER_WORDS))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        chosen = detectors.resolve(external, ["missing-tests"], built_in)
        rows, _ = detectors.run(chosen, context)
    return rows.groupBy("repo", "source", "severity").agg(F.count(F.lit(1)).alias("findings"))


@QUERIES.query("report_payload", RISKS + r""",
items AS (
    SELECT repo, 'risks' AS section, message || chr(1) || severity AS id,
           '{"severity":"' || severity || '","message":"' || message || '","confidence":"' || confidence || '"}' AS item
    FROM risks
    UNION ALL
    SELECT source, 'files', CAST(doc_id AS VARCHAR), '{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}'
    FROM documents),
sized AS (SELECT *, CAST(ceil(count(*) OVER (PARTITION BY repo, section) / 20.0) AS BIGINT) AS parts FROM items),
placed AS (SELECT *, CAST('0x' || substr(md5(id), 1, 7) AS BIGINT) % parts AS part FROM sized)
SELECT repo, section, part, count(*) AS items,
       '[' || string_agg(item, ',' ORDER BY item COLLATE "C") || ']' AS payload
FROM placed GROUP BY repo, section, part""".replace(' COLLATE "C"', ""))
def report_payload(t: Tables) -> DataFrame:
    """Risks and file facts of every source as JSON documents of about 20 items."""
    found = risks.risk_map(parts(t), "low").select("repo", "severity", "message", "confidence")
    facts = t("documents").select(F.col("source").alias("repo"), "doc_id", "lang", "n_chars")
    return sinks.report_payload(
        {"risks": found, "files": facts},
        identity={"risks": ["message", "severity"], "files": ["doc_id"]},
        per_part=20,
    )
