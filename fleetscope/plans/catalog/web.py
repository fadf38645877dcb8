"""Addresses and references in web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import paths, urls
from fleetscope.operators import drift, lines
from fleetscope.plans.catalog.base import Registry, Tables

QUERIES = Registry()

HREF = [(r'href="([^"]*)"', 1)]

#: refs(page_id, lang, raw): every href, duplicates kept
REFS = r"""
refs AS (
    SELECT page_id, regexp_extract(url, '://[^/]+/([a-z]+)', 1) AS lang,
           trim(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), ' ' || chr(9) || chr(10) || chr(13)) AS raw
    FROM pages)
"""
#: clean(page_id, lang, raw, path): normalised references
CLEAN = REFS + r""",
bare AS (
    SELECT page_id, lang, raw,
           regexp_replace(split_part(split_part(raw, '#', 1), '?', 1), '^[.]/', '') AS b FROM refs
    WHERE raw <> '' AND NOT regexp_matches(raw, '^(https?://|mailto:|#)') AND NOT contains(raw, '://')),
cut AS (
    SELECT page_id, lang, raw, b, list_filter(string_split(b, '/'), LAMBDA x: x <> '' AND x <> '.') AS s FROM bare
    WHERE b <> '' AND NOT regexp_matches(b, '[.](png|jpg|gif|svg|ico)$')),
clean AS (
    SELECT page_id, lang, raw, array_to_string(s, '/') AS path FROM cut
    WHERE len(s) > 0 AND NOT (len(s) = 1 AND lower(s[1]) IN ('src','lib','app','docs','test','tests','config','api','env'))
      AND lower(s[-1]) NOT IN ('fleetscope.md','fleetscope.json','fleetscope.xml','fleetscope.html','fleetscope-system.md','fleetscope-system.json','fleetscope-system.xml','handoff.md'))
"""


def references(t: Tables) -> DataFrame:
    lang = F.regexp_extract("url", "://[^/]+/([a-z]+)", 1)
    pages = t("pages").select("page_id", lang.alias("lang"), "html")
    return lines.path_references(pages, "html", ["page_id", "lang"], HREF, skip_fenced=False)


@QUERIES.query("path_refs", f"WITH {REFS} SELECT page_id, raw FROM refs")
def path_refs(t: Tables) -> DataFrame:
    return references(t).select("page_id", "raw")


@QUERIES.query("normalize_paths", f"WITH {CLEAN} SELECT page_id, raw, path FROM clean")
def normalize_paths(t: Tables) -> DataFrame:
    found = references(t).select("page_id", "raw", paths.normalize_reference(F.col("raw")).alias("path"))
    return found.filter(F.col("path").isNotNull())


#: checked(repo, source, path, occurrences, valid)
CHECKED = CLEAN + """,
counted AS (SELECT lang AS repo, page_id AS source, path, count(*) AS occurrences FROM clean
            WHERE page_id % 2 = 1 AND NOT starts_with(lower(path), '.fleetscope') AND NOT ends_with(lower(path), 'mcp.json')
            GROUP BY ALL),
known AS (SELECT DISTINCT lang AS repo, path FROM clean WHERE page_id % 2 = 0),
checked AS (SELECT c.*, k.path IS NOT NULL AS valid FROM counted c LEFT JOIN known k ON c.repo = k.repo AND c.path = k.path)
"""


def checked(t: Tables) -> DataFrame:
    """References of odd pages against the targets that even pages of the same language link to."""
    found = references(t).withColumnRenamed("lang", "repo")
    counted = drift.reference_counts(
        found.filter("page_id % 2 = 1").withColumnRenamed("page_id", "source"), check_form=False
    )
    known = found.filter("page_id % 2 = 0").select("repo", paths.normalize_reference(F.col("raw")).alias("path"))
    return drift.checked_references(counted, known.filter("path IS NOT NULL"))


@QUERIES.query("path_drift", f"""
WITH {CHECKED}
SELECT repo, CAST(coalesce(sum(occurrences) FILTER (valid), 0) AS BIGINT) AS valid_refs, CAST(sum(occurrences) AS BIGINT) AS total_refs,
       round_even(coalesce(sum(occurrences) FILTER (valid), 0) / sum(occurrences), 4) AS path_ratio,
       count(*) FILTER (NOT valid) AS missing
FROM checked GROUP BY repo""")
def path_drift(t: Tables) -> DataFrame:
    judged = checked(t)
    missing = drift.path_items(judged).groupBy("repo").agg(F.count(F.lit(1)).alias("missing"))
    return drift.path_ratio(judged).join(missing, "repo", "left").na.fill(0, ["missing"])


@QUERIES.query("url_normalize", r"""
WITH cut AS (
    SELECT page_id, url, lower(regexp_extract(url, '^([a-z]+)://', 1)) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host,
           list_filter(string_split(regexp_replace(regexp_extract(url, '://[^/?#]+([^?#]*)', 1) || '/', '/(de|admin)/.*$', '/'), '/'), LAMBDA x: x <> '') AS s
    FROM pages)
SELECT page_id, scheme || '://' || host || '/' || array_to_string(s, '/') AS clone_url, array_to_string(s, '/') AS display_name,
       CASE WHEN scheme = 'https' THEN 'https://github.com/' || array_to_string(s, '/') ELSE 'none' END AS public_url
FROM cut WHERE len(s) >= 2""")
def url_normalize(t: Tables) -> DataFrame:
    """Page addresses as repository addresses (``/de/`` and ``/admin/`` are noise), and the same address
    on an allowed host's alias."""
    noise = ["de", "admin"]
    target = urls.repo_target(F.col("url"), noise)
    moved = F.regexp_replace("url", "://[^/?#]+", "://www.github.com")
    return (
        t("pages")
        .select("page_id", target.alias("t"), urls.public_repo_url(moved, noise=noise).alias("u"))
        .filter(F.col("t").isNotNull())
        .select("page_id", "t.clone_url", "t.display_name", F.coalesce("u", F.lit("none")).alias("public_url"))
    )
