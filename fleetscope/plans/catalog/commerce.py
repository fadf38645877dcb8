"""Ownership and packages over orders.

Ownership: module = customer, commit = order, author = return flag, a line item is a line of code; an
order's priority is its message. Packages: a line item is a dependency of its supplier on its part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.advisories import AFFECTED
from fleetscope.operators import drift, fleet, history, ownership, packages
from fleetscope.operators.ordered import FEW_DEALT, deal
from fleetscope.plans.catalog.base import Registry, Tables
from fleetscope.sources import gitlog

QUERIES = Registry()

PRIORITY_TOOLS = [("urgent", "Urgent"), ("high", "High")]
SHAPES = [("ring", "Ring"), ("bolt", "Bolt"), ("widget", "Widget"), ("small/gear", "Small Gear"), ("cold", "Cold"), ("gizmo", "Gizmo")]
WORDS = [
    ("ring", "shape", "Ring"), ("bolt", "shape", "Bolt"), ("widget", "shape", "Widget"), ("rod", "shape", "Rod"),
    ("red", "colour", "Red"), ("blue", "colour", "Blue"), ("small", "size", "Small"), ("large", "size", "Large"),
]


def blame(t: Tables) -> DataFrame:
    """``repo, module, path, author, sha``. Items are dealt by order, as the join needs them; the counts per commit
    are made in the same tasks, whose tables hold nearly every row at many times its bytes in the shuffle."""
    items = deal(t("lineitem").select("l_orderkey", "l_returnflag", "l_partkey"), ["l_orderkey"])
    orders = t("orders").select("o_orderkey", "o_custkey")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("r").alias("repo"), F.col("o_custkey").alias("module"), F.col("l_partkey").cast("string").alias("path"),
        F.col("l_returnflag").alias("author"), F.col("l_orderkey").alias("sha"),
    )


BLAME = "blame AS (SELECT o_custkey AS module, l_partkey AS path, l_returnflag AS author, l_orderkey AS sha FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def counts(t: Tables) -> DataFrame:
    return ownership.line_counts(blame(t), ["module"])


def meta(t: Tables) -> DataFrame:
    return t("orders").select(
        F.lit("r").alias("repo"), F.col("o_orderkey").alias("sha"), F.lit("someone").alias("author"), F.lit("").alias("email"),
        F.lower("o_orderpriority").alias("message"), F.col("o_orderdate").alias("ts"),
    )


def tagged(t: Tables) -> DataFrame:
    return ownership.tag_commits(meta(t), PRIORITY_TOOLS)


@QUERIES.query("ownership_lines", f"WITH {BLAME} SELECT module, author, count(*) AS lines FROM blame GROUP BY ALL")
def ownership_lines(t: Tables) -> DataFrame:
    return ownership.owned_lines(counts(t), ["module"])


@QUERIES.query("module_totals", f"WITH {BLAME} SELECT module, count(*) AS line_count, count(DISTINCT sha) AS commits FROM blame GROUP BY module")
def module_totals(t: Tables) -> DataFrame:
    return ownership.module_totals(counts(t), ["module"])


SHARES = f"""
{BLAME},
counted AS (SELECT module, author, count(*) AS lines FROM blame GROUP BY ALL),
rounded AS (SELECT *, CAST(floor(lines / sum(lines) OVER (PARTITION BY module) * 100 + 0.5) AS INTEGER) AS share FROM counted),
rest AS (SELECT *, 100 - sum(share) OVER (PARTITION BY module) AS rest, row_number() OVER (PARTITION BY module ORDER BY lines DESC, author) AS n FROM rounded),
shares AS (SELECT module, author, lines, CAST(greatest(0, share + CASE WHEN n = 1 THEN rest ELSE 0 END) AS INTEGER) AS share FROM rest)
"""


@QUERIES.query("ownership_shares", f"WITH {SHARES} SELECT * FROM shares")
def ownership_shares(t: Tables) -> DataFrame:
    return ownership.shares(ownership.owned_lines(counts(t), ["module"]), ["module"])


def contributors(t: Tables) -> DataFrame:
    shared = ownership.shares(ownership.owned_lines(counts(t), ["module"]), ["module"])
    return ownership.top_contributors(shared, ["module"], is_ai=F.col("author") == "R")


TOP = f"""
{SHARES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY author = 'R', share DESC, author) AS n FROM shares),
top AS (
    SELECT f.module, f.author AS primary_owner, f.share AS primary_percent,
           CASE WHEN (s.author = 'R') = (f.author = 'R') THEN s.author ELSE '' END AS secondary,
           CASE WHEN (s.author = 'R') = (f.author = 'R') THEN s.share ELSE 0 END AS secondary_percent
    FROM ranked f LEFT JOIN ranked s ON f.module = s.module AND s.n = 2 WHERE f.n = 1)
"""


@QUERIES.query("top_contributors", f"WITH {TOP} SELECT * FROM top")
def top_contributors(t: Tables) -> DataFrame:
    return contributors(t)


AI = f"""
{BLAME},
ai AS (
    SELECT module, count(*) AS line_count, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH') OR path % 10 = 0) AS ai_line_count
    FROM blame JOIN orders ON sha = o_orderkey GROUP BY module)
"""


def ai_share(t: Tables) -> DataFrame:
    inline = t("part").filter("p_partkey % 10 = 0").select(F.lit("r").alias("repo"), F.col("p_partkey").cast("string").alias("path"))
    return ownership.ai_lines(counts(t), tagged(t), ["module"], inline_files=inline)


@QUERIES.query("ai_line_share", f"WITH {AI} SELECT *, CAST(round_even(ai_line_count / line_count * 100, 1) AS DOUBLE) AS ai_percent FROM ai")
def ai_line_share(t: Tables) -> DataFrame:
    return ai_share(t)


@QUERIES.query("module_ownership", f"""
WITH {TOP}, {AI.replace(BLAME + ',', '')},
churn AS (SELECT o_custkey AS module, count(*) AS churn FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY GROUP BY ALL),
tools AS (
    SELECT module, string_agg(DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' ELSE 'High' END, ',' ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' ELSE 'High' END) AS ai_tools
    FROM blame JOIN orders ON sha = o_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY module),
touched AS (SELECT DISTINCT module, sha, o_orderdate FROM blame JOIN orders ON sha = o_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
thirds AS (SELECT module, lead(o_orderdate, 2) OVER (PARTITION BY module ORDER BY o_orderdate) - o_orderdate <= INTERVAL 40 DAY AS hit FROM touched),
bursts AS (SELECT module, coalesce(bool_or(hit), false) AS burst FROM thirds GROUP BY module),
joined AS (
    SELECT module, primary_owner, primary_percent, secondary, secondary_percent,
           CAST(round_even(ai_line_count / line_count * 100, 1) AS DOUBLE) AS ai_percent, coalesce(ai_tools, '') AS ai_tools,
           coalesce(burst, false) AS rapid_ai_session, line_count, coalesce(churn, 0) AS churn
    FROM top JOIN ai USING (module) LEFT JOIN churn USING (module) LEFT JOIN tools USING (module) LEFT JOIN bursts USING (module)),
named AS (
    SELECT * REPLACE (CASE WHEN secondary = '' AND ai_percent >= 25 THEN 'AI' ELSE secondary END AS secondary,
                      CASE WHEN secondary = '' AND ai_percent >= 25 THEN ai_percent ELSE CAST(secondary_percent AS DOUBLE) END AS secondary_percent),
           ai_percent >= 25 OR ai_tools <> '' AS ai_assisted
    FROM joined)
SELECT * EXCLUDE (churn),
       CASE WHEN line_count < 20 AND churn = 0 THEN 'Low Activity' WHEN churn >= 3 THEN 'High Activity'
            WHEN primary_percent >= 70 AND churn <= 1 THEN 'Stable / Maintenance' WHEN primary_percent < 50 THEN 'Shared'
            WHEN churn = 0 THEN 'Low Activity' ELSE 'Stable / Maintenance' END AS expertise_level,
       CASE WHEN ai_assisted AND ai_percent >= 25 THEN '🤖 AI-Assisted (' || CAST(round_even(ai_percent, 0) AS INTEGER) || '% '
                 || CASE WHEN ai_tools = '' THEN 'AI' ELSE replace(ai_tools, ',', '/') END || ')'
            WHEN secondary <> '' THEN secondary || ' (' || CAST(round_even(secondary_percent, 0) AS INTEGER) || '%)' ELSE '—' END AS secondary_text
FROM named""")
def module_ownership(t: Tables) -> DataFrame:
    recent = history.churn(
        t("orders").select(F.col("o_custkey").alias("module"), F.col("o_orderdate").alias("ts")), ["module"], days=90, clock=[]
    )
    lines, marks = counts(t), tagged(t)
    out = ownership.module_ownership(
        contributors(t),
        ai_share(t),
        recent,
        ownership.module_tools(lines, marks, ["module"]),
        ownership.module_bursts(lines, marks, ["module"], seconds=40 * 86400),
        ["module"],
    )
    return out.withColumn("ai_tools", F.array_join("ai_tools", ","))


@QUERIES.query("blame_lines", """
WITH ordered AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem),
carried AS (
    SELECT l_suppkey AS path, n, sha1(CAST(l_orderkey AS VARCHAR)) AS sha,
           last_value(CASE WHEN l_linestatus = 'F' THEN 'dev ' || l_returnflag END IGNORE NULLS)
               OVER (PARTITION BY l_suppkey ORDER BY n ROWS UNBOUNDED PRECEDING) AS author
    FROM ordered)
SELECT path, CAST(n * 4 + 3 AS BIGINT) AS line_no, author, sha FROM carried WHERE author IS NOT NULL""")
def blame_lines(t: Tables) -> DataFrame:
    """A porcelain listing per supplier: header, bare hash, author (on F lines only) and content line of
    every item, in key order."""
    sorted_items = t("lineitem").select(
        F.lit("r").alias("repo"), F.col("l_suppkey").alias("path"), "l_orderkey", "l_linestatus", "l_returnflag", "l_linenumber", "l_partkey",
    )
    from fleetscope.operators.ordered import with_running_sum

    numbered = with_running_sum(
        sorted_items.withColumn("one", F.lit(1)), ["repo", "path"], ["l_orderkey", "l_linenumber", "l_partkey"], "one", "n",
        F.floor(F.col("l_orderkey") / 5000),
    )
    sha = F.sha1(F.col("l_orderkey").cast("string").cast("binary"))
    author = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("author dev "), F.col("l_returnflag"))).otherwise("summary none")
    rows = F.array(F.concat(sha, F.lit(" 1 1 1")), F.sha1(F.lit("bare").cast("binary")), author, F.lit("\tcode"))
    listing = numbered.select("repo", "path", "n", F.posexplode(rows).alias("k", "line")).select(
        "repo", "path", (F.col("n") * 4 + F.col("k")).alias("line_no"), "line"
    )
    return gitlog.parse_blame(listing, rows_per_block=1000).drop("repo")


@QUERIES.query("numstat_churn", """
SELECT l_suppkey AS repo, 'p' || l_partkey AS path, CAST(sum(CAST(l_quantity AS BIGINT) + l_linenumber) AS BIGINT) AS changes
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10 AND l_linestatus = 'F' GROUP BY ALL""")
def numstat_churn(t: Tables) -> DataFrame:
    """Numstat lines of line items: O items are binary, R items renames; only parts above size 10 exist."""
    amount = F.when(F.col("l_linestatus") == "O", "-").otherwise(F.col("l_quantity").cast("bigint").cast("string"))
    name = F.concat(F.when(F.col("l_returnflag") == "R", "old\\x => p").otherwise("p"), F.col("l_partkey").cast("string"))
    line = F.concat_ws("\t", amount, F.col("l_linenumber").cast("string"), name)
    parsed = gitlog.parse_numstat(t("lineitem").select(F.col("l_suppkey").alias("repo"), line.alias("line")))
    live = t("part").filter("p_size > 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"))
    counted = history.numstat_churn(parsed)
    return counted.join(live, "path", "left_semi").select("repo", "path", "changes")


def requirements(t: Tables) -> DataFrame:
    return t("lineitem").select(
        F.col("l_suppkey").alias("repo"), F.lit("requirements.txt").alias("manifest"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("package"), F.concat(F.lit("=="), F.col("l_returnflag")).alias("spec"),
    )


@QUERIES.query("dependency_conflicts", """
SELECT l_suppkey AS repo, 'requirements.txt' AS manifest, 'p' || l_partkey AS package, string_agg(DISTINCT '==' || l_returnflag, ',' ORDER BY '==' || l_returnflag) AS versions
FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1""")
def dependency_conflicts(t: Tables) -> DataFrame:
    return packages.dependency_conflicts(requirements(t)).withColumn("versions", F.array_join("versions", ","))


def used(t: Tables) -> DataFrame:
    """``repo, manifest, ecosystem, name, version, exact, spec``."""
    return t("lineitem").select(
        F.col("l_suppkey").alias("repo"), F.col("l_orderkey").cast("string").alias("manifest"),
        F.when(F.col("l_partkey") % 3 == 0, "npm").otherwise("PyPI").alias("ecosystem"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), F.col("l_returnflag").alias("version"),
        (F.col("l_linestatus") == "F").alias("exact"), F.col("l_linestatus").alias("spec"),
    )


USED = """
used AS (
    SELECT l_suppkey AS repo, CAST(l_orderkey AS VARCHAR) AS manifest, CASE WHEN l_partkey % 3 = 0 THEN 'npm' ELSE 'PyPI' END AS ecosystem,
           'p' || l_partkey AS name, l_returnflag AS version, l_linestatus = 'F' AS exact, l_linestatus AS spec FROM lineitem),
distinct_used AS (
    SELECT repo, ecosystem, name, version, arg_min(exact, manifest || chr(1) || spec) AS exact, arg_min(spec, manifest || chr(1) || spec) AS spec
    FROM used GROUP BY ALL)
"""


@QUERIES.query("distinct_packages", f"WITH {USED} SELECT * FROM distinct_used")
def distinct_packages(t: Tables) -> DataFrame:
    return packages.distinct_packages(used(t))


@QUERIES.query("shared_dependencies", f"""
WITH {USED}
SELECT ecosystem, name, count(*) AS occurrences, count(DISTINCT version) AS versions,
       CASE WHEN count(DISTINCT version) > 1 THEN 'mismatch' ELSE 'duplicate' END AS kind
FROM distinct_used GROUP BY ALL HAVING count(*) >= 2""")
def shared_dependencies(t: Tables) -> DataFrame:
    return packages.mismatch_first(packages.shared_dependencies(packages.distinct_packages(used(t))))


@QUERIES.query("shared_occurrences", f"""
WITH {USED},
kinds AS (SELECT ecosystem, name, CASE WHEN count(DISTINCT version) > 1 THEN 'mismatch' ELSE 'duplicate' END AS kind
          FROM distinct_used GROUP BY ALL HAVING count(*) >= 2)
SELECT ecosystem, name, kind, repo, version FROM distinct_used JOIN kinds USING (ecosystem, name)""")
def shared_occurrences(t: Tables) -> DataFrame:
    return packages.shared_occurrences(packages.distinct_packages(used(t)))


def advisories(t: Tables) -> DataFrame:
    """An OSV record per part: scores from the size, words from the type, fixes for some."""
    key, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.lit("p"), key.cast("string"))
    score = F.when(size % 4 == 0, "CVSS:3.1/AV:N").when(size % 4 == 1, F.concat((size / 5).cast("string"), F.lit("/10"))).otherwise((size / 5).cast("string"))
    versions = F.when(size % 2 == 0, F.array(F.lit("A"), F.lit("R"))).otherwise(F.array(F.lit("N")))
    fixed = F.when(size % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("v"), size.cast("string")))
    none = F.lit(None).cast("string")
    event = lambda introduced, fixed: F.struct(introduced.alias("introduced"), fixed.alias("fixed"), none.alias("last_affected"), none.alias("limit"))
    events = F.array(event(F.lit("0"), none), event(none, fixed))
    eco = F.when(key % 3 == 0, "npm").otherwise("PyPI")
    parts = deal(t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), ["p_partkey"], FEW_DEALT)
    return parts.select(
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("ADV-"), key.cast("string"))).alias("id"),
        F.when(size % 7 == 0, " ").otherwise(F.col("p_name")).alias("summary"),
        F.concat(F.lit("\n"), F.col("p_brand"), F.lit("\nmore")).alias("details"),
        F.when(key % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(""), F.concat(F.lit("CVE-"), key.cast("string")))).alias("aliases"),
        F.array(F.struct(F.lit("CVSS_V3").alias("type"), score.alias("score"))).alias("severity"),
        F.struct(F.when(F.col("p_type") == "PROMO", "High").otherwise(F.col("p_type")).alias("severity")).alias("database_specific"),
        F.array(
            F.struct(
                F.struct(name.alias("name"), eco.alias("ecosystem")).alias("package"), versions.alias("versions"),
                F.array(F.struct(F.lit("ECOSYSTEM").alias("type"), events.alias("events"))).alias("ranges"),
            )
        ).cast(AFFECTED).alias("affected"),
    )


ADVISORIES = """
advisories AS (
    SELECT p_partkey, p_size, CASE WHEN p_partkey % 10 = 0 THEN 'UNKNOWN' WHEN p_partkey % 5 = 0 THEN 'CVE-' || p_partkey ELSE 'ADV-' || p_partkey END AS id,
           CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_type = 'PROMO' THEN 'critical' ELSE 'warning' END
                WHEN p_size / 5 >= 8 THEN 'critical' ELSE 'warning' END AS severity,
           CASE WHEN p_size % 3 = 0 THEN '' ELSE 'v' || p_size END AS fixed_in,
           CASE WHEN p_size % 7 = 0 THEN p_brand ELSE p_name END AS summary
    FROM part)
"""


@QUERIES.query("advisory_severity", f"WITH {ADVISORIES} SELECT 'p' || p_partkey AS package, id, severity, fixed_in, summary FROM advisories")
def advisory_severity(t: Tables) -> DataFrame:
    from fleetscope.functions import advisories as adv

    package: Column = F.get("affected", 0)["package"]["name"]
    return advisories(t).select(
        package.alias("package"),
        adv.resolved_id(F.col("id"), F.col("aliases")).alias("id"),
        adv.severity(F.col("severity"), F.col("database_specific.severity")).alias("severity"),
        adv.fixed_version(F.col("affected"), package).alias("fixed_in"),
        adv.summary(F.col("summary"), F.col("details")).alias("summary"),
    )


@QUERIES.query("vulnerability_join", f"""
WITH {USED}, {ADVISORIES},
found AS (
    SELECT repo, id, name AS package, severity, fixed_in, summary, version, exact FROM distinct_used JOIN advisories ON name = 'p' || p_partkey
    WHERE CASE WHEN p_size % 2 = 0 THEN version IN ('A', 'R') ELSE version = 'N' END)
SELECT repo, id, package, any_value(severity) AS severity, any_value(fixed_in) AS fixed_in, any_value(summary) AS summary,
       CASE WHEN arg_min(exact, version) THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
FROM found GROUP BY repo, id, package""")
def vulnerability_join(t: Tables) -> DataFrame:
    return packages.match_advisories(packages.distinct_packages(used(t)), advisories(t))


def released(t: Tables) -> DataFrame:
    """``repo, ecosystem, name, version, exact``: full, short and release-candidate versions of parts."""
    npm, n = F.col("l_partkey") % 3 == 0, F.col("l_linenumber").cast("string")
    candidate = F.when(npm, F.concat(F.lit("1."), n, F.lit(".0-rc.1"))).otherwise(F.concat(F.lit("v1."), n, F.lit(".0RC1")))
    version = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("1."), n, F.lit(".0"))).when(F.col("l_returnflag") == "R", F.concat(F.lit("1."), n)).otherwise(candidate)
    return t("lineitem").select(
        F.col("l_suppkey").alias("repo"), F.when(npm, "npm").otherwise("PyPI").alias("ecosystem"),
        F.concat(F.when(npm, "p-").otherwise("P__"), F.col("l_partkey").cast("string")).alias("name"), version.alias("version"),
        (F.col("l_linestatus") == "F").alias("exact"), F.col("l_linestatus").alias("spec"), F.lit("m").alias("manifest"),
    )


#: By a part's size: listed versions, events of ranges (introduced, fixed, last affected, limit), further range type.
AFFECTS = [
    (["1.2.0", "1.4"], []),
    ([], [("0", None, None, None), (None, "1.4.0", None, None)]),
    ([], [(None, None, "1.5.0", None), ("1.2", None, None, None)]),
    ([], [(None, "1.3", None, None), ("1.3.0-rc.1", None, None, None)]),
    ([], [("1.5.0", None, None, None), ("0", None, None, None), (None, "1.2.0", None, None)]),
    (["1.1.0"], [("1.6.0-alpha", None, None, None)]),
    (["1.7"], [("1.2.0", None, None, None), (None, None, None, "1.3.0"), ("1.9", "1.10", None, None)]),
    ([], [("0", "not a version", None, None)]),
]


def ranged_advisories(t: Tables) -> DataFrame:
    """An OSV record per part, two for some; all of them also name a range of commits, which counts for nothing.

    Parts are dealt first: a part is a few bytes, its records take far longer to make and to read."""
    text = lambda v: F.lit(v).cast("string")
    event = lambda e: F.struct(*[text(v).alias(n) for v, n in zip(e, ("introduced", "fixed", "last_affected", "limit"), strict=True)])
    commits = F.struct(F.lit("GIT").alias("type"), F.array(event(("0", None, None, None))).alias("events"))
    key, eco = F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, "npm").otherwise("PyPI")
    package = F.struct(F.concat(F.lit("p-"), key.cast("string")).alias("name"), eco.alias("ecosystem")).alias("package")
    chosen = None
    for n, (listed, events) in enumerate(AFFECTS):
        own = F.struct(F.when(key % 3 == 0, "SEMVER").otherwise("ECOSYSTEM").alias("type"), F.array(*[event(e) for e in events]).alias("events"))
        ranges = F.array(own, commits) if events else F.array(commits)
        one = F.struct(package, F.array(*[text(v) for v in listed]).cast("array<string>").alias("versions"), ranges.alias("ranges"))
        chosen = (F if chosen is None else chosen).when(F.col("kind") == n, F.array(one).cast(AFFECTED))
    kinds = F.array_distinct(F.array(F.col("p_size") % 8, F.col("p_size") % 5)).cast("array<int>")
    none = F.lit(None).cast("string")
    parts = deal(t("part").select("p_partkey", "p_size"), ["p_partkey"], FEW_DEALT)
    return parts.select("p_partkey", "p_size", F.explode(kinds).alias("kind")).select(
        F.concat_ws("-", F.lit("ADV"), key.cast("string"), F.col("kind").cast("string")).alias("id"), F.lit("words").alias("summary"), none.alias("details"),
        F.array().cast("array<string>").alias("aliases"), F.array().cast("array<struct<type:string,score:string>>").alias("severity"),
        F.struct(F.when(F.col("kind") % 2 == 0, "HIGH").otherwise("LOW").alias("severity")).alias("database_specific"), chosen.alias("affected"),
    )


@QUERIES.query("vulnerability_ranges", """
WITH released AS (
    SELECT l_suppkey AS repo, l_partkey AS part, l_linenumber * 10 + CASE WHEN l_returnflag = 'N' THEN 0 ELSE 5 END AS place, l_linestatus = 'F' AS exact,
           l_linestatus AS spec, CASE WHEN l_partkey % 3 = 0 THEN 'p-' ELSE 'P__' END || l_partkey AS package,
           CASE l_returnflag WHEN 'A' THEN '1.' || l_linenumber || '.0' WHEN 'R' THEN '1.' || l_linenumber
                ELSE CASE WHEN l_partkey % 3 = 0 THEN '1.' || l_linenumber || '.0-rc.1' ELSE 'v1.' || l_linenumber || '.0RC1' END END AS version
    FROM lineitem),
used AS (SELECT repo, part, place, package, version, arg_min(exact, spec) AS exact FROM released GROUP BY ALL),
records AS (SELECT p_partkey AS part, unnest(list_distinct([p_size % 8, p_size % 5])) AS kind FROM part),
found AS (
    SELECT repo, 'ADV-' || part || '-' || kind AS id, package, kind, version, exact FROM used JOIN records USING (part)
    WHERE CASE kind WHEN 0 THEN version IN ('1.2.0', '1.4') WHEN 1 THEN place < 45 WHEN 2 THEN place BETWEEN 25 AND 55 WHEN 3 THEN place = 30
               WHEN 4 THEN place < 25 OR place >= 55 WHEN 5 THEN version = '1.1.0' OR place >= 60 WHEN 6 THEN version = '1.7' OR place BETWEEN 25 AND 34 ELSE false END)
SELECT repo, id, package, CASE WHEN any_value(kind) % 2 = 0 THEN 'critical' ELSE 'warning' END AS severity,
       CASE any_value(kind) WHEN 1 THEN '1.4.0' WHEN 3 THEN '1.3' WHEN 4 THEN '1.2.0' WHEN 6 THEN '1.10' ELSE '' END AS fixed_in, 'words' AS summary,
       CASE WHEN arg_min(exact, version) THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
FROM found GROUP BY repo, id, package""")
def vulnerability_ranges(t: Tables) -> DataFrame:
    """Advisories by list, by range and by both, over versions that are spelled in several ways."""
    return packages.match_advisories(packages.distinct_packages(released(t)), ranged_advisories(t))


@QUERIES.query("framework_detect", """
WITH deps AS (SELECT DISTINCT l_suppkey AS repo, replace(p_name, ' ', '/') AS d FROM lineitem JOIN part ON l_partkey = p_partkey),
rules AS (SELECT unnest(['ring','bolt','widget','small/gear','cold','gizmo']) AS s, unnest(['Ring','Bolt','Widget','Small Gear','Cold','Gizmo']) AS framework)
SELECT DISTINCT repo, framework FROM deps JOIN rules ON contains(d, s)""")
def framework_detect(t: Tables) -> DataFrame:
    parts = t("part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("/")).alias("dependency"))
    deps = t("lineitem").select(F.col("l_suppkey").alias("repo"), "l_partkey").distinct()
    return packages.frameworks(deps.join(parts, F.col("l_partkey") == F.col("p_partkey")), rules=SHAPES)


@QUERIES.query("stack_drift", """
WITH words AS (
    SELECT unnest(['ring','bolt','widget','rod','red','blue','small','large']) AS w,
           unnest(['shape','shape','shape','shape','colour','colour','size','size']) AS family,
           unnest(['Ring','Bolt','Widget','Rod','Red','Blue','Small','Large']) AS display),
claims AS (SELECT p_brand AS repo, p_partkey AS source, family, display FROM part JOIN words ON list_contains(string_split(p_name, ' '), w)),
known AS (
    SELECT repo, family, string_agg(display, ',' ORDER BY display) AS detected FROM (
        SELECT DISTINCT p_brand AS repo, family, display FROM part JOIN words ON contains(p_name, w) WHERE p_size <= 2) GROUP BY ALL)
SELECT repo, source, family, display, detected, NOT list_contains(string_split(detected, ','), display) AS conflict
FROM claims JOIN known USING (repo, family)""")
def stack_drift(t: Tables) -> DataFrame:
    """Part names are documentation of their brand; the brand's smallest parts are its real stack."""
    docs = t("part").select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("source"), F.col("p_name").alias("text"))
    hits = drift.keyword_hits(docs, words=WORDS)
    small = t("part").filter("p_size <= 2").select(F.col("p_brand").alias("repo"), F.col("p_name").alias("dependency"))
    judged = drift.stack_conflicts(hits, drift.detected_stack(small, signals=WORDS))
    return judged.withColumn("detected", F.array_join("detected", ","))


@QUERIES.query("architecture_line", """
WITH services AS (
    SELECT n_regionkey AS system, s_suppkey AS repo, CASE s_suppkey % 5 WHEN 0 THEN 'React' WHEN 1 THEN 'Flask' WHEN 2 THEN 'Django, React' ELSE '' END AS fw,
           CASE WHEN s_acctbal < 3000 THEN 'Docker' ELSE '' END AS infra
    FROM supplier JOIN nation ON s_nationkey = n_nationkey),
tiers AS (
    SELECT system, repo, CASE WHEN contains(fw, 'React') THEN 'Frontend' WHEN fw = 'Flask' THEN 'Backend' WHEN infra <> '' THEN 'Infra' ELSE 'Shared' END AS role,
           CASE WHEN fw <> '' THEN fw WHEN infra <> '' THEN infra ELSE '(no stack detected)' END || ' (' || repo || ')' AS label FROM services),
sized AS (SELECT *, CAST(ceil(count(*) OVER (PARTITION BY system, role) / 4.0) AS BIGINT) AS parts FROM tiers),
placed AS (SELECT *, CAST('0x' || substr(md5(CAST(repo AS VARCHAR)), 1, 7) AS BIGINT) % parts AS part FROM sized)
SELECT system, role, CAST(list_position(['Frontend', 'Backend', 'Infra', 'Shared'], role) AS BIGINT) AS position, part,
       role || ': ' || string_agg(label, ' | ' ORDER BY repo) AS line
FROM placed GROUP BY system, role, part""")
def architecture_line(t: Tables) -> DataFrame:
    """Suppliers as services of their region, about four labels to a part."""
    kind = F.col("s_suppkey") % 5
    none = F.array().cast("array<string>")
    works = (
        F.when(kind == 0, F.array(F.lit("React"))).when(kind == 1, F.array(F.lit("Flask")))
        .when(kind == 2, F.array(F.lit("Django"), F.lit("React"))).otherwise(none)
    )
    signals = F.when(F.col("s_acctbal") < 3000, F.array(F.lit("Docker"))).otherwise(none)
    services = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("system"), F.col("s_suppkey").alias("repo"), works.alias("frameworks"), signals.alias("signals")
    )
    return fleet.architecture_line(fleet.service_tiers(services, ["system", "repo"]), per_part=4)
