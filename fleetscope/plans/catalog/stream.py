"""History operators over events: an event is a commit, its user the repository or author, its type
and counter the subject and file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.moments import epoch_micros
from fleetscope.operators import drift, history, lines
from fleetscope.plans.catalog import web
from fleetscope.plans.catalog.base import Registry, Tables
from fleetscope.sources import gitlog

QUERIES = Registry()

EVENT_NOISE = ["error", "sign"]


def commits(t: Tables) -> DataFrame:
    """``repo, hash, author, ts, date, subject``; the subject is the event type and its counter in tens."""
    k = F.get_json_object("props", "$.k").cast("int")
    return t("events").select(
        F.col("user_id").alias("repo"),
        F.col("event_id").alias("hash"),
        F.col("user_id").alias("author"),
        "ts",
        F.to_date("ts").cast("string").alias("date"),
        F.concat_ws(" ", "event_type", F.floor(k / 10).cast("string")).alias("subject"),
    )


#: commits(repo, hash, author, ts, date, subject)
COMMITS = """
commits AS (
    SELECT user_id AS repo, event_id AS hash, user_id AS author, ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
           event_type || ' ' || (CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) // 10) AS subject
    FROM events)
"""


def collapse_sql(source: str) -> str:
    """runs(repo, hash, author, date, subject, commits, last_ts) over a CTE in the shape of commits."""
    return f"""
based AS (SELECT *, nullif(regexp_extract(subject, '^(.+?)\\s+([0-9]+(?:[.][0-9]+)*|\\w+)$', 1), '') AS base FROM {source}),
linked AS (SELECT *, lag(lower(base)) OVER (PARTITION BY repo ORDER BY ts, hash) AS before FROM based),
started AS (SELECT *, CASE WHEN lower(base) = before THEN 0 ELSE 1 END AS start FROM linked),
islands AS (SELECT *, sum(start) OVER (PARTITION BY repo ORDER BY ts, hash ROWS UNBOUNDED PRECEDING) AS run FROM started),
runs AS (
    SELECT repo, count(*) AS commits, max(ts) AS last_ts, arg_max(hash, ts) AS hash, arg_max(author, ts) AS author,
           CASE WHEN count(*) >= 2 THEN arg_min(date, ts) || ' — ' || arg_max(date, ts) ELSE arg_max(date, ts) END AS date,
           CASE WHEN count(*) >= 2 THEN arg_max(base, ts) || ': ' || count(*) || ' iterations' ELSE arg_max(subject, ts) END AS subject
    FROM islands GROUP BY repo, run)
"""


@QUERIES.query("commit_log", """
SELECT user_id AS repo, CAST(event_id AS VARCHAR) AS hash, 'u' || user_id AS author, CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
       event_type || ' | ' || value AS subject
FROM events WHERE event_type <> 'error'""".replace("|| value", "|| CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)"))
def commit_log(t: Tables) -> DataFrame:
    """Log lines made of events; errors give lines that lack a field, subjects hold a bar themselves."""
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    subject = F.concat_ws(" | ", "event_type", cents)
    head = [F.col("event_id").cast("string"), F.concat(F.lit("  u"), F.col("user_id").cast("string")), F.to_date("ts").cast("string")]
    line = F.when(F.col("event_type") == "error", F.concat_ws("|", *head)).otherwise(
        F.concat(F.lit("  "), F.concat_ws("|", *head, subject), F.lit(" "))
    )
    return gitlog.parse_commit_log(t("events").select(F.col("user_id").alias("repo"), line.alias("line")))


@QUERIES.query("commit_meta", """
SELECT user_id AS repo, sha1(CAST(event_id AS VARCHAR)) AS sha, 'u' || user_id AS author, user_id || '@x.org' AS email,
       CAST(epoch(ts) AS BIGINT) AS epoch, event_type || chr(10) || chr(10) || props AS message
FROM events""".replace("CAST(epoch(ts) AS BIGINT)", "CAST(floor(epoch(ts)) AS BIGINT)"))
def commit_meta(t: Tables) -> DataFrame:
    """Metadata blocks made of events, with an empty and a malformed block after each."""
    fields = [
        F.sha1(F.col("event_id").cast("string").cast("binary")),
        F.concat(F.lit("u"), F.col("user_id").cast("string")),
        F.concat(F.col("user_id").cast("string"), F.lit("@x.org")),
        F.floor(epoch_micros(t("events"), "ts") / 1_000_000).cast("string"),
        F.concat(F.col("event_type"), F.lit("\n\n"), F.col("props"), F.lit("\n")),
    ]
    text = F.concat(F.concat_ws("<<>>", *fields), F.lit("<<>>END\n\n<<>>END\nbroken<<>>block<<>>END"))
    parsed = gitlog.parse_commit_meta(t("events").select(F.col("user_id").alias("repo"), text.alias("text")))
    return parsed.select("repo", "sha", "author", "email", F.unix_seconds("ts").alias("epoch"), "message")


@QUERIES.query("noise_filter", f"""
WITH {COMMITS}
SELECT repo, count(*) AS commits_read, count(*) FILTER (NOT regexp_matches(subject, '(?i)^(error|sign)')) AS commits_kept,
       count(*) FILTER (regexp_matches(subject, '(?i)^(error|sign)')) AS commits_dropped FROM commits GROUP BY repo""")
def noise_filter(t: Tables) -> DataFrame:
    return history.noise_counts(commits(t), prefixes=EVENT_NOISE)


@QUERIES.query("collapse_runs", f"WITH {COMMITS}, {collapse_sql('commits')} SELECT repo, hash, author, date, subject, commits FROM runs")
def collapse_runs(t: Tables) -> DataFrame:
    """Whole histories, carried day by day."""
    return history.collapse_runs(commits(t), block=F.col("date")).drop("ordering")


@QUERIES.query("commit_timeline", f"""
WITH {COMMITS},
kept AS (SELECT * FROM commits WHERE NOT regexp_matches(subject, '(?i)^(error|sign)')),
{collapse_sql('kept')}
SELECT repo, hash, author, date, subject, commits, CAST(row_number() OVER (PARTITION BY repo ORDER BY last_ts DESC) AS INTEGER) AS position
FROM runs QUALIFY position <= 15""")
def commit_timeline(t: Tables) -> DataFrame:
    return history.timeline(commits(t), keep=15, prefixes=EVENT_NOISE)


def touches(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t("events").select(
        F.col("user_id").alias("repo"), "ts", F.concat_ws("/", "event_type", F.concat(F.lit("d"), (k % 3).cast("string")), F.lit("f.py")).alias("path")
    )


#: touches(repo, ts, path) and churn(repo, path, changes) of each repository's last ten days
TOUCHES = """
touches AS (SELECT user_id AS repo, ts, event_type || '/d' || (CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) % 3) || '/f.py' AS path FROM events)
"""
CHURN = TOUCHES + """,
churn AS (SELECT repo, path, count(*) AS changes FROM touches
          WHERE ts >= (SELECT max(ts) FROM events WHERE user_id = repo) - INTERVAL 10 DAY GROUP BY ALL)
"""


@QUERIES.query("hotspots", f"WITH {CHURN} SELECT repo, path, changes, CAST(row_number() OVER (PARTITION BY repo ORDER BY changes DESC, path) AS INTEGER) AS rank FROM churn QUALIFY rank <= 5")
def hotspots(t: Tables) -> DataFrame:
    return history.hotspots(history.churn(touches(t), days=10))


@QUERIES.query("topk_per_group", f"WITH {CHURN} SELECT repo, path, changes FROM churn QUALIFY row_number() OVER (PARTITION BY repo ORDER BY changes DESC, path) <= 3")
def topk_per_group(t: Tables) -> DataFrame:
    return history.hotspots(history.churn(touches(t), days=10), k=3).drop("rank")


@QUERIES.query("hotspot_matrix", f"""
WITH {CHURN}
SELECT CAST(row_number() OVER (ORDER BY changes DESC, repo, path) AS INTEGER) AS rank, repo, path, changes FROM churn QUALIFY rank <= 25""")
def hotspot_matrix(t: Tables) -> DataFrame:
    return history.hotspot_matrix(history.churn(touches(t), days=10))


@QUERIES.query("hotspot_sort", f"WITH {CHURN} SELECT repo, path, changes FROM churn ORDER BY changes DESC, path, repo")
def hotspot_sort(t: Tables) -> DataFrame:
    return history.sort_hotspots(history.churn(touches(t), days=10))


@QUERIES.query("hotspot_density", f"""
WITH {CHURN}, m AS (SELECT *, max(changes) OVER (PARTITION BY repo) AS top FROM churn)
SELECT repo, path, changes, CAST(round_even(changes / top * 100, 0) AS INTEGER) AS density,
       CAST(greatest(1, round_even(changes * 12 / top, 0)) AS INTEGER) AS cells,
       CASE WHEN changes / top > 2 / 3 THEN 'red' WHEN changes / top > 1 / 3 THEN 'yellow' ELSE 'green' END AS heat FROM m""")
def hotspot_density(t: Tables) -> DataFrame:
    return history.hotspot_density(history.churn(touches(t), days=10))


@QUERIES.query("module_churn", f"""
WITH {TOUCHES}
SELECT repo, CASE WHEN path LIKE 'view/%' THEN regexp_extract(path, '^(view/d[0-9]/)', 1) ELSE regexp_extract(path, '^([a-z]+/)', 1) END AS module,
       count(*) AS changes
FROM touches WHERE path NOT LIKE 'signup/%' AND ts >= (SELECT max(ts) FROM events WHERE user_id = repo) - INTERVAL 10 DAY GROUP BY ALL""")
def module_churn(t: Tables) -> DataFrame:
    """``view`` is a monorepo bucket; files below ``signup`` are not eligible."""
    found = touches(t)
    eligible = found.filter(~F.col("path").startswith("signup/")).select("repo", "path").distinct()
    return history.module_churn(found, days=10, eligible=eligible, buckets=["view"])


@QUERIES.query("burst_detect", """
WITH ordered AS (SELECT user_id, ts, lead(ts, 2) OVER (PARTITION BY user_id ORDER BY ts) AS third FROM events)
SELECT user_id, coalesce(bool_or(third - ts <= INTERVAL 30 MINUTE), false) AS burst FROM ordered GROUP BY user_id""")
def burst_detect(t: Tables) -> DataFrame:
    return history.bursts(t("events"), ["user_id"])


ENV = r"""
texts AS (
    SELECT user_id AS repo, ts,
           'export KEY_' || upper(event_type) || '=' || event_id || chr(10) || 'low_case=1' || chr(10) || '# process.env.SEEN_' || upper(event_type)
           || ' and $RAW_' || regexp_extract(props, '"k": ([0-9]+)', 1) || ' $AB' AS text
    FROM events)
"""


def env_texts(t: Tables) -> DataFrame:
    kind = F.upper("event_type")
    text = F.concat(
        F.lit("export KEY_"), kind, F.lit("="), F.col("event_id").cast("string"), F.lit("\nlow_case=1\n# process.env.SEEN_"), kind,
        F.lit(" and $RAW_"), F.get_json_object("props", "$.k"), F.lit(" $AB"),
    )
    return t("events").select(F.col("user_id").alias("repo"), "ts", text.alias("text"))


@QUERIES.query("env_keys", f"""
WITH {ENV}
SELECT DISTINCT repo, 'defined' AS side, unnest(regexp_extract_all(text, '(?m)^(?:export\\s+)?([A-Z][A-Z0-9_]*)\\s*=', 1)) AS key FROM texts
UNION ALL
SELECT DISTINCT repo, 'documented', unnest(list_concat(regexp_extract_all(text, 'process[.]env[.]([A-Z][A-Z0-9_]*)', 1),
       regexp_extract_all(text, '[$]([A-Z][A-Z0-9_][A-Z0-9_]+)\\b', 1))) FROM texts""")
def env_keys(t: Tables) -> DataFrame:
    texts = env_texts(t)
    defined = lines.env_definitions(texts).select("repo", F.lit("defined").alias("side"), "key")
    documented = lines.env_references(texts).select("repo", F.lit("documented").alias("side"), "key")
    return defined.unionByName(documented)


#: gaps(repo, key, gap)
GAPS = """
defined AS (SELECT DISTINCT user_id AS repo, event_type AS key FROM events WHERE day(ts) % 2 = 1),
documented AS (SELECT DISTINCT user_id AS repo, event_type AS key FROM events
               WHERE day(ts) % 2 = 0 AND user_id IN (SELECT repo FROM defined)),
gaps AS (
    SELECT coalesce(d.repo, m.repo) AS repo, coalesce(d.key, m.key) AS key,
           CASE WHEN m.key IS NULL THEN 'missing_in_docs' WHEN d.key IS NULL THEN 'extra_in_docs' END AS gap
    FROM defined d FULL OUTER JOIN documented m ON d.repo = m.repo AND d.key = m.key)
"""


def gaps(t: Tables) -> DataFrame:
    """Event types of a user: defined on odd days, documented on even ones."""
    events = t("events").select(F.col("user_id").alias("repo"), F.col("event_type").alias("key"), "ts")
    first = events.filter("day(ts) % 2 = 1")
    second = events.filter("day(ts) % 2 = 0")
    return drift.env_gaps(first, second)


@QUERIES.query("env_drift", f"""
WITH {GAPS}
SELECT repo, count(gap) AS gaps, count(*) AS keys, round_even(1 - count(gap) / count(*), 4) AS env_ratio FROM gaps GROUP BY repo""")
def env_drift(t: Tables) -> DataFrame:
    return drift.env_ratio(gaps(t))


@QUERIES.query("freshness_score", f"""
WITH {GAPS},
env AS (SELECT repo, round_even(1 - count(gap) / count(*), 4) AS env_ratio FROM gaps GROUP BY repo),
latest AS (
    SELECT user_id AS repo, max(ts) FILTER (event_type = 'view') AS doc, max(ts) AS code,
           count(*) FILTER (ts >= newest - INTERVAL 1 DAY) AS recent
    FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS newest FROM events) GROUP BY user_id),
lag AS (SELECT *, CASE WHEN recent >= 3 THEN 1.0 ELSE 2.0 END AS grace, greatest(0, epoch_us(code) - epoch_us(doc)) / 86400000000 AS age FROM latest),
rec AS (
    SELECT repo, CASE WHEN doc IS NULL OR age <= grace THEN 1.0 ELSE round_even(greatest(0, 1 - (age - grace) / grace), 4) END AS recency_ratio
    FROM lag),
scored AS (
    SELECT repo, CAST(1.0 AS DOUBLE) AS path_ratio, CAST(1.0 AS DOUBLE) AS stack_ratio, coalesce(env_ratio, 1.0) AS env_ratio, CAST(recency_ratio AS DOUBLE) AS recency_ratio
    FROM rec LEFT JOIN env USING (repo)),
final AS (
    SELECT *, CAST(round_even(round((0.35 * path_ratio + 0.35 * stack_ratio + 0.15 * env_ratio + 0.15 * recency_ratio) * 100, 10), 0) AS INTEGER) AS freshness_score
    FROM scored)
SELECT *, CASE WHEN freshness_score >= 90 THEN 'Fresh' WHEN freshness_score >= 70 THEN 'Needs Review' ELSE 'Stale' END AS freshness_label FROM final""")
def freshness_score(t: Tables) -> DataFrame:
    """Views are documentation touches; grace of two days, one for users with three events in the last day."""
    events = t("events").select(F.col("user_id").alias("repo"), "ts", F.col("event_id").alias("hash"), "event_type")
    recent = drift.recency(events, F.col("event_type") == "view", active_days=1, quiet_days=2, active_commits=3)
    return drift.freshness(events, env=drift.env_ratio(gaps(t)), recent=recent)


@QUERIES.query("drift_items", f"""
WITH {web.CHECKED}, {GAPS},
items AS (
    SELECT repo, 'warning' AS severity, 'HIGH' AS confidence, 'path' AS kind, CAST(source AS VARCHAR) AS source,
           source || ' references `' || path || '` which no longer exists in the codebase' AS message
    FROM checked WHERE NOT valid
    UNION ALL
    SELECT CAST(repo AS VARCHAR), CASE gap WHEN 'missing_in_docs' THEN 'warning' ELSE 'info' END, 'MEDIUM', 'env',
           CASE gap WHEN 'missing_in_docs' THEN '.env.example' ELSE 'documentation' END,
           CASE gap WHEN 'missing_in_docs' THEN '`.env.example` defines `' || key || '` but it is not documented in project docs'
                ELSE 'Documentation references env var `' || key || '` but it is missing from `.env.example`' END
    FROM gaps WHERE gap IS NOT NULL)
SELECT * FROM items""")
def drift_items(t: Tables) -> DataFrame:
    env = drift.env_items(gaps(t).withColumn("repo", F.col("repo").cast("string")))
    return drift.drift_items(drift.path_items(web.checked(t)), env)
