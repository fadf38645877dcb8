"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of one data folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


class Registry(dict):
    """``@registry.query("name", sql)`` around a function of the tables."""

    def query(self, name: str, sql: str | None = None) -> Callable:
        def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            if name in self:
                raise ValueError(f"two queries are called {name}")
            self[name] = Query(build, sql)
            return build

        return add


# SQL fragments shared by several checks -------------------------------------------------------------

#: lines(doc_id, source, lang, line_no, line) of documents
LINES = r"""
parts AS (
    SELECT doc_id, source, lang,
           string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS p
    FROM documents),
trimmed AS (SELECT doc_id, source, lang, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM parts),
lines AS (SELECT doc_id, source, lang, unnest(p) AS line, generate_subscripts(p, 1) AS line_no FROM trimmed)
"""

#: assignments(doc_id, source, lang, line_no, line, pos, name, value) of quoted literals
ASSIGNMENTS = (
    LINES
    + r""",
matched AS (
    SELECT doc_id, source, lang, line_no, line,
           regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_]*)\s*=\s*[a-zA-Z]{0,2}(?:""".rstrip()
    + '"""(.*?)"""|'
    + r"""'''(.*?)'''|"(.*?)"|'(.*?)')'""".replace("'''(.*?)'''|\"(.*?)\"|'(.*?)')'", "''''''(.*?)''''''|\"(.*?)\"|''(.*?)'')'")
    + """, 0) AS whole
    FROM lines WHERE contains(line, '=')),
hits AS (SELECT doc_id, source, lang, line_no, line, unnest(whole) AS w, generate_subscripts(whole, 1) AS pos FROM matched),
split_hits AS (
    SELECT *, regexp_extract(w, '^([A-Za-z_][A-Za-z0-9_]*)', 1) AS name,
           regexp_extract(w, '=\\s*([a-zA-Z]{0,2})[''"]', 1) AS prefix,
           regexp_replace(regexp_replace(w, '^[A-Za-z_][A-Za-z0-9_]*\\s*=\\s*[a-zA-Z]{0,2}("{3}|''{3}|"|'')', ''),
                          '("{3}|''{3}|"|'')$', '') AS value
    FROM hits),
assignments AS (
    SELECT * FROM split_hits WHERE NOT (contains(lower(prefix), 'f') AND contains(value, '{')))
"""
)


def entropy_sql(value: str) -> str:
    return f"list_aggregate(string_split({value}, ''), 'entropy')"


def credential_sql(name: str) -> str:
    return (
        "list_has_any(string_split(lower(regexp_replace(replace("
        f"{name}, '-', '_'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_'), "
        "['key','secret','token','password','passwd','credential','credentials','auth','bearer'])"
    )


KNOWN_SQL = (
    "AKIA[0-9A-Z]{16}|sk-[a-zA-Z0-9_\\-]{20,}|gh[pos]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{20,}"
    "|AIza[0-9A-Za-z_\\-]{35}|xox[baprs]-[A-Za-z0-9-]+|eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]*"
)


def verdict_sql(value: str, cutoff: float = 3.5) -> str:
    return f"""CASE
        WHEN regexp_matches({value}, '{KNOWN_SQL}') THEN 'HIGH'
        WHEN regexp_matches({value}, '^[a-z0-9]+(:[a-z0-9-]+)+$') THEN NULL
        WHEN contains({value}, ':') AND regexp_matches({value}, '^[a-z0-9:-]+$') THEN NULL
        WHEN length({value}) < 20 OR regexp_matches({value}, '[\\s.\\[\\]()/]') THEN NULL
        WHEN {entropy_sql(value)} >= {cutoff} THEN 'MEDIUM' END"""


#: secrets(doc_id, source, lang, line_no, confidence); env-style lines are covered by the second branch
SECRETS = (
    ASSIGNMENTS
    + f""",
env AS (
    SELECT doc_id, source, lang, line_no, line, 1000000 AS pos,
           regexp_extract(line, '^\\s*(?:export\\s+)?([A-Z_][A-Z0-9_]*)\\s*=\\s*[^\\s#''"]+\\s*(?:#.*)?$', 1) AS name,
           regexp_extract(line, '^\\s*(?:export\\s+)?[A-Z_][A-Z0-9_]*\\s*=\\s*([^\\s#''"]+)\\s*(?:#.*)?$', 1) AS value
    FROM lines WHERE contains(line, '=')),
candidates AS (
    SELECT doc_id, source, lang, line_no, name, value FROM assignments
    UNION ALL SELECT doc_id, source, lang, line_no, name, value FROM env WHERE name <> ''),
verdicts AS (
    SELECT doc_id, source, lang, line_no, {verdict_sql("value")} AS v FROM candidates
    WHERE {credential_sql("name")} AND NOT (lower(name) IN ('classname','class','style','d')
          OR ends_with(lower(name), 'path') OR ends_with(lower(name), 'pathdata'))),
secrets AS (
    SELECT doc_id, source, lang, line_no, CASE WHEN bool_or(v = 'HIGH') THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
    FROM verdicts WHERE v IS NOT NULL GROUP BY ALL)
"""
)

#: markers(doc_id, source, lang, line_no, marker)
MARKERS = r"""
markers AS (
    SELECT doc_id, source, lang, line_no,
           regexp_extract(line, '(?:^|[^\p{L}\p{N}_])(MIT|Apache|CC)(?:[^\p{L}\p{N}_]|$)', 1) AS marker
    FROM lines WHERE regexp_matches(line, '(?:^|[^\p{L}\p{N}_])(MIT|Apache|CC)(?:[^\p{L}\p{N}_]|$)'))
"""
MARKER_WORDS = ["MIT", "Apache", "CC"]
