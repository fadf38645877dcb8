"""Text operators over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import labels, secrets, text
from fleetscope.operators import drift, lines, scope, snapshot, tokens
from fleetscope.plans.catalog.base import (
    ASSIGNMENTS,
    LINES,
    MARKER_WORDS,
    MARKERS,
    SECRETS,
    Registry,
    Tables,
    credential_sql,
    entropy_sql,
    verdict_sql,
)

QUERIES = Registry()

LICENSE_WORDS = [
    ("mit", "permissive", "MIT"),
    ("mit license", "permissive", "MIT"),
    ("apache", "permissive", "Apache"),
    ("apache license", "permissive", "Apache"),
    ("cc by-nc", "attribution", "CC"),
    ("all rights reserved", "closed", "Reserved"),
]
LICENSE_TOOLS = [("mit", "MIT"), ("apache", "Apache"), ("cc by", "CC"), ("rights reserved", "Reserved")]
LICENSE_SIGNATURE = r"(?iU)(?:released under the MIT|licensed under|all rights reserved)"


def word_sql(word: str) -> str:
    return rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){word}([^\p{{L}}\p{{N}}_]|$)')"


@QUERIES.query("file_scan", """
SELECT source AS repo, lang || '/' || doc_id || '.txt' AS path, length(text) AS size, text = '' AS is_empty
FROM documents WHERE lang <> 'es' AND NOT regexp_matches(doc_id || '.txt', '^1.*3[.]txt$')""")
def file_scan(t: Tables) -> DataFrame:
    """Every scannable file, minus the folder ``es/`` and names ``1*3.txt``."""
    name = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = t("documents").select(F.col("source").alias("repo"), name.alias("path"), F.col("text").alias("content"))
    kept = scope.text_files(scope.drop_ignored(files, patterns=["es/", "1*3.txt"]))
    return kept.select("repo", "path", F.length("content").alias("size"), (F.col("content") == "").alias("is_empty"))


@QUERIES.query("line_explode", f"WITH {LINES} SELECT doc_id, line_no, line FROM lines")
def line_explode(t: Tables) -> DataFrame:
    return lines.explode_lines(t("documents"), "text", ["doc_id"])


@QUERIES.query("marker_scan", f"WITH {LINES}, {MARKERS} SELECT source, doc_id, line_no, marker, 'LOW' AS confidence FROM markers")
def marker_scan(t: Tables) -> DataFrame:
    return lines.scan_markers(t("documents"), "text", ["source", "doc_id"], MARKER_WORDS)


@QUERIES.query("secret_scan", f"WITH {SECRETS} SELECT source, doc_id, line_no, confidence FROM secrets")
def secret_scan(t: Tables) -> DataFrame:
    return lines.scan_secrets(t("documents"), "text", "doc_id", ["source", "doc_id"])


@QUERIES.query("classify_values", f"""
WITH {ASSIGNMENTS}
SELECT doc_id, line_no, name, value,
       coalesce(CASE WHEN regexp_matches(value, '^[0-4]') THEN 'LOW' ELSE {verdict_sql("value", 3.7)} END, 'NONE') AS confidence
FROM assignments""")
def classify_values(t: Tables) -> DataFrame:
    """All quoted literals, with a user pattern and a higher cutoff."""
    numbered = lines.explode_lines(t("documents").filter(F.col("text").contains("=")), "text", ["doc_id"])
    found = numbered.select(
        "doc_id", "line_no", F.explode(secrets.assignments(F.col("line"))).alias("a")
    ).select("doc_id", "line_no", "a.name", "a.value")
    verdict = secrets.classify_value(F.col("value"), 3.7, [("^[0-4]", "LOW")])
    return found.withColumn("confidence", F.coalesce(verdict, F.lit("NONE")))


@QUERIES.query("text_entropy", f"SELECT doc_id, round({entropy_sql('text')}, 6) AS entropy FROM documents")
def text_entropy(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.round(text.text_entropy(F.col("text")), 6).alias("entropy"))


@QUERIES.query("credential_names", f"""
WITH named AS (
    SELECT p_partkey, split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)
           || CASE p_partkey % 5 WHEN 0 THEN 'Key' WHEN 1 THEN '_id' WHEN 2 THEN '-auth-hash' WHEN 3 THEN 'Monkey' ELSE '_TOKEN' END AS name
    FROM part)
SELECT p_partkey, name,
       array_to_string(string_split(lower(regexp_replace(replace(name, '-', '_'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_'), ',') AS words,
       {credential_sql("name")} AS is_credential
FROM named""")
def credential_names(t: Tables) -> DataFrame:
    """Identifiers made of part names in several spellings."""
    last = F.split_part("p_name", F.lit(" "), F.lit(2))
    kind = F.col("p_partkey") % 5
    ending = F.when(kind == 0, "Key").when(kind == 1, "_id").when(kind == 2, "-auth-hash").when(kind == 3, "Monkey").otherwise("_TOKEN")
    name = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.initcap(last), ending)
    named = t("part").select("p_partkey", name.alias("name"))
    return named.select(
        "p_partkey", "name",
        F.array_join(secrets.identifier_words(F.col("name")), ",").alias("words"),
        secrets.names_credential(F.col("name")).alias("is_credential"),
    )


TOKENS = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, length({0}) // 4) END"


@QUERIES.query("token_estimate", f"SELECT doc_id, CAST({TOKENS.format('text')} AS BIGINT) AS tokens FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@QUERIES.query("corpus_tokens", f"""
SELECT coalesce(source, '*') AS repo, CAST(sum({TOKENS.format('text')}) AS BIGINT) AS tokens, count(*) AS files,
       source IS NULL AS is_total
FROM documents GROUP BY ROLLUP (source)""")
def corpus_tokens(t: Tables) -> DataFrame:
    counted = tokens.corpus_tokens(t("documents"), "source", "text")
    return counted.select(F.coalesce("source", F.lit("*")).alias("repo"), "tokens", "files", "is_total")


@QUERIES.query("countable_tokens", f"""
SELECT source AS repo, CAST(sum({TOKENS.format('text')}) AS BIGINT) AS tokens, count(*) AS files FROM documents
WHERE n_chars % 7 NOT IN (0, 1, 2) AND NOT contains(text, chr(0)) GROUP BY source""")
def countable_tokens(t: Tables) -> DataFrame:
    """Documents named like reports of the tool and like binary files, which do not count, among others."""
    kind = F.col("n_chars") % 7
    name = F.when(kind == 0, "out/FLEETSCOPE.md").when(kind == 1, "FLEETSCOPE-SYSTEM.json").when(kind == 2, "x/y.PDF").otherwise("notes.md")
    named = t("documents").select(F.col("source").alias("repo"), name.alias("path"), F.col("text").alias("content"))
    return tokens.corpus_tokens(scope.countable_files(named)).filter("NOT is_total").select("repo", "tokens", "files")


# path, line and expected confidence; {x} is a run of 24 hexadecimal digits of the document, {u} the same in upper case
CREDENTIALS = [
    ("a.py", 'key = "AKIA{u16}"', "HIGH"),
    ("a.py", "auth_token = 'sk-{x}'", "HIGH"),
    ("a.py", 'TOKEN="ghp_{x}{x}"', "HIGH"),
    ("a.py", 'api_key = "github_pat_{x}"', "HIGH"),
    ("a.py", "secret = 'AIza{x}{x11}'", "HIGH"),
    ("a.py", 'bearer = "xoxb-{x}"', "HIGH"),
    ("a.py", 'credential = "eyJ{x}.{x}."', "HIGH"),
    ("a.py", 'classname = "sk-{x}"', None),
    ("a.py", 'icon_key_path = "sk-{x}"', None),
    ("alembic/versions/1.py", 'revision = "sk-{x}"', None),
    ("db/migrations/2.py", 'down_revision_key = "sk-{x}"', "HIGH"),
    ("a.py", 'key = "some:namespaced-value-{x}"', None),
    ("a.py", 'key = f"sk-{x}{brace}"', None),
    ("a.py", 'key = "short"', None),
]


@QUERIES.query("credential_formats", "SELECT doc_id, kind, CASE WHEN kind IN (" + ", ".join(str(n) for n, c in enumerate(CREDENTIALS) if c[2]) + """) THEN 'HIGH' END AS confidence
FROM documents, (SELECT CAST(unnest(range(""" + str(len(CREDENTIALS)) + ")) AS INTEGER) AS kind)")
def credential_formats(t: Tables) -> DataFrame:
    """Known key formats, excluded names, ids of migrations, namespaced values, templates, all with digits of the document."""
    digits = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 24)
    cases = []
    for n, (path, line, _) in enumerate(CREDENTIALS):
        text = F.replace(F.replace(F.lit(line), F.lit("{x11}"), F.substring(digits, 1, 11)), F.lit("{x}"), digits)
        text = F.replace(F.replace(text, F.lit("{u16}"), F.upper(F.substring(digits, 1, 16))), F.lit("{brace}"), F.lit("{name}"))
        cases.append(F.struct(F.lit(n).alias("kind"), F.lit(path).alias("path"), text.alias("line")))
    rows = t("documents").select("doc_id", F.inline(F.array(*cases)))
    return rows.select("doc_id", "kind", secrets.line_confidence(F.col("line"), F.col("path")).alias("confidence"))


PREVIEW = r"""
WITH parts AS (
    SELECT doc_id, source, lang, text,
           string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS p FROM documents),
trimmed AS (SELECT doc_id, source, lang, text, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM parts)
"""


@QUERIES.query("token_savings", PREVIEW + f""",
tok AS (
    SELECT source, CAST(sum({TOKENS.format('text')}) AS BIGINT) AS raw_tokens,
           CAST(sum({TOKENS.format("array_to_string(p[1:10], chr(10))")}) AS BIGINT) AS brief_tokens
    FROM trimmed GROUP BY source)
SELECT source AS repo, raw_tokens, brief_tokens, round_even((1 - brief_tokens / raw_tokens) * 100, 2) AS savings,
       CASE WHEN raw_tokens >= 1000000 THEN regexp_replace(printf('%.1f', raw_tokens / 1000000), '[.]0$', '') || 'M'
            WHEN raw_tokens >= 1000 THEN regexp_replace(printf('%.1f', raw_tokens / 1000), '[.]0$', '') || 'k'
            ELSE CAST(raw_tokens AS VARCHAR) END AS raw_label
FROM tok""")
def token_savings(t: Tables) -> DataFrame:
    """Whole texts against their first ten lines."""
    docs = t("documents").select(F.col("source").alias("repo"), "text")
    raw = docs.groupBy("repo").agg(F.sum(text.token_estimate(F.col("text"))).alias("tokens"))
    brief = docs.groupBy("repo").agg(F.sum(text.token_estimate(text.preview(F.col("text"), True))).alias("tokens"))
    return tokens.token_savings(raw, brief)


@QUERIES.query("text_preview", PREVIEW + """
SELECT doc_id, len(p) AS lines_count,
       CASE WHEN lang = 'fr' OR len(p) >= 200 THEN array_to_string(p[1:10], chr(10)) ELSE text END AS preview,
       CASE WHEN length(text) <= 500 THEN text ELSE rtrim(substr(text, 1, 491), ' ' || chr(9) || chr(10) || chr(13)) || ' (to cut)' END AS cut
FROM trimmed""")
def text_preview(t: Tables) -> DataFrame:
    """French documents play the README; ``cut`` is the length-limited form."""
    body = F.col("text")
    return t("documents").select(
        "doc_id",
        F.size(text.lines(body)).cast("bigint").alias("lines_count"),
        text.preview(body, F.col("lang") == "fr").alias("preview"),
        text.truncate(body, 500, " (to cut)").alias("cut"),
    )


FINGERPRINT = """
digests AS (SELECT {keys}, sha256({token}) AS d FROM documents {where}),
words AS (SELECT {keys}, unnest(range(8)) AS n, d FROM digests),
sums AS (SELECT {keys}, n, sum(CAST('0x' || substr(d, CAST(1 + 8 * n AS INTEGER), 8) AS HUGEINT)) AS s FROM words GROUP BY ALL),
sizes AS (SELECT {keys}, count(*) AS files FROM digests GROUP BY ALL),
prints AS (
    SELECT {keys}, any_value(files) AS files,
           sha256(chr(10) || any_value(files) || chr(10) || string_agg(CAST(s AS VARCHAR), chr(10) ORDER BY n)) AS fingerprint
    FROM sums JOIN sizes USING ({keys}) GROUP BY {keys})
"""
TOKEN = "doc_id || ':' || n_chars || ':' || lang"


@QUERIES.query("fingerprint", "WITH " + FINGERPRINT.format(keys="source", token=TOKEN, where="") + "SELECT source, files, fingerprint FROM prints")
def fingerprint(t: Tables) -> DataFrame:
    token = snapshot.file_token(F.col("doc_id"), F.col("n_chars"), F.col("lang"))
    return snapshot.fingerprint(t("documents"), token, ["source"])


@QUERIES.query("changed_since_snapshot", "WITH " + FINGERPRINT.format(keys="source, lang", token=TOKEN, where="") + """,
touched AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 97 = 0)
SELECT source, lang, files FROM prints JOIN touched USING (source, lang)
UNION
SELECT source, lang, files FROM prints WHERE lang = 'de'""")
def changed_since_snapshot(t: Tables) -> DataFrame:
    """Groups whose documents differ from a snapshot without every 97th, or whose snapshot (German)
    was taken with a higher threshold than now asked for."""
    docs = t("documents")
    token = snapshot.file_token(F.col("doc_id"), F.col("n_chars"), F.col("lang"))
    keys = ["source", "lang"]
    current = snapshot.fingerprint(docs, token, keys)
    old = snapshot.fingerprint(docs.filter("doc_id % 97 <> 0"), token, keys).withColumn(
        "min_confidence", F.when(F.col("lang") == "de", "high").otherwise("low")
    )
    return snapshot.stale(current, old, keys, "medium").select(*keys, "files")


def placed(docs: DataFrame) -> DataFrame:
    """Documents as files three folders deep, some straight in a folder above."""
    folder = F.concat_ws("/", F.concat(F.lit("k"), (F.col("n_chars") % 7).cast("string")), "lang", F.concat(F.lit("d"), (F.col("n_chars") % 5).cast("string")))
    name = F.when(F.col("n_chars") % 11 == 0, F.col("lang")).when(F.col("n_chars") % 11 == 1, "").otherwise(folder)
    return docs.withColumn("path", F.concat_ws("/", F.nullif(name, F.lit("")), F.concat(F.lit("f"), F.col("doc_id").cast("string"))))


_PLACED = """
placed AS (
    SELECT source, doc_id, n_chars, CASE n_chars % 11 WHEN 0 THEN lang || '/' WHEN 1 THEN ''
           ELSE 'k' || (n_chars % 7) || '/' || lang || '/d' || (n_chars % 5) || '/' END || 'f' || doc_id AS path FROM documents),
new_files AS (
    SELECT CASE source WHEN 'src1' THEN 'here' ELSE source END AS source, CASE WHEN doc_id % 89 = 0 THEN 'moved/' ELSE '' END || path AS path,
           CAST(n_chars AS VARCHAR) AS token FROM placed),
old_files AS (
    SELECT CASE source WHEN 'src2' THEN 'there' ELSE source END AS source, CASE WHEN doc_id % 97 = 0 THEN 'k0/' ELSE '' END || path AS path,
           CAST(n_chars + CASE WHEN doc_id % 83 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS token FROM placed),
"""


@QUERIES.query("changed_paths", "WITH " + _PLACED + """
both_files AS (SELECT source, path, n.token AS n, o.token AS o FROM new_files n FULL OUTER JOIN old_files o USING (source, path)),
places AS (
    SELECT source, path AS file, n, o, unnest(list_concat([''], list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/')))) AS path
    FROM both_files),
folders AS (
    SELECT source, 'folder' AS kind, path, CASE WHEN count(o) = 0 THEN 'new' WHEN count(n) = 0 THEN 'gone' ELSE 'changed' END AS state
    FROM places GROUP BY source, path HAVING bool_or(n IS DISTINCT FROM o))
SELECT * FROM folders
UNION ALL
SELECT source, 'file', path, CASE WHEN o IS NULL THEN 'new' WHEN n IS NULL THEN 'gone' ELSE 'changed' END FROM both_files WHERE n IS DISTINCT FROM o""")
def changed_paths(t: Tables) -> DataFrame:
    """Two states of all documents: some lie elsewhere on either side, some differ, and a source each is new and gone."""
    docs, key = placed(t("documents")), F.col("doc_id")
    under = lambda divisor, folder: F.concat(F.when(key % divisor == 0, folder).otherwise(""), F.col("path"))
    named = lambda was, now: F.when(F.col("source") == was, now).otherwise(F.col("source"))
    new = docs.select(named("src1", "here").alias("source"), under(89, "moved/").alias("path"), F.col("n_chars").alias("token"))
    old = docs.select(
        named("src2", "there").alias("source"), under(97, "k0/").alias("path"), (F.col("n_chars") + F.when(key % 83 == 0, 1).otherwise(0)).alias("token")
    )
    kept = [snapshot.file_digests(side, F.col("token").cast("string"), ["source"]) for side in (new, old)]
    return snapshot.changed_paths(*kept, ["source"], 1)


@QUERIES.query("keyword_hits", f"""
WITH hits AS (
    SELECT source, doc_id, 'permissive' AS family, 'MIT' AS display, 'mit license' AS keyword, 1 AS n FROM documents WHERE {word_sql('mit license')}
    UNION ALL SELECT source, doc_id, 'permissive', 'MIT', 'mit', 2 FROM documents WHERE {word_sql('mit')}
    UNION ALL SELECT source, doc_id, 'permissive', 'Apache', 'apache license', 1 FROM documents WHERE {word_sql('apache license')}
    UNION ALL SELECT source, doc_id, 'permissive', 'Apache', 'apache', 2 FROM documents WHERE {word_sql('apache')}
    UNION ALL SELECT source, doc_id, 'attribution', 'CC', 'cc by-nc', 1 FROM documents WHERE {word_sql('cc by-nc')}
    UNION ALL SELECT source, doc_id, 'closed', 'Reserved', 'all rights reserved', 1 FROM documents WHERE {word_sql('all rights reserved')})
SELECT source, doc_id, family, display, arg_min(keyword, n) AS keyword FROM hits GROUP BY ALL""")
def keyword_hits(t: Tables) -> DataFrame:
    return drift.keyword_hits(t("documents"), "text", ["source", "doc_id"], LICENSE_WORDS)


@QUERIES.query("tool_labels", f"""
WITH hits AS (
    SELECT doc_id, 'MIT' AS tool FROM documents WHERE {word_sql('mit')}
    UNION SELECT doc_id, 'Apache' FROM documents WHERE {word_sql('apache')}
    UNION SELECT doc_id, 'CC' FROM documents WHERE {word_sql('cc by')}
    UNION SELECT doc_id, 'Reserved' FROM documents WHERE {word_sql('rights reserved')})
SELECT doc_id, string_agg(tool, ',' ORDER BY tool) AS tools, any_value(source) = 'src1' OR any_value(source) LIKE 'src1_' AS is_bot
FROM hits JOIN documents USING (doc_id) GROUP BY doc_id""")
def tool_labels(t: Tables) -> DataFrame:
    """Labels in the text, and whether the author name (the source) contains a bot's needle."""
    author = labels.tools_of_author(F.col("source"), F.lit("x@y"), [("src1", "One"), ("rc1", "One")])
    return (
        t("documents")
        .select("doc_id", labels.tools_in_text(F.col("text"), LICENSE_TOOLS).alias("t"), (F.size(author) == 1).alias("is_bot"))
        .filter(F.size("t") > 0)
        .select("doc_id", F.array_join("t", ",").alias("tools"), "is_bot")
    )


@QUERIES.query("inline_signature", """
SELECT source, doc_id FROM documents
WHERE regexp_matches(text, '(?i)(released under the MIT|licensed under|all rights reserved)')""")
def inline_signature(t: Tables) -> DataFrame:
    marked = labels.inline_signature(F.col("text"), LICENSE_SIGNATURE)
    return t("documents").filter(marked).select("source", "doc_id")
