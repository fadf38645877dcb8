"""One query per operator over the given tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import (
    byte_bpe, decontamination, exact_dedup, jaccard_join, language_id, lexical_search, passages, phrases, secret_scan,
    shared, token_records, toxicity, url_filter, warc,
)


@dataclass(frozen=True)
class LlmQuery:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(spark, folder)


#: The rules of the URL query, as the contract fixes them.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = shared.table(spark, folder, "documents"), shared.table(spark, folder, "labels")
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "toxic")
    chosen = shared.bounded_sample(known, toxicity.TRAINING_ROWS, "doc_id", "toxic")
    sample = shared.cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    held = F.pmod(F.xxhash64("text"), F.lit(toxicity.HELD_OUT)) == 0
    limit = toxicity.toxic_limit(toxicity.fit_ordinal(toxicity.severity_grades(sample.filter(~held))), sample.filter(held))
    model = toxicity.fit_ordinal(toxicity.severity_grades(sample))
    scored = toxicity.score_severity(docs.select("doc_id", "text"), model)
    toxic = F.col("severity") >= limit
    grade = F.when(toxic, F.greatest(F.lit(1), F.round("severity").cast("int"))).when(~toxic, 0)
    return scored.select("doc_id", "severity", grade.alias("grade"), toxic.alias("toxic"))


def decontamination_query(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contained_pairs(shared.table(spark, folder, "documents"), shared.table(spark, folder, "benchmark"))


def passages_query(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(shared.table(spark, folder, "documents"))


def url_query(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = shared.table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_RULES_SQL = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
URL_SQL = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES_SQL}),
cut AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^?#]*') AS whole FROM cut),
named AS (
    SELECT page_id, translate(regexp_extract(whole, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           CASE WHEN contains(whole, '/') THEN substr(whole, instr(whole, '/')) ELSE '' END AS path FROM parts),
fits AS (
    SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
           row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS place
    FROM named JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.rule_verdict, 'allow') AS verdict
FROM named n LEFT JOIN fits f ON n.page_id = f.page_id AND f.place = 1
"""


def secrets_query(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find_secrets(
        shared.table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), secret_scan.digest_column("base").alias("base_sha256"), "spans"
    )


def byte_bpe_query(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.token_digests(
        shared.table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def jaccard_query(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.linked_documents(shared.table(spark, folder, "documents"))


def exact_query(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(shared.table(spark, folder, "documents")).drop("n_chunks")


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def records_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = shared.table(spark, folder, "documents")
    target = shared.new_folder(spark, "records")
    shards = token_records.write_records(docs, target, public_tokenizers.path("word_bpe_49k.json"), 1)
    return token_records.read_records(spark, target, shards).select("doc_id", "start", "n_tokens", "ids_crc32")


def language_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = shared.table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    dictionaries = language_id.train_dictionaries(docs.filter(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language_id.identify_language(rows, dictionaries).drop("text")


def search_query(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical_search.ranked_documents(shared.table(spark, folder, "documents"), shared.table(spark, folder, "benchmark"))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERMS_SQL = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
SEARCH_SQL = f"""
WITH found AS (SELECT doc_id, unnest({_TERMS_SQL}) AS term FROM documents),
counted AS (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY ALL),
sized AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sized),
spread AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
weighed AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM spread, whole),
asked AS (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN counted USING (term) JOIN sized USING (doc_id) JOIN weighed USING (term), whole
    GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def phrases_query(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(shared.table(spark, folder, "documents"))


PHRASES_SQL = r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM texts),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang),
runs AS (SELECT lang, words, unnest(range(1, 5)) AS size FROM pieces),
placed AS (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS p FROM runs),
counted AS (
    SELECT lang, list_slice(words, p, p + size - 1) AS words, size, count(*) AS a FROM placed
    GROUP BY ALL HAVING count(*) >= 30),
cut AS (SELECT lang, words, a, size, unnest(range(1, size)) AS k FROM counted WHERE size > 1),
scored AS (
    SELECT c.lang, c.words, c.a, c.size, c.k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a + y.a))::BIGINT AS score
    FROM cut c JOIN counted x ON x.lang = c.lang AND x.words = list_slice(c.words, 1, c.k) JOIN counted y ON y.lang = c.lang AND y.words = list_slice(c.words, c.k + 1, c.size)),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
inner_size AS (SELECT lang, words, a, size, unnest(range(2, size)) AS own FROM counted WHERE size > 2),
inner_at AS (SELECT *, unnest(range(1, size - own + 2)) AS p FROM inner_size),
inside AS (SELECT lang, list_slice(words, p, p + own - 1) AS words, max(a) AS a FROM inner_at GROUP BY ALL),
kept AS (
    SELECT s.* FROM least s LEFT JOIN inside h ON h.lang = s.lang AND h.words = s.words
    WHERE h.a IS NULL OR 100::HUGEINT * h.a < 80::HUGEINT * s.a),
named AS (SELECT *, array_to_string(words, ' ') AS phrase FROM kept),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def warc_query(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_archives(shared.table(spark, folder, "pages"), shared.new_folder(spark, "archives"))
    found = warc.read_archives(archives.select("path", "length"), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


WARC_SQL = """
WITH hashed AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex,
           max(page_id) OVER (PARTITION BY coalesce(html, '')) AS stays FROM pages),
parts AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, (5 * i + 1)::BIGINT, 5))::INTEGER) AS fives FROM hashed),
coded AS (
    SELECT *, array_to_string(list_transform(range(32), lambda i: substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((fives[(i // 4 + 1)::BIGINT] >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest FROM parts)
SELECT page_id, strlen(payload) AS payload_bytes, payload_digest,
       CASE WHEN page_id = stays THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> stays THEN stays END AS refers_to FROM coded
"""


QUERIES: dict[str, LlmQuery] = {
    "op1_toxicity": LlmQuery(toxicity_query),
    "op2_decontamination": LlmQuery(decontamination_query),
    "op3_substring_dedup": LlmQuery(passages_query),
    "op4_url_filter": LlmQuery(url_query, URL_SQL),
    "op5_secret_scan": LlmQuery(secrets_query),
    "op6_byte_bpe": LlmQuery(byte_bpe_query),
    "op7_ngram_jaccard_join": LlmQuery(jaccard_query),
    "op8_exact_dedup": LlmQuery(exact_query, EXACT_SQL),
    "op9_token_records": LlmQuery(records_query),
    "op10_language_id": LlmQuery(language_query),
    "op11_ranked_search": LlmQuery(search_query, SEARCH_SQL),
    "op12_phrase_mining": LlmQuery(phrases_query, PHRASES_SQL),
    "op13_warc": LlmQuery(warc_query, WARC_SQL),
}
