"""Allow and block rules for URLs, matched in a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that are sent to every executor as one trie; more are matched by joins on their hosts.
MAX_TRIE_RULES = 200_000
_RULE, _PATHS = 0, 1


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for stop in "#?":
        rest = rest.split(stop, 1)[0]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


_LOWER = {code: code + 32 for code in range(65, 91)}


class RuleTrie:
    """Nodes are dictionaries by host label, from the last label on; below a host, by path segment.
    A rule's last segment may be a part of a url's, so rules end in a table of segment prefixes."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]) -> None:
        self.root: dict = {}
        # Sorted so that of two equal rules the block comes last and stays.
        for host, path, verdict in sorted(rules, key=lambda r: (r[2] == "block", r)):
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")) if host else ():
                node = node.setdefault(label, {})
            node = node.setdefault(_PATHS, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(_RULE, {})[last] = (host.translate(_LOWER) + path, verdict)

    def _below(self, paths: dict, segments: list[str]) -> tuple[str, str] | None:
        best, node = None, paths
        for segment in segments:
            ends = node.get(_RULE)
            if ends:
                fits = [prefix for prefix in (segment[:n] for n in range(len(segment), -1, -1)) if prefix in ends]
                best = ends[fits[0]] if fits else best
            node = node.get(segment)
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule and verdict: the most host labels first, then the longest path."""
        segments, best, node = path.split("/"), None, self.root
        labels = host.split(".")
        for label in reversed(labels):
            node = node.get(label)
            if node is None:
                break
            if _PATHS in node:
                best = self._below(node[_PATHS], segments) or best
        return best


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_trie_rules: int = MAX_TRIE_RULES
) -> DataFrame:
    """Adds ``host, path, rule, verdict`` to ``pages``.

    ``rules`` has ``host, path, verdict`` (allow or block). A rule fits its host and all subdomains where
    the url's path starts with the rule's path; of the rules that fit, the one with the longest host,
    then the longest path decides. If the same rule is allowed and blocked, block wins; repeated rules
    count once; rules with a null or empty host or null verdict fit nothing; a null path counts as
    empty. Without a rule ``rule`` is null and the verdict is ``default``. Null urls and urls without
    ``://`` have empty host and path. A table without rules gives the default everywhere. Columns of
    ``pages`` with the names of the new ones are replaced.

    The rules are counted first. Up to ``max_trie_rules`` they are sent to every executor as one trie;
    beyond, urls meet the rules of each suffix of their host by a join.
    """
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    clean = (
        rules.filter("host <> '' AND verdict IS NOT NULL")
        .select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .distinct()
    )
    listed = clean.limit(max_trie_rules + 1).collect()
    if len(listed) > max_trie_rules:
        return _judge_by_join(pages, clean, url, default, keep)
    shared = pages.sparkSession.sparkContext.broadcast(RuleTrie([tuple(r) for r in listed]).root)

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = RuleTrie([])
        trie.root = shared.value
        for urls in batches:
            parts = [split_url(u) for u in urls]
            found = [trie.match(host, path) if host else None for host, path in parts]
            yield pd.DataFrame(
                {
                    "host": [p[0] for p in parts],
                    "path": [p[1] for p in parts],
                    "rule": [f[0] if f else None for f in found],
                    "verdict": [f[1] if f else default for f in found],
                }
            )

    return pages.select(*keep, judge(F.col(url)).alias("__judged")).select(*keep, "__judged.*")


def _judge_by_join(pages: DataFrame, rules: DataFrame, url: str, default: str, keep: list) -> DataFrame:
    """The same for rule tables of any size: each distinct (host, path) meets rules by host suffix."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^?#]*)", 1)
    whole = F.when(F.col(url).contains("://"), rest).otherwise("")
    whole = F.coalesce(whole, F.lit(""))
    host = F.translate(F.regexp_extract(whole, r"^[^/]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = pages.withColumns({"__host": host, "__path": F.regexp_extract(whole, r"(?s)/.*$", 0)})
    labels = F.split("__host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels) - n + 1), ".")
    )
    seen = parts.select("__host", "__path").distinct().withColumn("__suffix", F.explode(suffixes))
    rule_host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ruled = rules.select(rule_host.alias("__suffix"), F.col("path").alias("__start"), "verdict")
    order = F.struct(F.length("__suffix"), F.length("__start"), F.col("verdict") == "block")
    best = (
        seen.join(ruled, "__suffix")
        .filter(F.expr("startswith(__path, __start)"))
        .groupBy("__host", "__path")
        .agg(F.max_by(F.struct(F.concat("__suffix", "__start").alias("rule"), "verdict"), order).alias("__best"))
    )
    return parts.join(best, ["__host", "__path"], "left").select(
        *keep,
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__best.rule").alias("rule"),
        F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"),
    )
