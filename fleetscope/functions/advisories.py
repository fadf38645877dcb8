"""Severity, fix version and naming of OSV-shaped advisory records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscope.functions.text import let, lines, strip
from fleetscope.functions.version_order import version_key

AFFECTED = (
    "array<struct<package:struct<name:string,ecosystem:string>,versions:array<string>,ranges:array<struct<type:string,"
    "events:array<struct<introduced:string,fixed:string,last_affected:string,`limit`:string>>>>>>"
)
#: The part of an OSV record the engine reads.
OSV_SCHEMA = f"""
    id string, summary string, details string, aliases array<string>,
    severity array<struct<type:string,score:string>>,
    database_specific struct<severity:string>, affected {AFFECTED}
"""

# Fixed values.
CRITICAL_SCORE = 8.0
CRITICAL_WORDS = ["CRITICAL", "HIGH"]
NO_SUMMARY = "No summary available."
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def cvss_score(score: Column) -> Column:
    """Numeric score, alone or before a ``/``; a bare ``CVSS:`` vector carries none."""
    head = F.substring_index(strip(score), "/", 1)
    return F.when(head.rlike(NUMBER), head.cast("double"))


def severity(entries: Column, word: Column) -> Column:
    """``critical`` or ``warning`` from the highest score, else from the qualitative word."""
    best = F.array_max(F.transform(entries, lambda e: cvss_score(e["score"])))
    by_word = F.upper(strip(word)).isin(CRITICAL_WORDS)
    return F.when(F.coalesce(best >= CRITICAL_SCORE, by_word, F.lit(False)), "critical").otherwise("warning")


def fixed_version(affected: Column, package: Column) -> Column:
    """First non-empty ``fixed`` event of the package's entries, '' when there is none."""
    mine = F.filter(
        affected, lambda a: a["package"]["name"].isNull() | (a["package"]["name"] == package)
    )
    ranges = F.flatten(F.transform(mine, lambda a: F.coalesce(a["ranges"], F.array())))
    events = F.flatten(F.transform(ranges, lambda r: F.coalesce(r["events"], F.array())))
    fixes = F.filter(F.transform(events, lambda e: e["fixed"]), lambda v: v != "")
    return F.coalesce(F.get(fixes, 0), F.lit(""))


def resolved_id(identifier: Column, aliases: Column) -> Column:
    named = F.filter(aliases, lambda a: a != "")
    return F.coalesce(F.nullif(identifier, F.lit("")), F.get(named, 0), F.lit("UNKNOWN"))


def summary(short: Column, details: Column) -> Column:
    first_line = F.get(lines(strip(details)), 0)
    return F.coalesce(F.nullif(strip(short), F.lit("")), F.nullif(first_line, F.lit("")), F.lit(NO_SUMMARY))


#: Kinds of range events in the order in which they count at one version.
_OPENS, _CLOSES_BEFORE, _CLOSES_AFTER = 0, 1, 2
_KEY = "array<string>"
INTERVAL = f"struct<lo:{_KEY},hi:{_KEY},closed:boolean>"


def affected_intervals(ecosystem: Column, ranges: Column) -> Column:
    """The intervals of version keys that ranges of events make: from ``lo`` on, up to ``hi``, which itself is
    affected if ``closed``; a NULL ``hi`` is no end.

    Events go by version. An introduction opens an interval unless one is open, a fix or limit ends it before
    its version, a last affected version after it; at one version an end wins over an introduction.
    ``0`` is below every version. Ranges of commits, and those with a version that cannot be read, make none.
    """

    def keyed(e: Column) -> Column:
        return F.struct(
            F.when((e["kind"] == _OPENS) & (e["version"] == "0"), F.array().cast(_KEY)).otherwise(version_key(ecosystem, e["version"])).alias("key"),
            e["kind"].alias("kind"),
        )

    def listed(e: Column) -> Column:
        kinds = [("introduced", _OPENS), ("fixed", _CLOSES_BEFORE), ("limit", _CLOSES_BEFORE), ("last_affected", _CLOSES_AFTER)]
        found = F.array(*[F.struct(e[name].alias("version"), F.lit(kind).alias("kind")) for name, kind in kinds])
        return F.filter(found, lambda f: F.coalesce(f["version"], F.lit("")) != "")

    none = F.array().cast(f"array<{INTERVAL}>")
    interval = lambda lo, hi, closed: F.array(F.struct(lo.alias("lo"), hi.alias("hi"), closed.alias("closed")).cast(INTERVAL))

    def step(state: Column, e: Column) -> Column:
        opened, out = state["opened"], state["out"]
        begins, ends = opened.isNull() & (e["kind"] == _OPENS), opened.isNotNull() & (e["kind"] != _OPENS)
        return F.struct(
            F.when(begins, e["key"]).when(~ends, opened).alias("opened"),
            F.when(ends, F.concat(out, interval(opened, e["key"], e["kind"] == _CLOSES_AFTER))).otherwise(out).alias("out"),
        )

    def of(r: Column) -> Column:
        events = F.flatten(F.transform(F.coalesce(r["events"], F.array()), listed))
        return let(
            F.array_sort(F.transform(events, keyed)),
            lambda sorted_events: F.when(
                F.upper(F.coalesce(r["type"], F.lit(""))).isin("GIT") | F.exists(sorted_events, lambda e: e["key"].isNull()), none
            ).otherwise(
                F.aggregate(
                    sorted_events,
                    F.struct(F.lit(None).cast(_KEY).alias("opened"), none.alias("out")),
                    step,
                    lambda state: F.when(state["opened"].isNull(), state["out"]).otherwise(
                        F.concat(state["out"], interval(state["opened"], F.lit(None).cast(_KEY), F.lit(False)))
                    ),
                )
            ),
        )

    return F.flatten(F.transform(F.coalesce(ranges, F.array()), of))
