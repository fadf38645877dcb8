"""Versions as arrays of strings that sort as their ecosystem orders versions.

Every element starts with a character for its rank among the elements that may stand there, numbers go on
with their length, so that arrays compare element by element as Spark compares them and no comparison
needs code of its own. The empty array is below every version. A version that its ecosystem cannot read
has a NULL key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscope.functions.text import let, strip

# The forms of versions, and the words that stand before or after a release.
SEMVER = r"^[vV=]*\s*(\d+(?:\.\d+)*)(?:-?([0-9A-Za-z.-]+))?(?:\+.*)?$"
PEP440 = (
    r"^v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
)
PEP440_WORDS = {"alpha": "a", "a": "a", "beta": "b", "b": "b", "preview": "c", "pre": "c", "c": "c", "rc": "c"}
COMPOSER = r"^v?(\d+(?:\.\d+)*)(?:[._-]?(stable|alpha|a|beta|b|rc|patch|pl|p|dev)[._-]?(\d*))?(?:[._-]dev)?(?:\+.*)?$"
COMPOSER_WORDS = {"dev": "10", "alpha": "11", "a": "11", "beta": "12", "b": "12", "rc": "13", "stable": "2", "": "2", "patch": "3", "pl": "3", "p": "3"}
GEM = r"^\d+(?:\.[0-9A-Za-z]+)*(?:-[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?$"
MAVEN_WORDS = {"alpha": "1a", "beta": "1b", "milestone": "1c", "rc": "1d", "cr": "1d", "snapshot": "1e", "final": "3", "ga": "3", "release": "3", "sp": "4"}
MAVEN_SHORT = {"a": "alpha", "b": "beta", "m": "milestone"}


def _number(digits: Column) -> Column:
    bare = F.regexp_replace(F.when(digits == "", "0").otherwise(digits), "^0+(?=.)", "")
    return F.concat(F.lpad(F.length(bare).cast("string"), 3, "0"), bare)


def _release(core: Column) -> Column:
    """The numbers of a release without trailing zeros."""
    parts = F.split(F.regexp_replace(core, r"(?:\.0+)+$", ""), r"\.")
    return F.transform(parts, lambda part: F.concat(F.lit("5"), _number(part)))


def _word(word: Column, table: dict[str, str]) -> Column:
    out = None
    for name, rank in table.items():
        out = (F if out is None else out).when(word == name, F.lit(rank))
    return out


def semver_key(version: Column) -> Column:
    def key(text: Column) -> Column:
        before = F.regexp_extract(text, SEMVER, 2)
        parts = F.transform(
            F.split(before, r"\."),
            lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("3"), _number(p))).otherwise(F.concat(F.lit("4"), p)),
        )
        tail = F.when(before == "", F.array(F.lit("2"))).otherwise(F.concat(F.array(F.lit("1")), parts))
        return F.when(text.rlike(SEMVER), F.concat(_release(F.regexp_extract(text, SEMVER, 1)), tail))

    return let(strip(version), key)


def pep440_key(version: Column) -> Column:
    def key(text: Column) -> Column:
        group = lambda n: F.regexp_extract(text, PEP440, n)
        pre, dev = group(3) != "", group(8) != ""
        post = (group(5) != "") | (group(6) != "")
        rank = F.when(pre, F.concat(F.lit("1"), _word(group(3), PEP440_WORDS), _number(group(4)))).when(~post & dev, "0").otherwise("2")
        after = F.when(post, F.concat(F.lit("1"), _number(F.concat(group(5), group(7))))).otherwise("0")
        local = F.transform(
            F.filter(F.split(group(10), "[-_.]"), lambda p: p != ""),
            lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("2"), _number(p))).otherwise(F.concat(F.lit("1"), p)),
        )
        return F.when(
            text.rlike(PEP440),
            F.concat(
                F.array(F.concat(F.lit("5"), _number(group(1)))), _release(group(2)),
                F.array(F.lit("2"), rank, after, F.when(dev, F.concat(F.lit("0"), _number(group(9)))).otherwise("1")), local,
            ),
        )

    return let(F.lower(strip(version)), key)


def composer_key(version: Column) -> Column:
    def key(text: Column) -> Column:
        word = _word(F.regexp_extract(text, COMPOSER, 2), COMPOSER_WORDS)
        tail = F.array(word, F.concat(F.lit("5"), _number(F.regexp_extract(text, COMPOSER, 3))))
        return F.when(text.rlike(COMPOSER), F.concat(_release(F.regexp_extract(text, COMPOSER, 1)), tail))

    return let(F.lower(strip(version)), key)


def gem_key(version: Column) -> Column:
    def key(text: Column) -> Column:
        joined = F.array_join(F.regexp_extract_all(F.replace(text, F.lit("-"), F.lit(".pre.")), F.lit("[0-9]+|[A-Za-z]+"), F.lit(0)), ".")
        head = F.regexp_extract(joined, r"^(\d+(?:\.\d+)*)", 1)
        rest = F.regexp_replace(F.substr(joined, F.length(head) + 2), r"(?:(?:^|\.)0+)+$", "")
        tail = F.transform(
            F.filter(F.split(rest, r"\."), lambda p: p != ""),
            lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("5"), _number(p))).otherwise(F.concat(F.lit("1"), p)),
        )
        return F.when(text.rlike(GEM), F.concat(_release(head), tail, F.array(F.lit("3"))))

    return let(strip(version), key)


def maven_key(version: Column) -> Column:
    def key(text: Column) -> Column:
        whole = text
        for short, long in MAVEN_SHORT.items():
            whole = F.regexp_replace(whole, f"(?<![a-z]){short}(?=\\d)", long)
        dashed = F.regexp_replace(whole, r"(?<=\d)(?=[^\d.-])|(?<=[^\d.-])(?=\d)", "-")
        trimmed = F.regexp_replace(dashed, r"(?:[.-](?:0+|final|ga|release))+(?=-|$)", "")
        found = F.regexp_extract_all(trimmed, F.lit(r"(?:^|[.-])[^.-]+"), F.lit(0))

        def part(token: Column) -> Column:
            body = F.regexp_replace(token, "^[.-]", "")
            digits = F.concat(F.when(token.startswith("-"), "6").otherwise("7"), _number(body))
            return F.when(body.rlike(r"^\d+$"), digits).otherwise(F.coalesce(_word(body, MAVEN_WORDS), F.concat(F.lit("5"), body)))

        return F.when(text != "", F.concat(F.transform(found, part), F.array(F.lit("3"))))

    return let(F.lower(strip(version)), key)


def version_key(ecosystem: Column, version: Column) -> Column:
    """The key of a version by its ecosystem; semantic versions where none of the others is named."""
    return (
        F.when(ecosystem == "PyPI", pep440_key(version))
        .when(ecosystem == "Maven", maven_key(version))
        .when(ecosystem == "RubyGems", gem_key(version))
        .when(ecosystem == "Packagist", composer_key(version))
        .otherwise(semver_key(version))
    )
