"""Row generators over text columns: numbered lines, markers, secrets, references, sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import paths, secrets
from fleetscope.functions.labels import quote_regex
from fleetscope.functions.text import let, lines, strip
from fleetscope.operators.ordered import with_running_last

# Fixed values.
MARKERS = ["TODO", "FIXME", "HACK", "BUG"]
CSV_SUFFIX = ".csv"
BACKTICK = r"`([^`\n]+)`"
LINK_TARGET = r"\[[^\]]*\]\(([^)]+)\)"
ROOTED_PATH = (
    r"(?iU)(?<![\w./])(?:\./)?(?:src|lib|app|apps|packages|components|pages|"
    r"services|api|backend|frontend|docs|tests?|__tests__|config|scripts|"
    r"public|static|assets)(?:/[\w.-]+)+/?"
)
#: (pattern, group) of every way prose names a path.
REFERENCE_PATTERNS = [(BACKTICK, 1), (LINK_TARGET, 1), (ROOTED_PATH, 0)]
FENCE = r"(?md)^```"
FENCE_LENGTH = 3
# Noncharacters that mark matches; texts lose them.
_CUT, _END = "\ufdd2", "\ufdd3"
ENV_DEFINITION = r"(?mU)^(?:export\s+)?([A-Z][A-Z0-9_]*)\s*="
ENV_CALL = (
    r"(?:process\.env\.|os\.environ\[['\"]|os\.environ\.get\(['\"]|"
    r"os\.getenv\(['\"]|getenv\(['\"]|ENV\[['\"])([A-Z][A-Z0-9_]*)"
)
ENV_DOLLAR = r"(?U)\$([A-Z][A-Z0-9_]{2,})\b"
NO_FINDING = "- None detected."


def explode_lines(df: DataFrame, text: str = "content", keep: Sequence[str] | None = None) -> DataFrame:
    """One row per line, ``line_no`` from 1. The text column itself is not carried along."""
    keep = [c for c in df.columns if c != text] if keep is None else list(keep)
    return df.select(*keep, F.posexplode(lines(F.col(text))).alias("__pos", "line")).select(
        *keep, (F.col("__pos") + 1).alias("line_no"), "line"
    )


def marker_pattern(markers: Sequence[str]) -> str:
    return r"(?U)\b(" + "|".join(quote_regex(m) for m in markers) + r")\b"


def scan_markers(
    df: DataFrame,
    text: str = "content",
    keep: Sequence[str] = ("repo", "path"),
    markers: Sequence[str] = MARKERS,
) -> DataFrame:
    """First marker of every line that has one, confidence LOW.

    Files without any marker word are dropped by plain substring searches before lines are made.
    """
    pattern = marker_pattern(markers)

    def named(column: str) -> Column:
        return paths.any_of([F.contains(F.col(column), F.lit(m)) for m in markers])

    hit = explode_lines(df.filter(named(text)), text, keep)
    return hit.filter(named("line") & F.col("line").rlike(pattern)).select(
        *keep,
        "line_no",
        F.regexp_extract("line", pattern, 1).alias("marker"),
        F.lit("LOW").alias("confidence"),
    )


def scan_secrets(
    df: DataFrame,
    text: str = "content",
    path: str = "path",
    keep: Sequence[str] = ("repo", "path"),
    cutoff: float = secrets.ENTROPY_CUTOFF,
    custom: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Lines with a hard-coded credential. CSV files are not looked at."""
    name = F.col(path).cast("string")
    candidates = df.filter((paths.suffix(name) != CSV_SUFFIX) & secrets.may_hold_secret(F.col(text)))
    numbered = explode_lines(candidates, text, dict.fromkeys([*keep, path])).filter(
        secrets.may_hold_secret(F.col("line"))
    )
    verdict = secrets.line_confidence(F.col("line"), name, cutoff, custom)
    return numbered.select(*keep, "line_no", verdict.alias("confidence")).filter(F.col("confidence").isNotNull())


def _named(column: Column, markers: Sequence[str]) -> Column:
    return paths.any_of([F.contains(column, F.lit(m)) for m in markers])


def may_hold_finding(text: Column, path: Column, markers: Sequence[str] = MARKERS) -> Column:
    """Plain tests that every text or line with a marker or secret passes."""
    return _named(text, markers) | ((paths.suffix(path) != CSV_SUFFIX) & secrets.may_hold_secret(text))


def line_findings(
    line: Column, path: Column, markers: Sequence[str] = MARKERS, cutoff: float = secrets.ENTROPY_CUTOFF, custom: Sequence[tuple[str, str]] = ()
) -> Column:
    """``array<struct<kind, marker, confidence>>``: the marker and the secret of a line, as far as it has them."""
    pattern = marker_pattern(markers)
    marker = F.when(
        _named(line, markers) & line.rlike(pattern),
        F.struct(F.lit("markers").alias("kind"), F.regexp_extract(line, pattern, 1).alias("marker"), F.lit("LOW").alias("confidence")),
    )
    level = secrets.line_confidence(line, path, cutoff, custom)
    secret = F.filter(
        F.array(F.struct(F.lit("secrets").alias("kind"), F.lit("").alias("marker"), level.alias("confidence"))),
        lambda s: s["confidence"].isNotNull(),
    )
    secret = F.when((paths.suffix(path) != CSV_SUFFIX) & secrets.may_hold_secret(line), F.get(secret, 0))
    return F.array_compact(F.array(marker, secret))


def scan_findings(
    df: DataFrame,
    text: str = "content",
    path: str = "path",
    keep: Sequence[str] = ("repo", "path"),
    markers: Sequence[str] = MARKERS,
    cutoff: float = secrets.ENTROPY_CUTOFF,
    custom: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Markers and secrets in one pass over the contents: ``keep, line_no, kind, marker, confidence``.

    The same rows as :func:`scan_markers` and :func:`scan_secrets` together, at the cost of one scan.
    """
    name, line = F.col(path).cast("string"), F.col("line")
    numbered = explode_lines(df.filter(may_hold_finding(F.col(text), name, markers)), text, dict.fromkeys([*keep, path]))
    found = line_findings(line, name, markers, cutoff, custom)
    return numbered.filter(may_hold_finding(line, name, markers)).select(*keep, "line_no", F.inline(found))


def _offsets(text: Column, pattern: str) -> tuple[Column, Column]:
    """The pieces of a text cut before each match of ``pattern``, every match marked at its end, and where in the
    text the pieces begin; the first piece is what stands before any match."""
    marked = F.regexp_replace(text, pattern, f"{_CUT}$0{_END}")
    pieces = F.split(marked, _CUT)
    sizes = F.transform(pieces, lambda piece, i: F.length(piece) - F.when(i > 0, 1).otherwise(0))
    start = F.aggregate(sizes, F.array(F.lit(0)), lambda at, size: F.concat(at, F.array(F.element_at(at, -1) + size)))
    return pieces, start


def fence_starts(text: Column) -> Column:
    """Where the code fences of a text begin."""
    pieces, start = _offsets(text, FENCE)
    return F.slice(start, F.lit(2), F.size(pieces) - 1)


def in_fence(offset: Column, fences: Column) -> Column:
    """Whether an offset lies in a block between two fences. Fences pair from the top; the last of an odd number
    opens nothing. What begins in the fence itself is outside."""
    before = F.size(F.filter(fences, lambda at: at + FENCE_LENGTH <= offset))
    return (before % 2 == 1) & F.coalesce(offset < F.get(fences, before), F.lit(False))


def path_references(
    df: DataFrame,
    text: str = "text",
    keep: Sequence[str] = ("repo", "source"),
    patterns: Sequence[tuple[str, int]] = REFERENCE_PATTERNS,
    skip_fenced: bool = True,
) -> DataFrame:
    """Raw path references, duplicates kept; those that begin inside paired code fences are left out."""
    content = F.col(text)
    every = [F.regexp_extract_all(content, F.lit(pattern), F.lit(group)) for pattern, group in patterns]
    if skip_fenced:
        fences = F.when(F.contains(content, F.lit("```")), fence_starts(F.translate(content, _CUT + _END, "")))
        rows = df.select(*keep, content.alias(text), fences.alias("__fences"))
        # Texts without a pair of fences, which are most, take the plain way.
        every = [
            F.when(F.size("__fences") > 1, _outside(F.translate(content, _CUT + _END, ""), pattern, group)).otherwise(plain)
            for (pattern, group), plain in zip(patterns, every, strict=True)
        ]
    else:
        rows = df
    found = every[0] if len(every) == 1 else F.concat(*every)
    return rows.select(*keep, F.explode(found).alias("raw")).withColumn("raw", strip(F.col("raw")))


def _outside(content: Column, pattern: str, group: int) -> Column:
    """Matches that begin outside the pairs of ``__fences``."""

    def judged(cut: Column) -> Column:
        def match(piece: Column, i: Column) -> Column:
            whole = F.substring_index(piece, _END, 1)
            return F.struct(F.regexp_extract(whole, pattern, group).alias("raw"), F.get(cut["start"], i).alias("at"))

        matches = F.slice(F.transform(cut["pieces"], match), F.lit(2), F.size(cut["pieces"]))
        return F.transform(F.filter(matches, lambda m: ~in_fence(m["at"], F.col("__fences"))), lambda m: m["raw"])

    pieces, start = _offsets(content, pattern)
    return let(F.struct(pieces.alias("pieces"), start.alias("start")), judged)


def env_definitions(df: DataFrame, text: str = "text", keep: Sequence[str] = ("repo",)) -> DataFrame:
    """Distinct keys assigned in an environment example file."""
    keys = F.regexp_extract_all(F.col(text), F.lit(ENV_DEFINITION), F.lit(1))
    return df.select(*keep, F.explode(F.array_distinct(keys)).alias("key")).distinct()


def env_references(df: DataFrame, text: str = "text", keep: Sequence[str] = ("repo",)) -> DataFrame:
    """Distinct keys read in code samples or written as ``$KEY``."""
    keys = F.concat(
        F.regexp_extract_all(F.col(text), F.lit(ENV_CALL), F.lit(1)),
        F.regexp_extract_all(F.col(text), F.lit(ENV_DOLLAR), F.lit(1)),
    )
    return df.select(*keep, F.explode(F.array_distinct(keys)).alias("key")).distinct()


def with_section(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    heading: Column,
    block: Column | None = None,
) -> DataFrame:
    """Adds ``section_no`` (order value of the heading above) and ``section`` (its text).

    ``heading`` is the heading text on heading rows and NULL elsewhere; rows above the first heading
    belong to no section and are dropped.
    """
    marked = rows.withColumn("__heading", heading).withColumn(
        "__at", F.when(F.col("__heading").isNotNull(), F.col(order))
    )
    carried = with_running_last(
        marked, keys, [order], {"section": "__heading", "section_no": "__at"}, block
    )
    return carried.filter(F.col("section_no").isNotNull()).drop("__heading", "__at")


def split_sections(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), mark: str = "## ") -> DataFrame:
    """Lines of each document under their last ``mark`` heading. A document is one cell, so its lines
    fit one window group."""
    numbered = explode_lines(df, text, keep)
    heading = F.when(F.col("line").startswith(mark), F.col("line"))
    return with_section(numbered, list(keep), "line_no", heading)


def section_findings(
    rows: DataFrame, keys: Sequence[str], line: Column, relevant: Column, nothing: str = NO_FINDING
) -> DataFrame:
    """Per key: whether any relevant bullet reports something."""
    hit = relevant & line.startswith("- ") & (strip(line) != nothing)
    return rows.groupBy(*keys).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("has_findings"))


def report_has_findings(
    reports: DataFrame,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    section: str = "## 4. Risk Map (AI Debt & Security)",
    headings: Sequence[str] = ("### [CRITICAL]", "### [WARNING]"),
) -> DataFrame:
    """Verdict on rendered reports: any critical or warning bullet in the risk section."""
    rows = split_sections(reports, text, keep)
    inner = F.when(F.col("line").startswith("### "), F.col("line")).when(
        F.col("line").startswith("## "), F.lit("")
    )
    sub = with_running_last(
        rows.withColumn("__sub", inner), list(keep), ["line_no"], {"subsection": "__sub"}
    )
    relevant = (F.col("section") == section) & F.col("subsection").isin(list(headings))
    verdicts = section_findings(sub, keep, F.col("line"), relevant)
    return (
        reports.select(*keep)
        .join(verdicts, list(keep), "left")
        .withColumn("has_findings", F.coalesce("has_findings", F.lit(False)))
    )
