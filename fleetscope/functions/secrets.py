"""Hard-coded credential detection on single lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscope.functions.text import entropy

# Fixed values of the detector.
CREDENTIAL_WORDS = ["key", "secret", "token", "password", "passwd", "credential", "credentials", "auth", "bearer"]
EXCLUDED_NAMES = ["classname", "class", "style", "d"]
EXCLUDED_NAME_ENDINGS = ["path", "pathdata"]
MIGRATION_FIELDS = ["revision", "down_revision", "branch_labels", "depends_on"]
MIGRATION_FOLDERS = ["alembic/versions/", "migrations/"]
MIN_LENGTH = 20
ENTROPY_CUTOFF = 3.5
KNOWN_FORMATS = (
    r"AKIA[0-9A-Z]{16}"
    r"|sk-[a-zA-Z0-9_\-]{20,}"
    r"|gh[pos]_[A-Za-z0-9]{36,}"
    r"|github_pat_[A-Za-z0-9_]{20,}"
    r"|AIza[0-9A-Za-z_\-]{35}"
    r"|xox[baprs]-[A-Za-z0-9-]+"
    r"|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"
)
FORBIDDEN_CHARS = r"(?U)[\s.\[\]()/]"
STORAGE_KEY = r"^[a-z0-9]+(:[a-z0-9-]+)+$"
STORAGE_KEY_CHARS = r"^[a-z0-9:-]+$"
# groups: name, literal prefix, quote, value
QUOTED_ASSIGNMENT = (
    r"(?U)([A-Za-z_][A-Za-z0-9_]*)\s*=\s*([a-zA-Z]{0,2})(\"\"\"|'''|\"|')(.*?)\3"
)
# groups: name, value
ENV_ASSIGNMENT = r"(?U)^\s*(?:export\s+)?([A-Z_][A-Z0-9_]*)\s*=\s*([^\s#'\"]+)\s*(?:#.*)?$"

#: What any text with a finding must contain: a credential word inside the name left of a ``=``.
CANDIDATE = r"(?i)(?:key|secret|token|passw(?:or)?d|credential|auth|bearer)[a-z0-9_]*[^a-z0-9_=]*="


def may_hold_secret(text: Column) -> Column:
    """Cheap necessary condition on a file or line; decides whether it is looked at closely."""
    return F.contains(text, F.lit("=")) & text.rlike(CANDIDATE)


def identifier_words(name: Column) -> Column:
    """camelCase, snake_case and kebab-case words of an identifier, in lower case."""
    snake = F.regexp_replace(F.replace(name, F.lit("-"), F.lit("_")), "(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.filter(F.split(F.lower(snake), "_"), lambda word: word != "")


def names_credential(name: Column) -> Column:
    return F.arrays_overlap(identifier_words(name), F.array(*map(F.lit, CREDENTIAL_WORDS)))


def excluded_name(path: Column, name: Column) -> Column:
    """Names that look like credentials but are markup attributes, paths or migration ids."""
    lowered = F.lower(name)
    folder = F.concat(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))
    in_migration = F.lit(False)
    for fragment in MIGRATION_FOLDERS:
        in_migration = in_migration | F.contains(folder, F.lit(fragment))
    out = lowered.isin(EXCLUDED_NAMES) | (lowered.isin(MIGRATION_FIELDS) & in_migration)
    for ending in EXCLUDED_NAME_ENDINGS:
        out = out | F.endswith(lowered, F.lit(ending))
    return out


def classify_value(
    value: Column,
    cutoff: float = ENTROPY_CUTOFF,
    custom: Sequence[tuple[str, str]] = (),
) -> Column:
    """Confidence that a literal is a secret, NULL when it is none.

    ``custom`` holds (Java regex, confidence) pairs that are asked first, in order.
    """
    if cutoff <= 0:
        raise ValueError("entropy cutoff must be positive")
    none = F.lit(None).cast("string")
    namespaced = value.rlike(STORAGE_KEY) | (F.contains(value, F.lit(":")) & value.rlike(STORAGE_KEY_CHARS))
    chain = F
    for pattern, level in custom:
        chain = chain.when(value.rlike(pattern), F.lit(level))
    return (
        chain.when(value.rlike(KNOWN_FORMATS), F.lit("HIGH"))
        .when(namespaced | (F.length(value) < MIN_LENGTH) | value.rlike(FORBIDDEN_CHARS), none)
        .when(entropy(value) >= cutoff, F.lit("MEDIUM"))
    )


def assignments(line: Column) -> Column:
    """``array<struct<name,value>>`` of literal assignments: quoted ones in order, then env style."""
    zipped = F.arrays_zip(
        F.regexp_extract_all(line, F.lit(QUOTED_ASSIGNMENT), F.lit(1)).alias("name"),
        F.regexp_extract_all(line, F.lit(QUOTED_ASSIGNMENT), F.lit(2)).alias("prefix"),
        F.regexp_extract_all(line, F.lit(QUOTED_ASSIGNMENT), F.lit(4)).alias("value"),
    )
    literal = F.filter(
        zipped,
        lambda a: ~(F.contains(F.lower(a["prefix"]), F.lit("f")) & F.contains(a["value"], F.lit("{"))),
    )
    quoted = F.transform(literal, lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value")))
    env = F.struct(
        F.regexp_extract(line, ENV_ASSIGNMENT, 1).alias("name"),
        F.regexp_extract(line, ENV_ASSIGNMENT, 2).alias("value"),
    )
    return F.when(line.rlike(ENV_ASSIGNMENT), F.concat(quoted, F.array(env))).otherwise(quoted)


def line_confidence(
    line: Column,
    path: Column,
    cutoff: float = ENTROPY_CUTOFF,
    custom: Sequence[tuple[str, str]] = (),
) -> Column:
    """Confidence of one line: HIGH if any assignment is, else that of the last one with a verdict."""
    named = F.filter(assignments(line), lambda a: names_credential(a["name"]) & ~excluded_name(path, a["name"]))
    verdicts = F.filter(
        F.transform(named, lambda a: classify_value(a["value"], cutoff, custom)), lambda v: v.isNotNull()
    )
    found = F.when(F.array_contains(verdicts, "HIGH"), F.lit("HIGH")).when(
        F.size(verdicts) > 0, F.element_at(verdicts, -1)
    )
    return F.when(may_hold_secret(line), found)
