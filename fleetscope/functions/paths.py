"""Path predicates and path algebra on ``/``-separated relative paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscope.functions.text import strip

TOOL_FOLDER = ".fleetscope"

# Folders and path fragments that are never scanned.
IGNORED_FOLDERS = [
    ".git", ".next", TOOL_FOLDER, ".turbo", ".venv", "__pycache__", "bower_components", "build",
    "dist", "env", "node_modules", "site-packages", "staticfiles", "venv",
]
IGNORED_FRAGMENTS = [
    "node_modules/", "bower_components/", "staticfiles/", "static/vendor/", "assets/vendor/",
    "site-packages/", "venv/", ".venv/", "env/", ".next/", TOOL_FOLDER + "/", ".turbo/",
]
IGNORE_FILES = [".fleetscopeignore", ".gitignore", ".cursorignore"]

# Files without scannable text.
BINARY_SUFFIXES = [
    ".pyc", ".png", ".jpg", ".jpeg", ".gif", ".zip", ".exe", ".dll", ".so", ".dylib", ".woff",
    ".woff2", ".ico", ".pdf", ".db",
]
SKIPPED_SUFFIXES = [".map", ".md"]
SKIPPED_ENDINGS = [".min.js", ".min.css"]
JSON_MANIFESTS = ["package.json", "composer.json", "package-lock.json"]
REPORT_FILES = [
    "FLEETSCOPE.md", "FLEETSCOPE.json", "FLEETSCOPE.xml", "FLEETSCOPE.html",
    "FLEETSCOPE-SYSTEM.md", "FLEETSCOPE-SYSTEM.json", "FLEETSCOPE-SYSTEM.xml",
]

# Test folders.
TEST_SEGMENTS = ["tests", "test", "__tests__", "spec", "fixtures"]
TEST_ROOTS = ["tests", "test", "__tests__"]

# What counts as owned source code.
SOURCE_SUFFIXES = [
    ".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".go", ".rs", ".java", ".kt", ".kts",
    ".scala", ".php", ".rb", ".c", ".cc", ".cpp", ".h", ".hpp", ".cs", ".swift", ".vue", ".svelte",
    ".sql", ".sh", ".bash", ".zsh", ".ps1", ".r", ".lua", ".ex", ".exs", ".erl", ".hrl", ".clj",
    ".cljs", ".hs", ".ml", ".mli", ".dart", ".zig",
]
GENERATED_ENDINGS = [".min.js", ".min.css", "_pb2.py", ".pb.go", ".generated.ts", ".generated.js"]
LOCK_FILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock",
    "composer.lock", "Gemfile.lock", "go.sum",
]
DOC_SEGMENTS = ["docs", "documentation", "doc"]
MODULE_BUCKETS = ["apps", "packages", "services", "libs", "src"]

# Path references in documentation.
KNOWN_FILENAMES = [
    "readme.md", "contributing.md", "package.json", "package-lock.json", "pyproject.toml",
    "requirements.txt", "poetry.lock", "go.mod", "cargo.toml", "pom.xml", "build.gradle",
    "build.gradle.kts", "composer.json", "gemfile", "claude.md", "agents.md", ".cursorrules",
    ".env.example", "env.example", "manage.py", "dockerfile", "docker-compose.yml",
    "tsconfig.json", "next.config.js", "next.config.mjs", "vite.config.js", "vite.config.ts",
    "angular.json", "svelte.config.js", "nuxt.config.js", "nuxt.config.ts", "remix.config.js",
    "pnpm-workspace.yaml", "lerna.json",
]
GENERATED_REPORTS = [
    "fleetscope.md", "fleetscope.json", "fleetscope.xml", "fleetscope.html",
    "fleetscope-system.md", "fleetscope-system.json", "fleetscope-system.xml", "handoff.md",
]
GENERIC_WORDS = ["src", "lib", "app", "docs", "test", "tests", "config", "api", "env"]
REFERENCE_SUFFIXES = [
    ".md", ".json", ".js", ".mjs", ".ts", ".tsx", ".jsx", ".py", ".toml", ".yaml", ".yml", ".xml",
    ".html", ".lock", ".mod", ".cfg", ".mdc", ".kts", ".gradle", ".gemspec", ".example", ".sample",
    ".template", ".ini", ".txt",
]
ROOT_SEGMENTS = [
    "src", "lib", "app", "apps", "packages", "components", "pages", "services", "api", "backend",
    "frontend", "docs", "tests", "test", "__tests__", "config", "scripts", "public", "static",
    "assets", "web", "fleetscope", ".cursor", ".github", ".venv", "venv", "node_modules",
]
IMAGE_ENDINGS = [".png", ".jpg", ".gif", ".svg", ".ico"]
OPTIONAL_CONFIG_ENDINGS = ["mcp.json", "claude_desktop_config.json"]


def literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def ends_with_any(text: Column, endings: Sequence[str]) -> Column:
    return any_of([F.endswith(text, F.lit(e)) for e in endings])


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def segments(path: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(posix(path), "/"), lambda part: part != "")


def basename(path: Column) -> Column:
    return F.substring_index(posix(path), "/", -1)


def suffix(path: Column) -> Column:
    """The last extension with its dot, in lower case; dotfiles have none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def has_segment(path: Column, names: Sequence[str], lower: bool = True) -> Column:
    return F.arrays_overlap(F.split(F.lower(posix(path)) if lower else posix(path), "/"), literals(names))


def depth(path: Column) -> Column:
    """Number of folders above the file."""
    return F.size(segments(path)) - 1


def _glob_body(pattern: Column, star: str, single: str) -> Column:
    quoted = F.regexp_replace(pattern, r"([.^$+{}()|\\])", r"\\$1")
    quoted = F.regexp_replace(quoted, r"\[(?![^\[\]]+\])", r"\\[")
    quoted = F.replace(quoted, F.lit("[!"), F.lit("[^"))
    return F.replace(F.replace(quoted, F.lit("*"), F.lit(star)), F.lit("?"), F.lit(single))


def glob_regex(pattern: Column) -> Column:
    """Anchored Java regex of a shell glob: ``*`` crosses ``/``, ``?`` is one character, ``[!x]`` negates."""
    return F.concat(F.lit("(?s)^"), _glob_body(pattern, ".*", "."), F.lit(r"\z"))


def ignore_regex(pattern: Column) -> Column:
    """Unanchored alternative for one ignore pattern on a file path: ``dir/`` at any depth, else a glob
    on the whole path or on the file name."""
    folder = F.concat(
        F.lit(r"(?:.*/)?\Q"), F.regexp_replace(pattern, "/$", ""), F.lit(r"\E/.*")
    )
    name = F.concat(F.lit("(?:.*/)?"), _glob_body(pattern, "[^/]*", "[^/]"))
    return F.when(F.endswith(pattern, F.lit("/")), folder).otherwise(
        F.concat(_glob_body(pattern, ".*", "."), F.lit("|"), name)
    )


def any_ignore_regex(patterns: Column) -> Column:
    """One regex for an ``array<string>`` of ignore patterns."""
    return F.concat(F.lit("(?s)^(?:"), F.array_join(F.transform(patterns, ignore_regex), "|"), F.lit(r")\z"))


def ignored(path: Column, patterns: Sequence[str] = ()) -> Column:
    """Default ignore rules plus literal user patterns."""
    clean = posix(path)
    closed = F.concat(clean, F.lit("/"))
    rules = [F.arrays_overlap(F.split(clean, "/"), literals(IGNORED_FOLDERS))]
    rules += [F.contains(closed, F.lit(fragment)) for fragment in IGNORED_FRAGMENTS]
    if patterns:
        rules.append(F.rlike(clean, any_ignore_regex(literals(patterns))))
    return any_of(rules)


def matches_any_glob(path: Column, patterns: Column) -> Column:
    """``patterns`` is an ``array<string>`` column of globs."""
    return F.exists(patterns, lambda p: F.rlike(posix(path), glob_regex(p)))


def skippable(path: Column) -> Column:
    """Minified, generated or documentation files, and JSON that is no manifest."""
    name = basename(path)
    ext = suffix(path)
    return (
        ends_with_any(F.lower(name), SKIPPED_ENDINGS)
        | ext.isin(SKIPPED_SUFFIXES)
        | ((ext == ".json") & ~name.isin(JSON_MANIFESTS))
    )


def binary(path: Column, content: Column) -> Column:
    """By suffix, or by a NUL anywhere in a BINARY or STRING content."""
    return suffix(path).isin(BINARY_SUFFIXES) | F.contains(content.cast("binary"), F.lit(bytearray(b"\x00")))


def test_path(path: Column, names: Sequence[str] = TEST_SEGMENTS) -> Column:
    return has_segment(path, names)


def eligible_source(
    path: Column,
    test_segments: Sequence[str] = TEST_SEGMENTS,
    doc_segments: Sequence[str] = DOC_SEGMENTS,
    suffixes: Sequence[str] = SOURCE_SUFFIXES,
    ignore: Sequence[str] = (),
) -> Column:
    """Hand-written source whose lines have owners."""
    name = basename(path)
    return (
        suffix(path).isin(list(suffixes))
        & ~name.isin(LOCK_FILES)
        & ~ends_with_any(name, [".md", ".lock"])
        & ~ends_with_any(F.lower(posix(path)), GENERATED_ENDINGS)
        & ~has_segment(path, test_segments)
        & ~has_segment(path, doc_segments)
        & ~ignored(path, ignore)
    )


def module_key(path: Column, buckets: Sequence[str] = MODULE_BUCKETS) -> Column:
    """``apps/web/`` inside a monorepo bucket, ``top/`` below any other folder, ``.`` at the root."""
    parts = segments(path)
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    return (
        F.when(F.size(parts) <= 1, F.lit("."))
        .when(first.isin(list(buckets)) & (F.size(parts) >= 3), F.concat(first, F.lit("/"), second, F.lit("/")))
        .otherwise(F.concat(first, F.lit("/")))
    )


def under_prefix(path: Column, prefix: Column) -> Column:
    """Path below a folder prefix (with or without its ``/``) or equal to it; no prefix takes all."""
    bare = F.regexp_replace(prefix, "/$", "")
    clean = posix(path)
    hit = F.startswith(clean, F.concat(bare, F.lit("/"))) | (clean == bare)
    return F.when(prefix.isNull() | (prefix == ""), F.lit(True)).otherwise(hit)


def parent_folders(path: Column) -> Column:
    """Every folder above a path, outermost first (``a/b/c`` gives ``a``, ``a/b``)."""
    parts = segments(path)
    return F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def _unquoted(raw: Column) -> Column:
    """Outer white space, then double quotes, then single quotes off both ends."""
    return F.regexp_replace(F.regexp_replace(strip(raw), '^"+|"+$', ""), "^'+|'+$", "")


def path_like(
    raw: Column,
    roots: Sequence[str] = ROOT_SEGMENTS,
    suffixes: Sequence[str] = REFERENCE_SUFFIXES,
) -> Column:
    """Whether a quoted token in prose looks like a file path rather than a flag, call or word."""
    token = _unquoted(raw)
    clean = posix(token)
    parts = segments(token)
    lowered = F.transform(parts, F.lower)
    root_hit = F.arrays_overlap(lowered, literals(roots))
    good_suffix = suffix(token).isin(list(suffixes))
    rest = F.regexp_replace(token, "^/+", "")
    bare_absolute = F.startswith(token, F.lit("/")) & ~rest.rlike("[/.]")
    plain_pair = (F.size(parts) == 2) & ~F.contains(clean, F.lit(".")) & ~root_hit
    nested = (F.size(parts) > 0) & (root_hit | suffix(F.element_at(parts, -1)).isin(list(suffixes))) & ~plain_pair
    dots = F.length(token) - F.length(F.replace(token, F.lit("."), F.lit("")))
    return (
        F.when((token == "") | F.startswith(token, F.lit("-")) | token.rlike("[ (){}>=,]") | bare_absolute, F.lit(False))
        .when(F.contains(clean, F.lit("/")), F.when(F.size(parts) > 0, nested).otherwise(F.lit(False)))
        .when(F.startswith(token, F.lit(".")), (dots >= 2) | (F.length(token) > 5))
        .otherwise(F.lower(token).isin(KNOWN_FILENAMES) | good_suffix)
    )


def normalize_reference(raw: Column) -> Column:
    """Repository-relative form of a referenced path; NULL for URLs, images, own reports, plain words."""
    token = _unquoted(raw)
    external = token.rlike(r"^(?:https?://|mailto:|#)") | F.contains(token, F.lit("://"))
    bare = F.regexp_replace(F.substring_index(F.substring_index(token, "#", 1), "?", 1), r"^\.[/\\]", "")
    parts = F.filter(F.split(posix(bare), "/"), lambda part: (part != "") & (part != "."))
    rejected = (
        (token == "")
        | external
        | (bare == "")
        | ends_with_any(bare, IMAGE_ENDINGS)
        | F.lower(basename(F.regexp_replace(bare, "/+$", ""))).isin(GENERATED_REPORTS)
        | (F.size(parts) == 0)
        | ((F.size(parts) == 1) & F.lower(F.element_at(F.concat(parts, F.array(F.lit(""))), 1)).isin(GENERIC_WORDS))
    )
    return F.when(~rejected, F.array_join(parts, "/"))


def optional_reference(path: Column) -> Column:
    """Paths that need not exist: the tool's own folder and optional local configuration."""
    lowered = F.lower(posix(path))
    return F.startswith(lowered, F.lit(TOOL_FOLDER)) | ends_with_any(lowered, OPTIONAL_CONFIG_ENDINGS)
