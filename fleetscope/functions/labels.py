"""Labels derived from text or from numbers: assistant tools, expertise, freshness, intensity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tool names looked for in commit messages.
MESSAGE_TOOLS = [
    ("claude", "Claude"),
    ("cursor", "Cursor"),
    ("copilot", "Copilot"),
    ("ibm bob", "IBM Bob"),
    ("devin", "Devin"),
    ("gemini", "Gemini"),
    ("chatgpt", "ChatGPT"),
    ("codex", "Codex"),
    ("windsurf", "Windsurf"),
    ("cody", "Cody"),
]
# Needles looked for in author name and address.
AUTHOR_TOOLS = [
    ("claude", "Claude"),
    ("anthropic", "Claude"),
    ("cursor", "Cursor"),
    ("cursoragent", "Cursor"),
    ("copilot", "Copilot"),
    ("github-copilot", "Copilot"),
    ("ibm bob", "IBM Bob"),
    ("devin", "Devin"),
    ("gemini", "Gemini"),
    ("chatgpt", "ChatGPT"),
    ("openai", "ChatGPT"),
    ("codex", "Codex"),
    ("windsurf", "Windsurf"),
    ("cody", "Cody"),
]
# Assistant signatures inside files.
INLINE_SIGNATURE = (
    r"(?iU)(?:Co-authored-by:\s*(?:Claude|Cursor|Copilot|GitHub Copilot|IBM Bob|Devin|Gemini|ChatGPT|Codex|Windsurf|Cody)"
    r"|Generated by (?:GitHub )?Copilot"
    r"|AI-generated)"
)
CO_AUTHOR = r"(?imU)^Co-authored-by:\s*(.+?)\s*<"

# Thresholds.
AI_ASSISTED_PERCENT = 25.0
FEW_LINES = 20
SCORE_WEIGHTS = {"path": 0.35, "stack": 0.35, "env": 0.15, "recency": 0.15}
BAR_WIDTH = 12


def quote_regex(text: str) -> str:
    """Java literal of a plain string."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def _labels(hits: Sequence[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(hit, F.lit(label)) for hit, label in hits]))


def tools_in_text(text: Column, tools: Sequence[tuple[str, str]] = MESSAGE_TOOLS) -> Column:
    """Sorted distinct tool labels: whole words anywhere, or any part of a co-author's name.

    One alternation decides whether the per-tool tests run at all; few messages name a tool.
    """
    names = F.lower(F.array_join(F.regexp_extract_all(text, F.lit(CO_AUTHOR), F.lit(1)), "\n"))
    hits = [
        (
            text.rlike(rf"(?iU)\b{quote_regex(needle)}\b") | F.contains(names, F.lit(needle.lower())),
            label,
        )
        for needle, label in tools
    ]
    anywhere = "(?iU)" + "|".join(quote_regex(needle) for needle, _ in tools)
    none = F.array().cast("array<string>")
    return F.when(text.rlike(anywhere), F.array_sort(F.array_distinct(_labels(hits)))).otherwise(none)


def tools_of_author(name: Column, email: Column, tools: Sequence[tuple[str, str]] = AUTHOR_TOOLS) -> Column:
    """Distinct tool labels whose needle occurs in ``name email``, in the list's order."""
    who = F.lower(F.concat_ws(" ", name, email))
    return F.array_distinct(_labels([(F.contains(who, F.lit(needle)), label) for needle, label in tools]))


def inline_signature(content: Column, pattern: str = INLINE_SIGNATURE) -> Column:
    """Signature anywhere in a text file of any size."""
    return ~F.contains(content.cast("binary"), F.lit(bytearray(b"\x00"))) & content.rlike(pattern)


def expertise(primary_percent: Column, line_count: Column, recent_churn: Column) -> Column:
    return (
        F.when((line_count < FEW_LINES) & (recent_churn == 0), "Low Activity")
        .when(recent_churn >= 3, "High Activity")
        .when((primary_percent >= 70) & (recent_churn <= 1), "Stable / Maintenance")
        .when(primary_percent < 50, "Shared")
        .when(recent_churn == 0, "Low Activity")
        .otherwise("Stable / Maintenance")
    )


def secondary_text(
    secondary: Column, secondary_percent: Column, assisted: Column, ai_percent: Column, tools: Column
) -> Column:
    whole = F.bround(ai_percent, 0).cast("int").cast("string")
    named = F.when(F.size(tools) > 0, F.array_join(tools, "/")).otherwise("AI")
    share = F.bround(secondary_percent, 0).cast("int").cast("string")
    return (
        F.when(
            assisted & (ai_percent >= AI_ASSISTED_PERCENT),
            F.concat(F.lit("🤖 AI-Assisted ("), whole, F.lit("% "), named, F.lit(")")),
        )
        .when(secondary != "", F.concat(secondary, F.lit(" ("), share, F.lit("%)")))
        .otherwise("—")
    )


def freshness_score(path: Column, stack: Column, env: Column, recency: Column) -> Column:
    """Weighted 0..100 score of four ratios, half-even.

    The double noise of the weighted sum is cut at ten places first, so that 47.5 is a tie.
    """
    ratios = {"path": path, "stack": stack, "env": env, "recency": recency}
    total = sum((F.lit(weight) * ratios[name] for name, weight in SCORE_WEIGHTS.items()), F.lit(0.0))
    return F.bround(F.round(total * 100, 10), 0).cast("int")


def freshness_label(score: Column) -> Column:
    return F.when(score >= 90, "Fresh").when(score >= 70, "Needs Review").otherwise("Stale")


def density(value: Column, top: Column) -> Column:
    """Percent of the group's maximum, 0..100."""
    top = F.when(top == 0, F.lit(1)).otherwise(top)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(value / top * 100, 0).cast("int")))


def bar_cells(value: Column, top: Column, width: int = BAR_WIDTH) -> Column:
    filled = F.greatest(F.lit(1), F.bround(value * width / top, 0).cast("int"))
    return F.when((top <= 0) | (value <= 0), F.lit(0)).otherwise(F.least(F.lit(width), filled))


def heat(value: Column, top: Column) -> Column:
    ratio = F.when(top == 0, F.lit(0.0)).otherwise(value / top)
    return F.when(ratio > 2 / 3, "red").when(ratio > 1 / 3, "yellow").otherwise("green")
