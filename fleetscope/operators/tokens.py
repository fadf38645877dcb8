"""Token volumes and conversation context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import text
from fleetscope.operators.ordered import top_k

# Fixed values.
HISTORY_MESSAGES = 20
CHAT_ROLES = ["user", "assistant"]


def corpus_tokens(files: DataFrame, key: str = "repo", content: str = "content", estimate: Column | None = None) -> DataFrame:
    """Estimated tokens per repository, and of the fleet in the row with ``is_total``; ``estimate`` names
    the tokens of a file where they are known.

    The rollup runs over one row per repository, not over doubled file rows."""
    counted = text.token_estimate(F.col(content)) if estimate is None else estimate
    per_key = files.groupBy(key).agg(F.sum(counted).alias("__t"), F.count(F.lit(1)).alias("__n"))
    return per_key.rollup(key).agg(
        F.sum("__t").alias("tokens"), F.sum("__n").alias("files"), (F.grouping(key) == 1).alias("is_total")
    )


def token_savings(
    raw: DataFrame, brief: DataFrame, keys: Sequence[str] = ("repo",), tokens: str = "tokens"
) -> DataFrame:
    """Raw against brief tokens per repository."""
    left = raw.select(*keys, F.col(tokens).alias("raw_tokens"))
    right = brief.select(*keys, F.col(tokens).alias("brief_tokens"))
    joined = left.join(right, list(keys), "left").withColumn("brief_tokens", F.coalesce("brief_tokens", F.lit(0)))
    return joined.select(
        *keys,
        "raw_tokens",
        "brief_tokens",
        text.savings_percent(F.col("raw_tokens"), F.col("brief_tokens")).alias("savings"),
        text.compact_count(F.col("raw_tokens")).alias("raw_label"),
    )


def usable_messages(messages: DataFrame, role: str = "role", content: str = "text") -> DataFrame:
    """User and assistant messages with text, roles cleaned."""
    clean = F.lower(text.strip(F.col(role)))
    return messages.withColumn(role, clean).filter(
        F.col(role).isin(CHAT_ROLES) & (text.strip(F.col(content)) != "")
    )


def history_window(
    messages: DataFrame,
    keys: Sequence[str] = ("conv_id",),
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    limit: int = HISTORY_MESSAGES,
) -> DataFrame:
    """Last ``limit`` usable messages per conversation. Ranked on the turn alone; the text is carried
    only by rows that survive the map-side rank limit."""
    return top_k(usable_messages(messages, role, content), keys, [F.desc(turn)], limit)


def session_usage(
    messages: DataFrame,
    keys: Sequence[str] = ("conv_id",),
    role: str = "role",
    content: str = "text",
    context_tokens: Column | int = 0,
    separator: int = 0,
) -> DataFrame:
    """User turns and tokens. The estimate is taken on the length of the joined text, not summed per
    message; ``separator`` is the length of what joins two messages."""
    length = F.sum(F.length(content)) + separator * (F.count(content) - 1)
    context = F.lit(context_tokens) if isinstance(context_tokens, int) else context_tokens
    usage = messages.groupBy(*keys).agg(
        F.count_if(F.col(role) == "user").alias("turns"), text.tokens_of_length(length).alias("conversation_tokens")
    )
    return usage.withColumn("context_tokens", context.cast("bigint")).withColumn(
        "total_tokens", F.col("context_tokens") + F.col("conversation_tokens")
    )
