"""Conversations as chat sessions and as documents whose headings are user turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.operators import lines, tokens
from fleetscope.plans.catalog.base import Registry, Tables

QUERIES = Registry()


@QUERIES.query("history_window", """
SELECT conv_id, turn, role, text FROM conversations
WHERE role IN ('user', 'assistant') AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def history_window(t: Tables) -> DataFrame:
    return tokens.history_window(t("conversations"), limit=3)


@QUERIES.query("session_usage", """
SELECT conv_id, count(*) FILTER (role = 'user') AS turns,
       CAST(CASE WHEN sum(length(text)) = 0 THEN 0 ELSE greatest(1, sum(length(text)) // 4) END AS BIGINT) AS conversation_tokens,
       CAST(100 AS BIGINT) AS context_tokens,
       CAST(100 + CASE WHEN sum(length(text)) = 0 THEN 0 ELSE greatest(1, sum(length(text)) // 4) END AS BIGINT) AS total_tokens
FROM conversations GROUP BY conv_id""")
def session_usage(t: Tables) -> DataFrame:
    return tokens.session_usage(t("conversations"), context_tokens=100)


SECTIONS = """
marked AS (SELECT *, CASE WHEN role = 'user' THEN text END AS heading, CASE WHEN role = 'user' THEN turn END AS head_turn FROM conversations),
sections AS (
    SELECT conv_id, turn, role, text,
           last_value(head_turn IGNORE NULLS) OVER w AS section_no, last_value(heading IGNORE NULLS) OVER w AS section
    FROM marked WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


def sections(t: Tables) -> DataFrame:
    heading = F.when(F.col("role") == "user", F.col("text"))
    return lines.with_section(t("conversations"), ["conv_id"], "turn", heading, F.floor(F.col("turn") / 4))


@QUERIES.query("section_split", f"""
WITH {SECTIONS} SELECT conv_id, turn, role, section_no, section FROM sections WHERE section_no IS NOT NULL""")
def section_split(t: Tables) -> DataFrame:
    """Messages under the user turn they answer; blocks of four turns exercise the carried form."""
    return sections(t).select("conv_id", "turn", "role", "section_no", "section")


@QUERIES.query("section_findings", f"""
WITH {SECTIONS}
SELECT conv_id, section_no, bool_or(role = 'assistant' AND starts_with('- ' || text, '- ') AND length(text) > 200 AND '- ' || text <> '- None detected.') AS has_findings
FROM sections WHERE section_no IS NOT NULL GROUP BY ALL""")
def section_findings(t: Tables) -> DataFrame:
    """Sections with a long answer; answers play the bullets."""
    bullet = F.concat(F.lit("- "), F.col("text"))
    relevant = (F.col("role") == "assistant") & (F.length("text") > 200)
    return lines.section_findings(sections(t), ["conv_id", "section_no"], bullet, relevant)
