"""Fields that are worked out of seeds, context items and findings for logs and displays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From which confidence on a finding is sure, up to which priority an item is urgent, and the severities that are critical.
SURE, URGENT, CRITICAL = 0.7, 2, ("blocker", "high")


def seed_fields(seeds: DataFrame) -> DataFrame:
    """seeds (name, qualified_name, kind, start_line, end_line) with line_span and display_name; an empty qualified name counts as none."""
    name = F.coalesce(F.nullif("qualified_name", F.lit("")), F.col("name"))
    return seeds.withColumns({"line_span": F.col("end_line") - F.col("start_line") + 1, "display_name": F.concat(name, F.lit(" ("), "kind", F.lit(")"))})


def item_fields(items: DataFrame) -> DataFrame:
    """items (start_line, end_line, chars, priority) with line_span (null without both lines), character_count and is_high_priority."""
    return items.withColumns({"line_span": F.col("end_line") - F.col("start_line") + 1, "character_count": F.coalesce("chars", F.lit(0)), "is_high_priority": F.col("priority") <= URGENT})


def finding_fields(findings: DataFrame) -> DataFrame:
    """findings (hunk_id, line_in_hunk, confidence, severity) with is_anchorable, is_high_confidence, is_critical and display_severity."""
    return findings.withColumns({
        "is_anchorable": F.col("hunk_id").isNotNull() & F.col("line_in_hunk").isNotNull(), "is_high_confidence": F.coalesce(F.col("confidence") >= SURE, F.lit(False)), "is_critical": F.col("severity").isin(*CRITICAL), "display_severity": F.upper("severity"),
    })
