"""Validation rules as columns: what is wrong with a row, checked strictly or by leaving invalid rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normal_path

#: Event and workflow types that the log accepts, and the limits of findings, summaries and packs.
EVENT_TYPES = ("workflow_started", "started", "progress", "completed", "failed", "workflow_completed", "workflow_failed")
WORKFLOW_TYPES = ("repo_indexing", "pr_review")
CHANGE_TYPES = ("added", "modified", "removed", "renamed")
TITLE, MESSAGE, FIX, SUMMARY_LEAST, ITEMS, CHARACTERS, CONFIDENT = 255, 10, 10, 20, 35, 120_000, 0.7


def _stripped(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")


def problems(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, in order; a rule is a condition that must not hold. Null conditions hold nothing against a row."""
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())


def checked(df: DataFrame, found: Column, strict: bool = False) -> DataFrame:
    """df without its invalid rows; strictly, an error at the first one when the rows are read."""
    marked = df.withColumn("_problems", found)
    if strict:
        fine = F.when(F.size("_problems") == 0, True).otherwise(F.raise_error(F.concat(F.lit("invalid row: "), F.array_join("_problems", ", "))).cast("boolean"))
        return marked.where(fine).drop("_problems")
    return marked.where(F.size("_problems") == 0).drop("_problems")


def patch_problems(patches: DataFrame) -> Column:
    """Patches with file_path, change_type, previous_filename, additions, deletions and hunks (array with hunk_id, new_start)."""
    starts = F.transform("hunks", lambda h: h["new_start"])
    later = F.exists(F.zip_with(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))), lambda b, a: b < a), lambda x: x)
    return problems({
        "empty path": normal_path(F.coalesce("file_path", F.lit(""))) == "", "unknown change type": ~F.coalesce(F.col("change_type").isin(*CHANGE_TYPES), F.lit(False)),
        "previous name of a file that isn't renamed": F.col("previous_filename").isNotNull() & (F.col("change_type") != "renamed"), "hunks out of order": later,
        "hunk without an id": F.exists("hunks", lambda h: _stripped(h["hunk_id"]) == ""), "negative count": (F.col("additions") < 0) | (F.col("deletions") < 0),
    })


def changed_line_list(lines: Column) -> Column:
    """Changed lines without repetitions, ascending."""
    return F.array_sort(F.array_distinct(lines))


def span_problems(path: Column, name: Column, start: Column, end: Column) -> Column:
    return problems({"empty path": normal_path(F.coalesce(path, F.lit(""))) == "", "empty name": _stripped(name) == "", "ends before it starts": end < start})


def finding_problems(sequential: bool = False) -> Column:
    """Findings with title, message, suggested_fix, file_path, hunk_id, line_in_hunk, confidence; sequential adds finding_id and number."""
    title, line = _stripped(F.col("title")), F.col("line_in_hunk")
    rules = {
        "empty title": title == "", "long title": F.length("title") > TITLE, "short message": F.length(_stripped(F.col("message"))) < MESSAGE, "short fix": F.length(_stripped(F.col("suggested_fix"))) < FIX,
        "empty path": normal_path(F.coalesce("file_path", F.lit(""))) == "", "line without a hunk": line.isNotNull() & (F.coalesce("hunk_id", F.lit("")) == ""), "negative line": line < 0,
        "confidence": F.coalesce(~F.col("confidence").between(0, 1), F.lit(True)),
    }
    if sequential:
        rules["id out of sequence"] = F.col("finding_id") != F.concat(F.lit("finding_"), F.col("number").cast("string"))
    return problems(rules)


def review_problems(findings: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """reviews (key, summary, total_findings, high_confidence_findings) with what is wrong: ids repeated or out of sequence, totals that don't match, a short summary."""
    number = F.row_number().over(Window.partitionBy(key).orderBy("place"))
    wrong = F.col("finding_id") != F.concat(F.lit("finding_"), F.col("n").cast("string"))
    own = findings.withColumn("n", number).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("finding_id").alias("_ids"), F.sum(wrong.cast("int")).alias("_wrong"), F.sum((F.col("confidence") >= CONFIDENT).cast("long")).alias("_high"))
    joined = reviews.join(own, key, "left")
    n, high = F.coalesce("_n", F.lit(0)), F.coalesce("_high", F.lit(0))
    found = problems({"ids repeat": F.col("_ids") < n, "ids out of sequence": F.col("_wrong") > 0, "short summary": F.length(_stripped(F.col("summary"))) < SUMMARY_LEAST, "total": F.col("total_findings") != n, "high confidence total": F.col("high_confidence_findings") != high})
    return joined.withColumn("problems", found).drop("_n", "_ids", "_wrong", "_high")


def pack_problems(items: DataFrame, pack: str) -> DataFrame:
    """Packs with their items, characters and what is wrong: repeated item ids, too many items or characters."""
    own = items.groupBy(pack).agg(F.count(F.lit(1)).alias("items"), F.count_distinct("item_id").alias("_ids"), F.sum("chars").cast("long").alias("chars"))
    return own.withColumn("problems", problems({"item ids repeat": F.col("_ids") < F.col("items"), "too many items": F.col("items") > ITEMS, "too large": F.col("chars") > CHARACTERS})).drop("_ids")


def commit_sha(sha: Column) -> Column:
    """A commit's hash in lower case; null if it isn't 40 hex digits."""
    return F.when(sha.rlike("^[0-9a-fA-F]{40}$"), F.lower(sha))


def is_repository(name: Column) -> Column:
    """Whether a name has the form owner/repository."""
    return F.coalesce(name.rlike(r"^[^/\s]+/[^/\s]+$"), F.lit(False))


def event_problems() -> Column:
    """Events with event_type, workflow_type and sequence."""
    unknown = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    return problems({"unknown event type": unknown("event_type", EVENT_TYPES), "unknown workflow type": unknown("workflow_type", WORKFLOW_TYPES), "sequence": F.coalesce(F.col("sequence") <= 0, F.lit(True))})


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys that occur more than once: duplicate symbols of a file, name and span, or duplicate files."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
