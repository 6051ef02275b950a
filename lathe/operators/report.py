"""Reports of findings: counts, bodies, fallbacks and what doesn't fit. Each section holds a bounded number of findings, whatever a group's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import first_rows
from .review import severity_rank


def counts(findings: DataFrame) -> DataFrame:
    """Findings by severity and category, with the defaults of both."""
    return findings.groupBy(F.coalesce("severity", F.lit("medium")).alias("severity"), F.coalesce("category", F.lit("style")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def _joined(text: str, order: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")


def body(findings: DataFrame, most: int) -> DataFrame:
    """Markdown of the surest findings of each severity, and how many there are."""
    sizes = F.count(F.lit(1)).over(Window.partitionBy("severity"))
    rows = first_rows(findings.withColumn("n", sizes), ["severity"], [F.coalesce("confidence", F.lit(0.0)).desc(), F.col("ord")], most, "_r")
    line = F.concat(F.lit("**["), F.upper("severity"), F.lit("] "), "title", F.lit("** (`"), "file_path", F.lit("`, "), "category", F.lit(")"))
    return rows.withColumn("_line", line).groupBy("severity").agg(F.max("n").alias("n"), _joined("_line", "_r").alias("body"))


def fallback(findings: DataFrame, most: int) -> DataFrame:
    """Markdown of findings without a place, by file: the gravest ones, and how many more there are."""
    sizes = F.count(F.lit(1)).over(Window.partitionBy("file_path"))
    rows = first_rows(findings.withColumn("n", sizes), ["file_path"], [severity_rank(F.col("severity")), F.coalesce("confidence", F.lit(0.0)).desc(), F.col("ord")], most, "_r")
    rows = rows.withColumn("_line", F.concat(F.lit("- **"), "severity", F.lit("** "), "title")).groupBy("file_path").agg(F.max("n").alias("n"), _joined("_line", "_r").alias("lines"))
    more = F.when(F.col("n") > most, F.concat(F.lit("\n- ... and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return rows.select("file_path", F.concat(F.lit("### `"), "file_path", F.lit("` ("), F.col("n").cast("string"), F.lit(")\n"), "lines", more).alias("section"))


def overflow(findings: DataFrame, most: int) -> DataFrame:
    """The first findings without a place that aren't among those with one, by file and title, and how many are beyond them."""
    key = F.concat_ws("::", "file_path", F.substring("title", 1, 30))
    keyed = findings.withColumn("_key", key)
    left = keyed.where("NOT anchored").join(keyed.where("anchored").select("_key").distinct(), "_key", "left_anti")
    total = left.agg(F.count(F.lit(1)).alias("_n"))
    return left.orderBy("ord").limit(most).crossJoin(F.broadcast(total)).select("title", (F.col("_n") - most).alias("more"))


def fallback_summary(hunks: DataFrame) -> DataFrame:
    """One line about all files: how many, and the lines added and removed."""
    sums = hunks.agg(F.count_distinct("path").alias("files"), F.coalesce(F.sum("additions"), F.lit(0)).cast("long").alias("a"), F.coalesce(F.sum("deletions"), F.lit(0)).cast("long").alias("d"))
    return sums.select(F.concat(F.lit("Reviewed "), F.col("files").cast("string"), F.lit(" files: +"), F.col("a").cast("string"), F.lit(" -"), F.col("d").cast("string")).alias("summary"))


def fallback_findings(seeds: DataFrame, most: int) -> DataFrame:
    """Findings without a model: the first changed seeds, numbered, at a medium severity and confidence."""
    first = seeds.orderBy("seed_id").limit(most)
    n = F.row_number().over(Window.orderBy("seed_id")).cast("string")
    return first.select(F.concat(F.lit("finding_"), n).alias("finding_id"), "name", "path", F.lit("medium").alias("severity"), F.lit(0.5).alias("confidence"))


def formatted(finding_section: bool) -> Column:
    """A finding (severity, title, category, message, suggested_fix, confidence, file_path) as Markdown: a comment beside the code, or a section of the body that tells its file."""
    label = F.concat(F.lit("["), F.upper("severity"), F.lit("] "))
    fix = F.coalesce("suggested_fix", F.lit(""))
    fenced = F.when(fix.rlike(r"[{}()=;]|def |class "), F.concat(F.lit("```\n"), fix, F.lit("\n```"))).otherwise(fix)
    fix = F.when(fix == "", "").otherwise(F.concat(F.lit("**Suggested Fix:**\n"), fenced, F.lit("\n\n")))
    message = F.when(F.coalesce("message", F.lit("")) == "", "").otherwise(F.concat("message", F.lit("\n\n")))
    sure = F.concat(F.lit("*Confidence: "), F.format_string("%.0f", F.coalesce("confidence", F.lit(0.0)) * 100), F.lit("%*"))
    if finding_section:
        return F.concat(F.lit("#### "), label, "title", F.lit("\n**File:** `"), "file_path", F.lit("`\n*Severity: "), "severity", F.lit(" | Category: "), "category", F.lit("*\n\n"), message, fix, sure, F.lit("\n"))
    return F.concat(label, F.lit("**"), "title", F.lit("**\n\n*Category: "), "category", F.lit("*\n\n"), message, fix, sure)


def payloads(reviews: DataFrame, findings: DataFrame, keys: list[str], most_comments: int, most_sections: int) -> DataFrame:
    """keys, payload: what is sent for each review (keys, commit_id, summary), as JSON of commit_id, body, event and comments.

    Findings with a position become comments (path, position, body), the
    gravest first, and those without one sections of the body; as many of both
    as a review may have, chosen before they meet. A review without findings has
    its summary only.
    """
    order = [severity_rank(F.col("severity")), F.coalesce("confidence", F.lit(0.0)).desc(), F.col("ord")]
    placed, loose = F.col("position").isNotNull(), F.col("position").isNull()
    inline = first_rows(findings.where(placed), keys, order, most_comments, "_r").select(*keys, F.struct("_r", F.struct(F.col("file_path").alias("path"), "position", formatted(False).alias("body")).alias("comment")).alias("_c"))
    inline = inline.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("_c")), lambda x: x["comment"]).alias("comments"))
    extra = first_rows(findings.where(loose), keys, order, most_sections, "_r").withColumn("_line", formatted(True)).groupBy(*keys).agg(_joined("_line", "_r").alias("_extra"))
    heading = "\n## Additional Findings\n\n*The following findings could not be anchored to specific diff locations:*\n\n"
    body = F.concat(F.lit("## Summary\n\n"), "summary", F.lit("\n"), F.coalesce(F.concat(F.lit(heading), "_extra"), F.lit("")))
    rows = reviews.join(inline, keys, "left").join(extra, keys, "left").withColumn("body", body).withColumn("event", F.lit("COMMENT")).withColumn("comments", F.coalesce("comments", F.array().cast("array<struct<path: string, position: bigint, body: string>>")))
    return rows.select(*keys, F.to_json(F.struct("commit_id", "body", "event", "comments")).alias("payload"))
