"""Unified diffs: hunks, line numbers, positions. Whole patches stay in one row; nothing is shuffled until lines are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normal_path

#: The header of a hunk, and the suffixes of binary files.
HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"
BINARY_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".tar", ".gz", ".rar", ".7z",
    ".exe", ".dll", ".so", ".dylib", ".mp3", ".mp4", ".avi", ".mov", ".wav", ".ttf", ".otf", ".woff", ".woff2",
)
STATUSES = ("added", "removed", "modified", "renamed", "copied")


def header_part(line: Column, group: int, default: int) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(line, HEADER, group), F.lit("")).cast("long"), F.lit(default).cast("long"))


def patch_lines(patches: DataFrame) -> DataFrame:
    """Lines of patches (path, patch): path, hunk (from 1 on), idx (0 is the header), line, new_line of lines that are in the new file.

    Lines before the first header or after a 'diff ' line belong to no hunk. A null patch has none.
    """
    rows = patches.select("path", F.posexplode(F.split(F.coalesce("patch", F.lit("")), "\n")).alias("pos", "line"))
    is_header = F.col("line").rlike(HEADER)
    by = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hunk", F.sum(is_header.cast("long")).over(by)).withColumn("open", F.last(F.when(is_header, True).when(F.col("line").startswith("diff "), False), ignorenulls=True).over(by))
    rows = rows.where(F.coalesce("open", F.lit(False)))
    inside = Window.partitionBy("path", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("path", "hunk").orderBy("pos")).cast("long") - 1)
    start = F.first(F.when(is_header, header_part(F.col("line"), 3, 1)), ignorenulls=True).over(inside)
    counted = (~is_header & ~F.col("line").startswith("-")).cast("long")
    rows = rows.withColumn("new_line", F.when(counted == 1, start + F.sum(counted).over(inside) - 1))
    return rows.select("path", "hunk", "idx", "line", "new_line")


def changed_new_lines(lines: Column, new_start: int | Column) -> Column:
    """Numbers in the new file of a hunk's added lines; headers and removed lines don't count."""
    start = F.lit(new_start).cast("long") if isinstance(new_start, int) else new_start.cast("long")
    state = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        skip = x.startswith("@@") | x.startswith("-")
        return F.when(skip, s).otherwise(F.struct((s["at"] + 1).alias("at"), F.when(x.startswith("+"), F.concat(s["out"], F.array(s["at"]))).otherwise(s["out"]).alias("out")))

    return F.aggregate(lines, state, step, lambda s: s["out"])


def file_status(status: Column) -> Column:
    """The status as reported, modified if it is none of the known ones."""
    return F.when(status.isin(*STATUSES), status).otherwise("modified")


def change_type(additions: Column, deletions: Column, status: Column) -> Column:
    """The kind of change: by status where a file was added, removed or only renamed, else by what its lines show."""
    plain = F.when((additions > 0) & (deletions == 0), "added").when((additions == 0) & (deletions > 0), "removed").otherwise("modified")
    return F.when(status.isin("added", "removed"), status).when((status == "renamed") & (additions == 0) & (deletions == 0), "renamed").otherwise(plain)


def is_binary(path: Column, patch: Column, flag: Column | None = None) -> Column:
    """Whether a file is binary: by its flag, its patch or its suffix."""
    by_name = F.lit(False)
    for suffix in BINARY_SUFFIXES:
        by_name = by_name | F.lower(path).endswith(suffix)
    return F.coalesce(flag if flag is not None else F.lit(False), F.lit(False)) | F.coalesce(patch.rlike(r"Binary files? .* differ"), F.lit(False)) | by_name


def positions(hunks: DataFrame) -> DataFrame:
    """Lines of a file's diff that precede each hunk: a header and its lines for each earlier one."""
    before = Window.partitionBy("path").orderBy("hunk").rowsBetween(Window.unboundedPreceding, -1)
    return hunks.withColumn("offset", F.coalesce(F.sum(F.col("n_lines") + 1).over(before), F.lit(0)).cast("long"))


def nearest_commentable(lines: DataFrame, keys: list[str]) -> DataFrame:
    """For each line of a hunk the index of the line to comment on: itself unless removed, else the next one, else the one before."""
    ok = F.when(F.col("mark") != "-", F.col("idx"))
    ahead = Window.partitionBy(*keys).orderBy("idx").rowsBetween(0, Window.unboundedFollowing)
    back = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("target_idx", F.coalesce(F.first(ok, ignorenulls=True).over(ahead), F.last(ok, ignorenulls=True).over(back)))


def comment_positions(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """Where findings can be commented on in their file's diff, or why not.

    findings: ord, file_path, hunk_id, line_in_hunk; hunks: path, hunk (order in
    its file), hunk_id, lines (without the header). Adds position (from 1 on,
    headers counted), adjusted_line, adjusted and failure_reason. A removed
    line gives way to the next line that isn't, else to the one before. Of
    hunks that share an id the first counts.
    """
    offset = F.coalesce(F.sum(F.size("lines") + 1).over(Window.partitionBy("path").orderBy("hunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.row_number().over(Window.partitionBy("path", "hunk_id").orderBy("hunk"))
    placed = hunks.withColumn("path", normal_path(F.col("path"))).withColumn("offset", offset).withColumn("first", first).where("first = 1")
    placed = placed.select(F.col("path").alias("_path"), F.col("hunk_id").alias("_hunk"), "lines", "offset")
    files = placed.select(F.col("_path").alias("_file")).distinct()
    at, size = F.col("line_in_hunk"), F.size("lines")
    free = F.filter(F.sequence(F.lit(0), size - 1), lambda i: ~F.element_at("lines", i + 1).startswith("-"))
    target = F.coalesce(F.array_min(F.filter(free, lambda i: i >= at)), F.array_max(F.filter(free, lambda i: i < at)))
    found = findings.withColumn("_path", normal_path(F.col("file_path"))).withColumn("_hunk", F.col("hunk_id"))
    found = found.join(placed, ["_path", "_hunk"], "left").join(files, F.col("_path") == F.col("_file"), "left")
    reason = (
        F.when(F.col("hunk_id").isNull() | at.isNull(), "not anchored")
        .when(F.col("_file").isNull(), F.concat(F.lit("No patch found for file: "), F.col("file_path")))
        .when(F.col("offset").isNull(), F.concat(F.lit("Hunk not found: "), F.col("hunk_id")))
        .when(at < 0, F.concat(F.lit("line_in_hunk cannot be negative: "), at.cast("string")))
        .when(at >= size, F.concat(F.lit("line_in_hunk "), at.cast("string"), F.lit(" is out of range (hunk has "), size.cast("string"), F.lit(" lines)")))
        .when(target.isNull(), "Target line is a deletion and no valid adjacent line found")
    )
    found = found.withColumn("failure_reason", reason).withColumn("_target", F.when(F.col("failure_reason").isNull(), target))
    found = found.withColumn("position", (F.col("offset") + F.col("_target") + 2).cast("long"))
    found = found.withColumn("adjusted", F.coalesce((F.col("_target") != at) | F.col("failure_reason").startswith("Target"), F.lit(False)))
    return found.withColumn("adjusted_line", F.when(F.col("adjusted"), F.col("_target")).cast("long")).drop("_path", "_hunk", "_file", "_target", "lines", "offset")


def split_counts(placed: DataFrame) -> DataFrame:
    """One row over comment_positions(): findings with a position, without one, and how many were calculated, failed and adjusted."""
    tried, lost = F.col("failure_reason").isNull() | (F.col("failure_reason") != "not anchored"), F.col("position").isNull()
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    return placed.agg(count(~lost).alias("anchored"), count(lost).alias("unanchored"), count(tried).alias("calculations"), count(tried & lost).alias("failures"), count(F.col("adjusted") & ~lost).alias("adjustments"))


#: Files and lines from which a pull request is large, is rejected, or is skipped.
LARGE_FILES, LARGE_LINES, MOST_FILES, MOST_LINES = 25, 500, 50, 2500


def file_totals(hunks: DataFrame) -> DataFrame:
    """Hunks, added, removed and changed lines of each file."""
    return hunks.groupBy("path").agg(F.count(F.lit(1)).alias("n_hunks"), F.sum("additions").cast("long").alias("additions"), F.sum("deletions").cast("long").alias("deletions"), F.sum(F.col("additions") + F.col("deletions")).cast("long").alias("changed"))


def size_flags(hunks: DataFrame, key: str) -> DataFrame:
    """Files and changes of each pull request, and whether it is large, rejected or skipped."""
    per = hunks.groupBy(key).agg(F.count_distinct("path").alias("files"), F.sum(F.col("additions") + F.col("deletions")).cast("long").alias("changes"))
    files, lines = F.col("files"), F.col("changes")
    return per.withColumn("is_large", (files > LARGE_FILES) | (lines > LARGE_LINES)).withColumn("rejected", files > MOST_FILES).withColumn("skip", (files > MOST_FILES) | (lines > MOST_LINES))


def integrity(hunks: DataFrame, slack: int = 0) -> DataFrame:
    """Lines that each file's hunks really add and remove, and how many hunks begin before the one ahead ends."""
    ahead = F.lag(F.col("new_start") + F.col("new_count")).over(Window.partitionBy("path").orderBy("new_start"))
    rows = hunks.withColumn("_over", F.coalesce(F.col("new_start") < ahead - slack, F.lit(False)).cast("long"))
    return rows.groupBy("path").agg(F.sum("additions").cast("long").alias("additions"), F.sum("deletions").cast("long").alias("deletions"), F.sum("_over").alias("overlapping"))


def declared_matches(declared_additions: Column, declared_deletions: Column, lines: Column) -> Column:
    """Whether a patch has as many added and removed lines as it was declared with."""
    count = lambda mark, header: F.size(F.filter(lines, lambda x: x.startswith(mark) & ~x.startswith(header)))
    return (count("+", "+++") == declared_additions) & (count("-", "---") == declared_deletions)


def is_line_of(index: Column, lines: Column) -> Column:
    """Whether an index is one of a hunk's lines."""
    return (index >= 0) & (index < lines)


def with_hunks(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """findings (file_path, hunk_id) with their hunk by normalised path and id; of hunks that share both the last one, null where there is none."""
    rest = [c for c in hunks.columns if c not in ("path", "hunk_id")]
    own = hunks.groupBy(normal_path(F.col("path")).alias("_path"), F.col("hunk_id").alias("_hunk")).agg(F.max_by(F.struct(*rest), "hunk").alias("_h"))
    found = findings.join(own, (normal_path(F.col("file_path")) == F.col("_path")) & (F.col("hunk_id") == F.col("_hunk")), "left")
    return found.select(*findings.columns, *[F.col(f"_h.{c}").alias(c) for c in rest])
