"""Snippets of a tree's files for candidates: guarded paths, size limit, binary files, encodings and line ranges, each file read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.diff import BINARY_SUFFIXES

#: Bytes of a file that is read, lines that a snippet has beyond its first by default, characters of a line, bytes that are looked at for binary content.
MOST_BYTES, MORE_LINES, LONGEST_LINE, LOOKED_AT = 10 << 20, 50, 10_000, 1024


def inside(path: Column) -> Column:
    """A path below the tree's root, without what leads back out of it; null where it does."""
    plain = F.regexp_replace(F.regexp_replace(path, "^/+", ""), r"^\./", "")
    parts = F.filter(F.split(plain, "/"), lambda x: (x != "") & (x != "."))
    depth = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda s, x: s + F.when(x == "..", -1).otherwise(1)))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x))))
    return F.when((F.array_min(depth) >= 0) & (F.size(folded) > 0), F.array_join(folded, "/"))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 where they are, else Latin-1, which any bytes are."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def snippets(candidates: DataFrame, files: DataFrame, most_bytes: int | None = MOST_BYTES, longest_line: int | None = LONGEST_LINE) -> DataFrame:
    """candidates (ord, file_path, start_line, end_line, max_lines) with content, first and last line, or an error.

    files: path, length, content (see scan_tree). Start defaults to 1; the end
    to max_lines, else 50 lines more. Lines over longest_line are cut; None:
    no line is, or no file is too large (most_bytes). Errors: a path that
    isn't in the tree, a file that is too large or binary, a start behind the
    file's end. Order and number of candidates stay.
    """
    binary = F.lit(False)
    for suffix in BINARY_SUFFIXES:
        binary = binary | F.lower("path").endswith(suffix)
    zero = F.contains(F.hex(F.substring("content", 1, LOOKED_AT)), F.lit("00")) & F.expr(f"position('00', regexp_replace(hex(substring(content, 1, {LOOKED_AT})), '(..)', '$1 ')) > 0")
    error = F.when(F.lit(False) if most_bytes is None else F.col("length") > most_bytes, "file too large").when(binary, "binary file type").when(zero, "binary file")
    known = files.withColumn("_error", error)
    lines = F.when(F.col("_error").isNull(), F.split(decoded(F.col("content")), "(?<=\n)"))
    cut = F.filter(lines, lambda x: x != "")
    if longest_line is not None:
        cut = F.transform(cut, lambda x: F.when(F.length(x) > longest_line, F.concat(F.substring(x, 1, longest_line - 20), F.lit("... [line truncated]\n"))).otherwise(x))
    known = known.select(F.col("path").alias("_path"), "_error", cut.alias("_lines"))
    start = F.coalesce("start_line", F.lit(1))
    end = F.coalesce("end_line", start + F.col("max_lines") - 1, start + MORE_LINES)
    rows = candidates.withColumn("_inside", inside(F.col("file_path"))).join(known, F.col("_inside") == F.col("_path"), "left")
    n = F.size("_lines")
    why = F.when(F.col("_path").isNull(), "not found").otherwise(F.coalesce("_error", F.when(start > n, "starts behind the end")))
    taken = F.slice("_lines", F.greatest(start, F.lit(1)).cast("int"), F.greatest(F.least(end, n) - F.greatest(start, F.lit(1)) + 1, F.lit(0)).cast("int"))
    rows = rows.withColumn("error", why).withColumn("_taken", F.when(F.col("error").isNull(), taken))
    return rows.select(*candidates.columns, F.coalesce(F.array_join("_taken", ""), F.lit("")).alias("content"), start.cast("long").alias("first_line"), F.when(F.col("error").isNull(), start + F.size("_taken") - 1).cast("long").alias("last_line"), "error")
