"""Recorded answers of a code host as sources: pull-request details, their changed files in pages, and raw diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REF = "struct<ref:string,sha:string,repo:struct<name:string,full_name:string>>"
DETAILS = f"id long, number long, title string, body string, state string, draft boolean, mergeable boolean, mergeable_state string, merged boolean, user struct<login:string,id:long,type:string>, created_at timestamp, updated_at timestamp, closed_at timestamp, merged_at timestamp, base {REF}, head {REF}, commits long, additions long, deletions long, changed_files long"
FILES = "sha string, filename string, status string, additions long, deletions long, changes long, previous_filename string, binary boolean, patch string"


def pull_requests(spark: SparkSession, path: str) -> DataFrame:
    """Details of pull requests, one JSON document a file; what isn't JSON is left out."""
    return spark.read.schema(DETAILS).option("multiLine", True).json(path).where("number IS NOT NULL")


def pull_request_files(spark: SparkSession, path: str) -> DataFrame:
    """Changed files of pull requests from pages, each a JSON array in a file of its own; page is the file's name, place the order in it. A file that two pages repeat comes once."""
    rows = spark.read.schema(FILES).option("multiLine", True).json(path)
    rows = rows.withColumn("page", F.element_at(F.split(F.input_file_name(), "/"), -1)).where("filename IS NOT NULL")
    return rows.groupBy("filename", "sha").agg(*[F.min_by(c, "page").alias(c) for c in ("status", "additions", "deletions", "changes", "previous_filename", "binary", "patch")], F.min("page").alias("page"))


def raw_diffs(spark: SparkSession, path: str) -> DataFrame:
    """Whole diffs, one a file, as patches by file: source, path, patch. A file's part begins at its 'diff --git' line; the new name counts, the old one where the file is deleted."""
    texts = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.posexplode(F.split("value", r"(?m)^(?=diff --git )")).alias("place", "part"))
    parts = texts.where(F.col("part").startswith("diff --git "))
    new, old = F.regexp_extract("part", r"(?m)^\+\+\+ b/(.+)$", 1), F.regexp_extract("part", r"(?m)^--- a/(.+)$", 1)
    named = F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")), F.regexp_extract("part", r"^diff --git a/.+ b/(.+)", 1))
    patch = F.regexp_extract("part", r"(?s)(@@ .*)", 1)
    return parts.select("source", "place", named.alias("path"), F.nullif(patch, F.lit("")).alias("patch"))
