"""Upserts and appends of the review store: pull requests, runs, findings, snapshots, installations.

Every function takes the stored table and what is new, and returns the table
as it is afterwards; the caller writes it. Keys are joined or ranked, so no
table is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import severity_to_store


def upserted(stored: DataFrame, fresh: DataFrame, keys: list[str], updated: list[str], order: list[str] | None = None) -> DataFrame:
    """stored with the rows of fresh: of a known key only the columns updated change, a new key is inserted as a whole.

    Of several fresh rows of a key, the first by order is the one inserted and
    the last gives the updated columns. Both tables have the same columns.
    """
    order = order or updated
    ranked = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    rest = [c for c in stored.columns if c not in keys]
    new = ranked.groupBy(*keys).agg(*[(F.max_by if c in updated else F.min_by)(c, "_n").alias(f"_{c}") for c in rest], F.lit(True).alias("_fresh"))
    old = stored.withColumn("_known", F.lit(True))
    both = old.join(new, keys, "full_outer")
    value = lambda c: F.when(F.col("_fresh") & (F.col("_known").isNull() | F.lit(c in updated)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*keys, *[value(c) for c in rest]).select(*stored.columns)


def pull_requests(stored: DataFrame, reviews: DataFrame) -> DataFrame:
    """stored (repository_id, pr_number, title, head_sha, base_sha, state, updated_at) after reviews (repository_id, pr_number, head_sha, base_sha, at)."""
    title = F.concat(F.lit("PR #"), F.col("pr_number").cast("string"))
    fresh = reviews.select("repository_id", "pr_number", title.alias("title"), "head_sha", "base_sha", F.lit("open").alias("state"), F.col("at").alias("updated_at"))
    return upserted(stored, fresh, ["repository_id", "pr_number"], ["head_sha", "base_sha", "updated_at"], ["updated_at", "head_sha"])


def runs_started(stored: DataFrame, runs: DataFrame) -> DataFrame:
    """stored review runs with new ones, pending and unpublished."""
    return stored.unionByName(runs.withColumn("published", F.lit(False)).withColumn("status", F.lit("pending")), allowMissingColumns=True)


def runs_published(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """runs after publishing: of those with an outcome (run_id, ok), published and status tell it. Others stay as they are."""
    told = outcomes.groupBy("run_id").agg(F.max("ok").alias("_ok"))
    joined = runs.join(told, "run_id", "left")
    return joined.withColumn("published", F.coalesce(F.col("published") | F.col("_ok"), F.col("published"))).withColumn("status", F.when(F.col("_ok"), "published").when(~F.col("_ok"), "failed").otherwise(F.col("status"))).drop("_ok")


def stays(lines: Column) -> Column:
    """Of each line of a hunk whether it isn't removed."""
    return F.transform(lines, lambda x: ~x.startswith("-"))


def number_at(staying: Column, new_start: Column, index: Column) -> Column:
    """The number in the new file of a hunk's line: its start and one for each line before it that stays."""
    before = F.slice(staying, 1, F.greatest(F.least(index, F.size(staying)), F.lit(0)))
    return (F.coalesce(new_start, F.lit(1)) + F.size(F.filter(before, lambda x: x))).cast("long")


def line_number(lines: Column, new_start: Column, index: Column) -> Column:
    """The number in the new file of a hunk's line: its start and one for each line before it that isn't removed."""
    return number_at(stays(lines), new_start, index)


def findings_stored(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """Findings (ord, run_id, file_path, hunk_id, line_in_hunk, line_number, severity, category, message, suggested_fix) as rows of the store.

    The line comes from the hunk (hunk_id, ord, new_start, lines; of equal ids
    the last), else as given, else 0.
    """
    # Of the lines' texts only that is moved to the findings which a number needs.
    own = hunks.groupBy("hunk_id").agg(F.max_by(F.struct("new_start", stays(F.col("lines")).alias("staying")), "place").alias("_h"))
    joined = findings.join(own, "hunk_id", "left")
    known = F.col("_h").isNotNull() & F.col("line_in_hunk").isNotNull()
    line = F.when(known, number_at(F.col("_h.staying"), F.col("_h.new_start"), F.col("line_in_hunk").cast("int"))).otherwise(F.coalesce("line_number", F.lit(0)).cast("long"))
    severity = severity_to_store(F.regexp_replace(F.coalesce("severity", F.lit("medium")), r"^\s+|\s+$", ""))
    return joined.select("ord", "run_id", F.coalesce("file_path", F.lit("")).alias("file_path"), line.alias("line_number"), F.coalesce("category", F.lit("general")).alias("finding_type"), severity.alias("severity"), F.coalesce("message", F.lit("")).alias("message"), F.col("suggested_fix").alias("suggestion"), "hunk_id")


def snapshots_added(snapshots: DataFrame, repositories: DataFrame, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """snapshots with one for each indexing run (repository_id, snapshot_id, commit_sha, at), and repositories with the time of their last one."""
    more = snapshots.unionByName(indexed.select("repository_id", "snapshot_id", "commit_sha", F.col("at").alias("created_at")))
    last = indexed.groupBy("repository_id").agg(F.max("at").alias("_at"))
    return more, repositories.join(last, "repository_id", "left").withColumn("last_indexed_at", F.coalesce("_at", "last_indexed_at")).drop("_at")


def installations(stored: DataFrame, created: DataFrame) -> DataFrame:
    """stored (installation_id, account, updated_at) after created: a known one is touched only, a new one inserted."""
    return upserted(stored, created, ["installation_id"], ["updated_at"])


def repositories_added(stored: DataFrame, events: DataFrame) -> DataFrame:
    """stored (repository_id, installation_id, full_name) after events with action: added ones are inserted or renamed, removed ones only noted elsewhere."""
    fresh = events.where("action = 'added'").select("repository_id", "installation_id", "full_name")
    return upserted(stored, fresh, ["repository_id"], ["installation_id", "full_name"])


def indexing_reason(forced: Column, head: Column, stored: Column, stored_sha: Column) -> Column:
    """Why a repository is indexed or not: forced, its head unknown, never indexed at a commit, the head unchanged or changed."""
    return F.when(forced, "forced").when(head.isNull(), "sha_resolution_failed").when(~stored | stored_sha.isNull(), "no_previous_snapshot").when(head == stored_sha, "sha_unchanged").otherwise("sha_changed")
