"""Ranking, budgets and findings: filter, dedup, sort, limit and number; greedy selection as a fold per pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import SEVERITY_RANK, chosen


def severity_rank(severity: Column) -> Column:
    return chosen(severity, SEVERITY_RANK, F.lit(2))


def confident(findings: DataFrame, least: float = 0.5) -> DataFrame:
    return findings.where(F.coalesce("confidence", F.lit(0.0)) >= least)


def dedup_key(file: Column, title: Column) -> Column:
    return F.concat(file, F.lit("::"), F.substring(F.lower(F.regexp_replace(title, r"^\s+|\s+$", "")), 1, 50))


def dedup_findings(findings: DataFrame) -> DataFrame:
    """Of findings with one key the most confident (then the first), in the place of the first: ord becomes position."""
    key = F.col("key")
    keyed = findings.withColumn("key", dedup_key(F.col("file_path"), F.col("title")))
    by_key = Window.partitionBy(key)
    keyed = keyed.withColumn("position", F.min("ord").over(by_key)).withColumn("_r", F.row_number().over(by_key.orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "ord")))
    return keyed.where("_r = 1").drop("_r", "key")


def ordered_findings(findings: DataFrame, limit: int) -> DataFrame:
    """The first findings, anchored ones before others, each by severity, confidence and place; with finding_id from 1 on.

    A sort with a limit runs as a top-k, so numbering sees limit rows only.
    """
    order = [F.col("anchored").desc(), severity_rank(F.col("severity")), F.coalesce("confidence", F.lit(0.0)).desc(), F.col("position")]
    top = findings.orderBy(*order).limit(limit)
    n = F.row_number().over(Window.orderBy(*order)).cast("long")
    return top.withColumn("number", n).withColumn("finding_id", F.concat(F.lit("finding_"), n.cast("string")))


def greedy_budget(items: DataFrame, pack: str, order: list[str], size: str, max_items: int, max_size: int) -> DataFrame:
    """Items of each pack in order, taken while they fit; one that doesn't is passed over and uses nothing up.

    order holds columns that sort ascending. A fold over those of a pack's
    sizes that can matter: of each size the first max_items. What is larger
    than the budget never fits; and if an item fits, so did all before it that
    are no larger, as less was used up then, so of one size no more than
    max_items are taken, the first ones. So a pack of any length comes to the
    fold as a number of items that the budget bounds, and most are left out
    before the shuffle. Texts stay out of it.
    """
    fits = F.when(F.col(size) <= max_size, F.col(size).cast("long"))
    rows = items.select(pack, *[F.col(o).alias(f"_order{k}") for k, o in enumerate(order)], fits.alias("_size"), "item_id")
    keys = [f"_order{k}" for k in range(len(order))]
    first = F.row_number().over(Window.partitionBy(pack, "_size").orderBy(*keys, "item_id"))
    rows = rows.withColumn("_n", first).where(F.col("_n") <= max_items)
    packs = rows.groupBy(pack).agg(F.array_sort(F.collect_list(F.when(F.col("_size").isNotNull(), F.struct(*keys, "_size", "item_id")))).alias("_items"))
    state = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("taken"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["n"] < max_items) & (s["used"] + x["_size"] <= max_size)
        return F.when(fits, F.struct((s["used"] + x["_size"]).alias("used"), (s["n"] + 1).alias("n"), F.concat(s["taken"], F.array(x["item_id"])).alias("taken"))).otherwise(s)

    folded = packs.select(pack, F.aggregate("_items", state, step).alias("s"))
    return folded.select(pack, F.col("s.n").alias("n_items"), F.col("s.used").alias("used"), F.array_join("s.taken", ",").alias("item_ids"))


def prefix_budget(items: DataFrame, pack: str, order: list[str], size: str, limit: int) -> DataFrame:
    """Items of each pack in order up to the first that exceeds the limit."""
    w = Window.partitionBy(pack).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("running", F.sum(size).over(w).cast("long")).where(F.col("running") <= limit)


#: How hard symbols are by kind.
KIND_COMPLEXITY = {"function": "medium", "method": "medium", "class": "high", "variable": "low", "constant": "low"}


def analysed(seeds: DataFrame) -> DataFrame:
    """seeds (kind, changed: whether their file is) with priority (1 is the highest), complexity, and what context they need."""
    kind, called = F.col("kind"), F.col("kind").isin("function", "method")
    priority = F.when(F.col("changed"), 1).when(kind.isin("function", "method", "class"), 2).otherwise(3)
    rows = seeds.withColumn("priority", priority).withColumn("complexity", chosen(kind, KIND_COMPLEXITY, F.lit("medium")))
    return rows.withColumn("needs_callers", called).withColumn("needs_callees", called).withColumn("needs_inheritance", kind == "class").withColumn("max_hops", F.when(kind == "class", 2).otherwise(1))


def search_strategy(analysed_seeds: DataFrame) -> DataFrame:
    """One row: whether urgent seeds go first, expansions per seed, and whether tests are included, by the number of seeds."""
    total, urgent = F.count(F.lit(1)), F.coalesce(F.sum((F.col("priority") <= 2).cast("long")), F.lit(0))
    return analysed_seeds.agg((urgent > 0).alias("urgent_first"), F.when(total < 10, 8).otherwise(5).alias("max_expansion"), (total < 20).alias("include_tests"))


def file_reasons(files: DataFrame, lines: DataFrame, hits: DataFrame) -> DataFrame:
    """files (path, change_type, binary) with why they give no seed symbols, or seeded: deleted or binary, without changed lines, or none of these in a symbol."""
    changed = lines.select("path").distinct().withColumn("_changed", F.lit(True))
    hit = hits.select("path").distinct().withColumn("_hit", F.lit(True))
    rows = files.join(changed, "path", "left").join(hit, "path", "left")
    reason = F.when(F.col("change_type") == "removed", "file_deleted").when(F.col("binary"), "binary_file").when(F.col("_changed").isNull(), "patch_missing").when(F.col("_hit").isNull(), "no_symbol_match").otherwise("seeded")
    return rows.withColumn("reason", reason).drop("_changed", "_hit")
