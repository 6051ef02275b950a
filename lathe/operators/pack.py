"""Context packs: enrichment, fallbacks, budgets, caps and the figures of a pack's items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import first_rows

#: Bounds of the score classes, the score of rows with an error, and what a fallback scores by kind.
HIGH, MEDIUM, LOW, ERROR_SCORE = 0.7, 0.4, 0.1, 0.01
FALLBACK = {"function": 0.3, "method": 0.3, "class": 0.2}
#: Limits of a pack, of an item, and of a prompt's last cut item.
ITEMS, CHARACTERS, ITEM_CHARACTERS, LAST_CUT = 35, 120_000, 2000, 500


def share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """part of whole; 0 where there is nothing."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)) * scale, F.lit(0.0))


def enriched(candidates: DataFrame, seeds: DataFrame, default: int = 5) -> DataFrame:
    """candidates with whether their symbol is a seed's, by name, and that seed's priority; of several the first."""
    own = seeds.groupBy(F.col("name").alias("_name")).agg(F.min("priority").alias("_priority"))
    rows = candidates.join(own, F.col("symbol_name") == F.col("_name"), "left")
    return rows.withColumn("is_seed_symbol", F.col("_name").isNotNull()).withColumn("seed_priority", F.coalesce("_priority", F.lit(default))).drop("_name", "_priority")


def in_order(candidates: DataFrame, pack: str, n: int, rank: str = "r") -> DataFrame:
    """The first n of a pack by priority, then the strongest, then by id."""
    return first_rows(candidates, [pack], [F.col("priority"), F.col("strength").desc(), F.col("item_id")], n, rank)


def deduplicated(items: DataFrame, order: list[str]) -> DataFrame:
    """Of items with one id, or without an id of one file and symbol, the first in order."""
    key = F.coalesce(F.nullif("item_id", F.lit("")), F.concat_ws(":", "file_path", "symbol_name"))
    return first_rows(items.withColumn("_key", key), ["_key"], [F.col(o) for o in order], 1, "_n").drop("_key", "_n")


def relevant(items: DataFrame, score: str, failed: Column, threshold: float = LOW) -> DataFrame:
    """Items at the threshold or above; those with an error stay, at the lowest score."""
    return items.withColumn(score, F.when(failed, ERROR_SCORE).otherwise(F.col(score))).where(failed | (F.col(score) >= threshold))


def score_classes(items: DataFrame, score: str) -> DataFrame:
    """One row: items, how many score high, medium, low and minimal, and their mean, least and most."""
    s = F.col(score)
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    return items.agg(F.count(F.lit(1)).alias("n"), count(s > HIGH).alias("high"), count((s >= MEDIUM) & (s <= HIGH)).alias("medium"), count((s >= LOW) & (s < MEDIUM)).alias("low"), count(s < LOW).alias("minimal"), F.round(F.avg(s), 6).alias("mean"), F.min(s).alias("least"), F.max(s).alias("most"))


def place_score(items: DataFrame, pack: str) -> DataFrame:
    """Scores by place: 1 for a pack's first, a tenth less for each later one, 0.1 at least."""
    place = F.row_number().over(Window.partitionBy(pack).orderBy("priority", "item_id")) - 1
    return items.withColumn("score", F.round(F.greatest(F.lit(0.1), 1 - 0.1 * place), 6))


def simple_score(seed: Column, same_file: Column, kind: Column, depth: int = 2) -> Column:
    """Score without features: seeds, the seed's file, then by kind; a little more near the root."""
    by_kind = F.lit(0.1)
    for k, v in FALLBACK.items():
        by_kind = F.when(kind == k, v).otherwise(by_kind)
    return F.least(F.lit(1.0), F.when(seed, 0.8).when(same_file, 0.6).otherwise(by_kind) + max(0.0, 0.2 - 0.05 * depth))


def snippet_or_fallback(found: Column, seed: Column, name: Column) -> Column:
    """What was extracted, else the seed's own text, else the name as a comment."""
    return F.coalesce(found, seed, F.concat(F.lit("# "), name))


def mock_snippet(path: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("# mock content of "), path, F.lit(" lines "), start.cast("string"), F.lit("-"), end.cast("string"))


def cut_to_budget(items: DataFrame, pack: str, order: list[Column], size: str, limit: int, least: int = LAST_CUT) -> DataFrame:
    """Items of a pack in order up to the limit, with kept, what is kept of each: the one that exceeds it is cut if more than least is left, and ends the pack."""
    running = F.sum(size).over(Window.partitionBy(pack).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = items.withColumn("_upto", running).withColumn("_left", limit - (F.col("_upto") - F.col(size)))
    rows = rows.where((F.col("_upto") <= limit) | (F.col("_left") > least))
    return rows.withColumn("kept", F.when(F.col("_upto") <= limit, F.col(size)).otherwise(F.col("_left")).cast("long")).drop("_upto", "_left")


def estimate(items: DataFrame, pack: str, size: str) -> DataFrame:
    """Items and characters of each pack, before and after items are truncated, and whether the limits are exceeded."""
    kept = F.sum(F.least(F.col(size), F.lit(ITEM_CHARACTERS)))
    per = items.groupBy(pack).agg(F.count(F.lit(1)).alias("items"), F.sum(size).cast("long").alias("chars"), kept.cast("long").alias("after_truncation"))
    return per.withColumn("exceeded", (F.col("items") > ITEMS) | (F.col("after_truncation") > CHARACTERS))


def fallback_selection(items: DataFrame, pack: str, most: int, reserve: int) -> DataFrame:
    """Without a ranking: of a pack's first 2 * most items, seeds and those of the first priority, and up to reserve others."""
    sure = F.col("is_seed") | (F.col("priority") == 1)
    # All ranks come from one order, so that a pack is sorted once.
    order = Window.partitionBy(pack).orderBy("priority", "item_id")
    upto = lambda x: F.count(F.when(x, 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    others = F.when(F.col("_sure").isNull(), upto(F.col("_sure").isNull())).otherwise(upto(~F.col("_sure")))
    rows = items.withColumn("_sure", sure).withColumn("_scan", F.row_number().over(order)).withColumn("_r", others)
    rows = rows.where((F.col("_scan") <= 2 * most) & (F.col("_sure") | (F.col("_r") <= reserve)))
    return rows.withColumn("score", F.when(F.col("is_seed"), 0.8).when(F.col("priority") == 1, 0.6).otherwise(0.3)).drop("_sure", "_scan", "_r")


def least_context(items: DataFrame, pack: str, chosen: Column) -> DataFrame:
    """For packs of which nothing was chosen the one item that they get all the same: a seed if there is one, the first by id."""
    any_ = F.max(chosen.cast("int")).over(Window.partitionBy(pack))
    return first_rows(items.withColumn("_any", any_).where("_any = 0"), [pack], [F.col("is_seed").desc(), F.col("item_id")], 1, "_n").drop("_any", "_n")


def capped(items: DataFrame, pack: str, value: str, most: int) -> DataFrame:
    """Distinct values of each pack as an ordered array of at most so many, none of which is gathered beyond that."""
    rows = first_rows(items.select(pack, value).distinct(), [pack], [F.col(value)], most, "_n")
    return rows.groupBy(pack).agg(F.array_sort(F.collect_list(value)).alias("values"))


def totals(items: DataFrame, pack: str, kind: str, size: str) -> DataFrame:
    return items.groupBy(pack, kind).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("chars"))


def rates(items: DataFrame, pack: str, size: str) -> DataFrame:
    """Percentages of a pack's items that are too long and that are seeds."""
    n = F.count(F.lit(1))
    percent = lambda x: F.round(share(F.sum(x.cast("long")), n, 100), 4)
    return items.groupBy(pack).agg(percent(F.col(size) > ITEM_CHARACTERS).alias("truncation_rate"), percent(F.col("is_seed")).alias("seed_rate"))


def quality(items: DataFrame, seeds: DataFrame, size: str) -> DataFrame:
    """One row: shares of different items, of items that are truncated, and of files against the seeds' files."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    files = seeds.agg(F.greatest(F.count_distinct("path"), F.lit(1)).alias("_files"))
    one = items.agg((F.count_distinct("item_id") / n).alias("dedup_ratio"), (F.sum((F.col(size) > ITEM_CHARACTERS).cast("long")) / n).alias("truncation"), F.count_distinct("file_path").alias("_own"))
    return one.crossJoin(F.broadcast(files)).select(F.round("dedup_ratio", 6).alias("dedup_ratio"), F.round("truncation", 6).alias("truncation"), F.round(F.col("_own") / F.col("_files"), 6).alias("coverage"))


def sections(items: DataFrame, pack: str, most: int = ITEMS) -> DataFrame:
    """The prompt's heading for each of a pack's first items, joined; a pack gives no more than most."""
    rows = first_rows(items, [pack], [F.col("item_id")], most, "_n").withColumn("_head", F.concat(F.lit("### "), "symbol_name", F.lit(" ("), "file_path", F.lit(")")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "_head"))), lambda x: x["_head"]), "; ")
    return rows.groupBy(pack).agg(joined.alias("section"))


def summary(items: DataFrame, pack: str, most: int = 10) -> DataFrame:
    """A line about each pack: how many files it touches, and the first of them."""
    per = items.groupBy(pack).agg(F.count_distinct("file_path").alias("_files"))
    names = capped(items, pack, "file_path", most)
    return per.join(names, pack).select(pack, F.concat(F.lit("Touches "), F.col("_files").cast("string"), F.lit(" files: "), F.array_join("values", ", ")).alias("summary"))


#: The columns of an item in its older form.
LEGACY = ("src", "item_id", "file_path", "symbol_name", "code_snippet", "priority", "strength", "is_seed")


def legacy(items: DataFrame) -> DataFrame:
    """Items in their older form: without kind and lines, a missing text as an empty one, from the graph."""
    return items.select(*LEGACY).withColumn("code_snippet", F.coalesce("code_snippet", F.lit(""))).withColumn("source", F.lit("kg"))


def source_of(seed: Column, priority: Column) -> Column:
    return F.when(seed, "seed").when(priority <= 2, "kg_caller").otherwise("kg_callee")


def title_of(kind: Column, name: Column) -> Column:
    """Kind and name of an item, the kind with a capital; unknown without a name."""
    return F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 1000), F.lit(": "), F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown")))
