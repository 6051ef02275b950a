"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame functions only.

Two multisets of shingles that reach the threshold share so many that one of
an item's rarest shingles (its marks) is in the window, so a document's texts
are read once to find the items that it may hold, and only such texts again.
There, the windows of an item's size that hold enough of its shingles get a
SimHash, from prefix sums over the text, so a window costs no more than its
two ends. Fingerprints of windows and of their items within RADIUS bits of
each other agree in at least one of RADIUS + 1 blocks, so an equi-join on
(item, block, value) finds all of them. Candidates are verified exactly: the
overlap of the two shingle multisets over their union, each shingle weighing
as often as it occurs, must reach the threshold. Of a document's windows of an
item, those that may be most similar are verified first, the others only if
they may be better.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, discard, saved, unused

#: Bits of 64. Multisets with a similarity of 0.8 differ in about 10 bits with a deviation of 3.
RADIUS = 20
#: Rows of the benchmark that are broadcast (some 50 MB); a larger table is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def with_shingles(df: DataFrame, words: int) -> DataFrame:
    """Replaces text by sh: the hashes of its word shingles in order; one for the whole text if it has fewer words, none without words."""
    parts = F.split(ascii_lower(F.coalesce("text", F.lit(""))), SPACE)
    # Each step is a column of its own, so that no step runs again for each shingle.
    df = df.withColumn("_words", F.array_remove(parts, "")).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_n", F.size("_hashes"))
    each = F.transform(F.sequence(F.lit(1), F.col("_n") - words + 1), lambda i: F.xxhash64(*[F.element_at("_hashes", (i + k).cast("int")) for k in range(words)]))
    few = F.when(F.col("_n") == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64("_hashes")))
    return df.withColumn("sh", F.when(F.col("_n") >= words, each).otherwise(few)).drop("text", "_words", "_hashes", "_n")


def _lanes(h: Column) -> list[Column]:
    """Thirty-two longs with two bits of a hash each, one in each 32-bit lane, so that sums count bits."""
    return [F.shiftrightunsigned(h, 2 * k).bitwiseAND(1).bitwiseOR(F.shiftleft(F.shiftrightunsigned(h, 2 * k + 1).bitwiseAND(1), 32)) for k in range(32)]


def _print_of(lane, m: Column) -> Column:
    """The SimHash whose bit is set where more than half of m hashes have it; lane(k) are the sums of the lanes."""
    out = F.lit(0).cast("long")
    for k in range(32):
        for b in range(2):
            count = F.shiftrightunsigned(lane(k), 32 * b).bitwiseAND(0xFFFFFFFF)
            out = out.bitwiseOR(F.when(2 * count > m, F.shiftleft(F.lit(1).cast("long"), 2 * k + b)).otherwise(F.lit(0).cast("long")))
    return out


def fingerprints(rows: DataFrame, keys: list[str], shingle: str) -> DataFrame:
    """SimHash of each group of shingles: a bit is set if it is set in more than half of them. Groups have fewer than 2^31."""
    lanes = [c.alias(f"_l{k}") for k, c in enumerate(_lanes(F.col(shingle)))]
    sums = rows.select(*keys, *lanes).groupBy(*keys).agg(*[F.sum(f"_l{k}").alias(f"_l{k}") for k in range(32)], F.count(F.lit(1)).alias("_m"))
    return sums.select(*keys, _print_of(lambda k: F.col(f"_l{k}"), F.col("_m")).alias("fingerprint"))


def blocks(fingerprint: Column, radius: int) -> Column:
    """The radius + 1 blocks of a fingerprint as (block, value)."""
    n = radius + 1
    ends = [64 * k // n for k in range(n + 1)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, ends[k]).bitwiseAND((1 << (ends[k + 1] - ends[k])) - 1).alias("value")) for k in range(n)])


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two lists as multisets."""
    plain = F.size(F.array_intersect(a, b))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    distinct = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(distinct, plain).otherwise(counted)


def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, broadcast if it has few rows."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def _marks(bench: DataFrame, percent: int) -> DataFrame:
    """h, item: of every item the shingles that fewest items hold, so many that no window without any of them can reach the threshold."""
    own = bench.select("item", "w", F.explode("sh").alias("h")).groupBy("item", "w", "h").agg(F.count(F.lit(1)).alias("times"))
    spread = own.groupBy("h").agg(F.count(F.lit(1)).alias("items"))
    order = Window.partitionBy("item").orderBy("items", "h").rowsBetween(Window.unboundedPreceding, -1)
    own = own.join(spread, "h").withColumn("before", F.coalesce(F.sum("times").over(order), F.lit(0)))
    # With w - ceil(t w) + 1 of its shingles missing, less than t w remain.
    return own.where(F.col("before") <= F.col("w") - F.ceil(F.col("w") * percent / F.lit(100))).select("h", "item")


def text_key(text: Column) -> list[Column]:
    """Two hashes that stand for a text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("key"), F.xxhash64(F.lit("2"), text).alias("key2")]


def candidate_windows(held: DataFrame, pairs: DataFrame, bench: DataFrame, percent: int) -> DataFrame:
    """key, key2, item, w, m (size), start and most (shingles that window and item can have in common) of all windows that may reach the threshold."""
    keys, w = ["key", "key2", "item"], F.col("w")
    shingles = bench.select("item", "w", F.explode(F.array_distinct("sh")).alias("h"))
    at = held.select("key", "key2", F.size("sh").alias("n"), F.posexplode("sh").alias("p", "h")).withColumn("p", F.col("p") + 1)
    members = at.join(pairs, ["key", "key2"]).join(_small(shingles), ["item", "h"]).select(*keys, "w", "n", "p")
    members = members.withColumn("m", F.least("w", "n")).withColumn("least", F.ceil((F.col("m") + w) * percent / F.lit(100 + percent)))
    # Members within a window's length from each on: positions are divided by that length, so that the frame is the same for all items.
    ahead = F.expr("count(1) OVER (PARTITION BY key, key2, item ORDER BY cast(p AS DOUBLE) / w RANGE BETWEEN CURRENT ROW AND 0.999999999D FOLLOWING)")
    back = Window.partitionBy(*keys).orderBy("p")
    members = members.withColumn("held", ahead).withColumn("before", F.coalesce(F.lag("p").over(back), F.lit(0)))
    # Each window comes from its first member; what it has ahead of that isn't the item's.
    low = F.greatest(F.col("before") + 1, F.col("p") - (F.col("m") - F.col("least")), F.lit(1))
    high = F.least(F.col("p"), F.greatest(F.col("n") - w + 1, F.lit(1)))
    found = members.where("held >= least").withColumn("low", low.cast("int")).withColumn("high", high.cast("int")).where("low <= high")
    found = found.select(*keys, "w", "m", "p", "held", F.explode(F.sequence("low", "high")).alias("start"))
    return found.select(*keys, "w", "m", "start", F.least(F.col("held"), F.col("m") - (F.col("p") - F.col("start"))).cast("long").alias("most"))


def window_prints(held: DataFrame, windows: DataFrame) -> DataFrame:
    """windows with their fingerprint, from running sums of the lanes over each text."""
    at = held.select("key", "key2", F.posexplode("sh").alias("p", "h"))
    upto = Window.partitionBy("key", "key2").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    sums = at.select("key", "key2", (F.col("p") + 1).alias("p"), F.array(*[F.sum(c).over(upto) for c in _lanes(F.col("h"))]).alias("sums"))
    ends = windows.select("key", "key2", F.explode(F.array(F.col("start") - 1, F.col("start") + F.col("m") - 1)).alias("p")).distinct()
    sums = saved(sums.join(ends, ["key", "key2", "p"], "left_semi"), "sums")
    first = sums.select("key", "key2", (F.col("p") + 1).alias("start"), F.col("sums").alias("_first"))
    last = sums.select("key", "key2", F.col("p").alias("_end"), F.col("sums").alias("_last"))
    both = windows.withColumn("_end", F.col("start") + F.col("m") - 1).join(last, ["key", "key2", "_end"]).join(first, ["key", "key2", "start"], "left")
    lane = lambda k: F.col("_last")[k] - F.coalesce(F.col("_first")[k], F.lit(0).cast("long"))
    return both.select("key", "key2", "item", "w", "m", "start", "most", _print_of(lane, F.col("m")).alias("fingerprint"))


def leaks(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """Texts and the benchmark items that they hold: key, key2 (of text_key), item_id, similarity (of the best window).

    docs needs text, items item_id and text. Words are split at ASCII white
    space, with A-Z lower-cased. A document shorter than an item is one window.
    An item with fewer words than a shingle only matches documents of exactly
    these words. Null and empty texts and items match nothing; equal texts and
    repeated items are judged once, and rows that share an item_id count as
    one item. Empty tables give an empty result.
    """
    percent = math.ceil(round(threshold * 100, 6))
    bench = with_shingles(items.select("item_id", "text").distinct(), words).select(F.xxhash64("item_id", "sh").alias("item"), "item_id", "sh", F.size("sh").alias("w"))
    bench = saved(bench.where("w > 0"), "items")
    marks = saved(_marks(bench, percent), "marks")
    texts = docs.select(*text_key(F.col("text")), "text")

    # The row number stands above the shingles: the filter that goes with the generator stays above it too, and computes no shingle again. It is read, so it isn't pruned.
    shingled = with_shingles(texts, words).select("key", "key2", "sh", F.monotonically_increasing_id().alias("_row"))
    pairs = shingled.select("key", "key2", "_row", F.explode("sh").alias("h")).join(_small(marks), "h").groupBy("key", "key2", "item").agg(F.min("_row").alias("row"))
    pairs = saved(pairs, "pairs").select("key", "key2", "item")
    named = saved(pairs.select("key", "key2").distinct(), "held-keys")
    held = saved(with_shingles(texts.join(named, ["key", "key2"], "left_semi").dropDuplicates(["key", "key2"]), words), "held")

    windows = saved(candidate_windows(held, pairs, bench, percent), "windows")
    prints = saved(window_prints(held, windows), "prints")
    item_prints = fingerprints(bench.select("item", F.explode("sh").alias("h")), ["item"], "h")
    keys = ["key", "key2", "item", "w", "m", "start", "most"]
    left = prints.select(*keys, "fingerprint", F.explode(blocks(F.col("fingerprint"), radius)).alias("at")).select(*keys, "fingerprint", "at.block", "at.value")
    right = item_prints.select("item", F.col("fingerprint").alias("item_fingerprint"), F.explode(blocks(F.col("fingerprint"), radius)).alias("at")).select("item", "item_fingerprint", "at.block", "at.value")
    close = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= radius
    candidates = saved(left.join(right, ["item", "block", "value"]).where(close).select(*keys).distinct(), "candidates")

    def verified(chosen: DataFrame) -> DataFrame:
        """chosen with both, the exact overlap of window and item."""
        starts = chosen.groupBy("key", "key2", "item").agg(F.collect_list(F.struct("start", "m")).alias("at"))
        cut = starts.join(held, ["key", "key2"]).select("key", "key2", "item", F.explode(F.transform("at", lambda s: F.struct(s["start"].alias("start"), s["m"].alias("m"), F.slice("sh", s["start"], s["m"]).alias("part")))).alias("at"))
        both = cut.select("key", "key2", "item", "at.*").join(bench.select("item", "item_id", "w", "sh"), "item")
        both = both.withColumn("both", overlap(F.col("part"), F.col("sh"))).withColumn("all", F.col("m") + F.col("w") - F.col("both"))
        return both.select("key", "key2", "item", "item_id", "both", "all", (F.col("both") / F.col("all")).alias("similarity"))

    own = Window.partitionBy("key", "key2", "item")
    ranked = candidates.withColumn("rank", F.row_number().over(own.orderBy(F.col("most").desc(), "start")))
    best = saved(verified(ranked.where("rank = 1")), "best")
    # Another window can only be better if it can have more in common.
    later = ranked.where("rank > 1").join(best.select("key", "key2", "item", F.col("both").alias("found")), ["key", "key2", "item"]).where("most > found").drop("found")
    found = saved(best.unionByName(verified(later)).where(F.col("both") * 100 >= F.col("all") * percent).groupBy("key", "key2", "item_id").agg(F.max("similarity").alias("similarity")), "leaks")
    for done in (bench, marks, pairs, named, held, windows, prints, candidates, best):
        discard(done)
    return found


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, contaminated, n_items, item_ids (ascending, joined by commas), similarity (of the best window, 6 digits; null without one).

    Rows that share a doc_id are judged together. Every window of a text of any
    length is judged; further columns of either table are ignored. A window that
    reaches the threshold is lost only if its fingerprint lies over the radius
    from the item's, which by simulation befalls one in some 4,000 windows right
    at 0.8, of 9 and 30 shingles, and none at most other sizes. See leaks() for odd rows.
    """
    found = leaks(docs, items, **options)
    rows = docs.select("doc_id", *text_key(F.col("text")))
    held = rows.join(found, ["key", "key2"]).select("doc_id", "item_id", "similarity")
    per = held.groupBy("doc_id").agg(F.count_distinct("item_id").alias("n_items"), F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("item_ids"), F.round(F.max("similarity"), 6).alias("similarity"))
    per = saved(per.select(F.col("doc_id").alias("_id"), "n_items", "item_ids", "similarity"), "contaminated")
    out = docs.select("doc_id").join(per, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"), "similarity")


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their columns as they are, whatever these are called. Rows that share a doc_id are judged together, those without one by their texts."""
    found = leaks(docs, items, **options).select("key", "key2").distinct()
    rows = docs.select("doc_id", *text_key(F.col("text")))
    # Saved, so its size is known before the join is planned: few ids are broadcast, and texts stay where they are.
    name, key, key2 = unused(docs, "_leaking"), unused(docs, "_key"), unused(docs, "_key2")
    ids = saved(rows.join(found, ["key", "key2"], "left_semi").where("doc_id is not null").select(F.col("doc_id").alias(name)).distinct(), "leaking")
    unnamed = found.select(F.col("key").alias(key), F.col("key2").alias(key2))
    kept = docs.join(ids, F.col("doc_id") == F.col(name), "left_anti")
    first, second = text_key(F.col("text"))
    return kept.join(unnamed, F.col("doc_id").isNull() & (first == F.col(key)) & (second == F.col(key2)), "left_anti")
