"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source is a queue of its documents in a shuffled order that a seed
fixes, up to REPEAT times over. A document is served in packets of at most a
thousandth of its source's target. A packet's virtual finish time is its
source's cumulative words divided by the source's target. All packets of all
sources are sorted by that time, and the mix is cut off where its words reach
the total budget; so no source is more than a packet away from its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bucket_count, discard, running_total, saved, unused

#: The weights of the sources in order of name, repeating.
WEIGHTS = (3, 1, 2)
#: Packets in which a source reaches its target, at least.
PACKETS = 1000


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeat: int = 2) -> DataFrame:
    """Targets per source: weighted shares of the budget, none above repeat times the source's size.

    A source is held at its limit if the level at which it reaches that limit
    can be paid for out of the budget; the others share what is left by
    weight. This is where repeated resharing ends. Sources are ordered by code
    point, null last. Works on one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"))
    upto, over = by_level.rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    per = per.withColumn("budget", F.sum("source_size").over(over) * F.lit(share))
    per = per.withColumn("below", F.sum("source_size").over(upto)).withColumn("above", F.sum("weight").over(over) - F.sum("weight").over(upto))
    cost = F.col("below") * repeat + F.col("source_size") * repeat / F.col("weight") * F.col("above")
    per = per.withColumn("full", cost <= F.col("budget"))
    left = F.col("budget") - repeat * F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(over), F.lit(0))
    free = F.sum(F.when(~F.col("full"), F.col("weight"))).over(over)
    per = per.withColumn("left", left).withColumn("free", free)
    target = F.when(F.col("full"), (F.col("source_size") * repeat).cast("double")).otherwise(F.col("left") * F.col("weight") / F.col("free"))
    return per.select("source", "source_size", F.least(target, (F.col("source_size") * repeat).cast("double")).alias("target"))


def _turn(seed: str) -> Column:
    """The shuffled order of documents. Those without a doc_id are placed by their text."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.xxhash64("text").cast("string")))))


def _served(docs: DataFrame, weights: tuple[int, ...], share: float, repeat: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """All rows, with their source's size and target and the words before them in its queue; and what the mix takes of each of their passes.

    The passes have source, turn, size, before, pass, taken, finish (of the
    first packet that is taken whole or in part) and mix_start.
    """
    turn = _turn(seed)
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), turn.alias("turn"))
    sized = saved(sized, "sized")
    buckets = bucket_count(sized.count())
    # The first hex digits place a document in a bucket, so that buckets follow the shuffled order.
    queued = sized.withColumn("bucket", F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int"))
    queued = running_total(queued, ["source"], "bucket", ["turn", "size"], "size", "before")
    targets = saved(source_targets(sized, weights, share, repeat), "targets")
    budget = targets.agg(F.floor(F.coalesce(F.sum("target"), F.lit(0.0)) + 1e-6).cast("long")).first()[0]
    right = targets.select(F.col("source").alias("_source"), "source_size", "target")
    queue = saved(queued.join(right, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source", "turn", "size", "before", "source_size", "target"), "queue")
    discard(sized)

    most = F.greatest(F.floor(F.col("target") / PACKETS), F.lit(1)).cast("long")
    passes = queue.where("size > 0 AND target > 0").select("source", "turn", "size", "before", "target", "source_size", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))).alias("pass"))
    passes = passes.withColumn("begin", F.col("before") + F.col("source_size") * F.col("pass"))
    # By time 1.002 every source has had its target in whole packets, so what begins later is behind the cut.
    passes = passes.where(F.col("begin") <= F.col("target") * 1.002 + 1).withColumn("most", most)
    packets = passes.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.col("most")).cast("long"))))
    packets = packets.withColumn("words", F.least(F.col("most"), F.col("size") - F.col("k") * F.col("most"))).withColumn("time", (F.col("begin") + F.col("k") * F.col("most") + F.col("words")) / F.col("target"))
    parts = bucket_count(packets.count())
    packets = packets.withColumn("part", F.least(F.floor(F.col("time") * parts), F.lit(2 * parts)).cast("int")).withColumn("all", F.lit(0))
    packets = running_total(packets.select("source", "turn", "size", "before", "pass", "words", "time", "part", "all", "k"), ["all"], "part", ["time", "source", "turn", "size", "before", "k"], "words", "mix_start")
    packets = packets.withColumn("taken", F.least(F.col("words"), budget - F.col("mix_start"))).where("taken > 0")
    found = packets.groupBy("source", "turn", "size", "before", "pass").agg(F.sum("taken").alias("taken"), F.max("time").alias("finish"), F.min("mix_start").alias("mix_start"))
    return queue, saved(found, "served")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeat: int = 2, seed: str = "mix-1") -> DataFrame:
    """What a mix takes of every document.

    Returns one row per row of docs: doc_id, size (words), source_size,
    target (of its source), taken (words, repeats counted; a document at the
    end of the mix is taken in part), finish (virtual finish time of what its
    first pass gives; null if nothing is taken) and mix_start (the words of the
    mix before that, in order of finish time, source and document; null if
    nothing is taken). A null text has size 0 and nothing taken. A null
    source is a source of its own and the last. Rows with equal doc_id and
    source are served in order of size, rows without a doc_id in an order that
    their texts give. Empty tables give empty results; if all sizes are 0, all
    targets are 0. The order depends on seed, doc_id, text and size alone.
    Other columns are ignored; very long texts are many packets.
    """
    queue, served = _served(docs, weights, share, repeat, seed)
    keys = ["source", "turn", "size", "before"]
    per = served.groupBy(*keys).agg(F.sum("taken").alias("taken"), F.min(F.when(F.col("pass") == 0, F.col("finish"))).alias("finish"), F.min(F.when(F.col("pass") == 0, F.col("mix_start"))).alias("mix_start"))
    per = per.select(*[F.col(k).alias(f"_{k}") for k in keys], "taken", "finish", "mix_start")
    match = [F.col("turn") == F.col("_turn"), F.col("before") == F.col("_before"), F.col("size") == F.col("_size"), F.col("source").eqNullSafe(F.col("_source"))]
    out = queue.join(per, match, "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "finish", "mix_start")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeat: int = 2, seed: str = "mix-1") -> DataFrame:
    """The rows of docs as the mix takes them, each once for every pass that it has a part in; columns stay as they are, whatever these are called.

    The mix takes of every pass over a source its documents up to a place in
    their shuffled order, so one such place per source and pass, from the
    served packets, decides, and texts don't move. A document that a pass
    takes in part comes as a whole. Documents without words don't come.
    """
    queue, served = _served(docs, weights, share, repeat, seed)
    source, turn, copy = (unused(docs, n) for n in ("_source", "_turn", "_copy"))
    ends = [unused(docs, f"_end{k}") for k in range(repeat)]
    places = served.groupBy(F.col("source").alias(source)).agg(*[F.max(F.when(F.col("pass") == k, F.col("turn"))).alias(ends[k]) for k in range(repeat)])
    places = saved(places, "ends")  # so its size is known before the join is planned
    for done in (queue, served):
        discard(done)
    rows = docs.where(F.col("text").rlike(WORD)).withColumn(turn, _turn(seed)).join(places, F.col("source").cast("string").eqNullSafe(F.col(source)))
    times = [F.when(F.col(turn) <= F.col(end), 1).otherwise(0) for end in ends]
    rows = rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), sum(times[1:], times[0]))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
