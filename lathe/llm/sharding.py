"""Sharding by balanced label propagation: linked documents move to one shard under quotas, counts stay even.

Documents are linked if their texts are equal. As the documents of a text in
one shard are interchangeable, the state is one row per text with its counts
by shard, however often a text occurs. The few texts of over a quarter of a
shard are placed first. Of the others, each asks in every round for the shard
that holds most of its documents, less so the fuller that shard is, and moves
as a whole if the shard's quota admits it; quotas count the seats that other
moves free. Rounds end when no text is split or none has been put together in
three rounds. At the end the counts are made exactly even: what exceeds a
shard's seats, texts that occur once first, goes to free seats as a whole, so
that of the texts that fit into a shard at most one per shard is cut there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_count, discard, running_total, saved


def _unit(*parts) -> F.Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / (1 << 30)


def _large(texts: list, counts: list[int]) -> list[list[int]]:
    """Documents of each text in each shard, for the few texts of over a quarter of a shard, largest first.

    A text larger than a shard takes whole shards first. What is left of it,
    and every other text, goes whole to the fullest shard with room for it,
    and is cut only where no shard has.
    """
    room, out = list(counts), []
    for total in texts:
        row, left = [0] * len(counts), total
        while left:
            whole = [k for k, r in enumerate(room) if r == counts[k] and 0 < r <= left]
            fits = [k for k, r in enumerate(room) if r >= left]
            k = whole[0] if whole else min(fits, key=lambda k: (room[k], k)) if fits else max(range(len(room)), key=lambda k: (room[k], -k))
            n = min(left, room[k])
            row[k], room[k], left = row[k] + n, room[k] - n, left - n
        out.append(row)
    return out


def _start(texts: DataFrame, shards: int) -> DataFrame:
    """Small linked texts before the first round: their documents dealt out evenly, from a shard that the hash gives."""
    first = F.pmod(F.xxhash64("hub"), F.lit(shards))
    dealt = [F.floor(F.col("total") / shards) + F.when(F.pmod(F.lit(k) - first, F.lit(shards)) < F.col("total") % shards, 1).otherwise(0) for k in range(shards)]
    return texts.select("hub", "total", F.array(*[n.cast("long") for n in dealt]).alias("held"))


def _wanting(state: DataFrame, shards: int, loads: list[int], seats: list[int], turn: int) -> DataFrame:
    """Adds want, the shard with most of the text's documents, less so the fuller it is; a hash decides between equals."""
    score = [F.struct((F.col("held")[k] / F.col("total") + 1 - loads[k] / max(1, seats[k]) + _unit("hub", F.lit(k), F.lit(turn)) / 4).alias("score"), F.lit(k).alias("want")) for k in range(shards)]
    return state.withColumn("want", F.array_max(F.array(*score))["want"])


def _quotas(flows: list[list[int]], loads: list[int], seats: list[int]) -> list[float]:
    """The largest share of the asked moves that each shard can admit, if the shards that documents leave admit theirs.

    flows[j][k] documents of shard k ask for shard j. Starts from all moves,
    so swaps between full shards go through, and lowers what doesn't fit.
    """
    n = range(len(loads))
    quota, asked = [1.0] * len(loads), [sum(flows[j][k] for k in n if k != j) for j in n]
    for _ in range(200):
        leaving = [sum(flows[j][k] * quota[j] for j in n if j != k) for k in n]
        quota = [min(quota[j], max(0.0, seats[j] - loads[j] + leaving[j]) / asked[j]) if asked[j] else 1.0 for j in n]
    return quota


def _propagate(texts: DataFrame, pinned: list[int], seats: list[int], rounds: int) -> DataFrame:
    """Cells (hub, total, shard, n) of the small linked texts, after rounds until no fewer texts are split.

    Every round moves whole texts, so a text that has moved once is together.
    What quotas still hold back at the end is gathered where it wants to be;
    seating carries it on whole.
    """
    shards, least, waited = len(seats), None, 0
    state, loads = saved(_start(texts, shards), "held"), None
    for turn in range(rounds):
        if loads is None:
            sums = state.agg(*[F.coalesce(F.sum(F.col("held")[k]), F.lit(0)) for k in range(shards)]).first()
            loads = [pinned[k] + sums[k] for k in range(shards)]
        asking = _wanting(state, shards, loads, seats, turn)
        split = F.sum((F.col("held")[F.col("want")] < F.col("total")).cast("long"))
        flows, open_ = [[0] * shards for _ in range(shards)], 0
        together = F.array_max("held") == F.col("total")
        for r in asking.where(~together).groupBy("want").agg(split.alias("split"), *[F.sum(F.col("held")[k]).alias(f"n{k}") for k in range(shards)]).collect():
            flows[r["want"]], open_ = [r[f"n{k}"] for k in range(shards)], open_ + r["split"]
        if not open_:
            break
        waited = 0 if least is None or open_ < least else waited + 1
        least = open_ if least is None else min(least, open_)
        last = waited == 3 or turn == rounds - 1
        quota = [1.0] * shards if last else _quotas(flows, loads, seats)
        admitted = ~together & (_unit("hub", F.lit(turn), F.lit("admit")) < F.array(*[F.lit(q) for q in quota])[F.col("want")])
        whole = F.array(*[F.when(F.col("want") == k, F.col("total")).otherwise(0) for k in range(shards)])
        before, state, loads = state, saved(asking.select("hub", "total", F.when(admitted, whole).otherwise(F.col("held")).alias("held")), "held"), None
        discard(before)
        if last:
            break
    return state.select("hub", "total", F.posexplode("held").alias("shard", "n")).where("n > 0")


def _seated(cells: DataFrame, counts: list[int], texts: int, large: int) -> DataFrame:
    """Pieces (hub, shard, n, slot): every cell's documents in consecutive slots of a shard, each shard exactly full."""
    spark, buckets = cells.sparkSession, bucket_count(texts)
    seats = spark.createDataFrame(list(enumerate(counts)), "shard int, seats long")
    # Large texts first, as they are placed to fit; texts that occur once last.
    kind = F.when(F.col("total") > large, 0).when(F.col("total") > 1, 1).otherwise(2)
    ordered = cells.withColumn("bucket", F.pmod(F.xxhash64("hub"), F.lit(buckets)) + kind * buckets)
    placed = running_total(ordered, ["shard"], "bucket", ["hub"], "n", "slot").join(F.broadcast(seats), "shard")
    placed = placed.withColumn("kept", F.when(F.col("slot") + F.col("n") <= F.col("seats"), F.col("n")).otherwise(0).cast("long"))
    placed = saved(placed.select("hub", "shard", "n", "bucket", "slot", "kept"), "placed")
    held = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.sum("kept").alias("n")).collect()}
    free, at = [], 0
    for k, n in enumerate(counts):
        room = n - held.get(k, 0)
        free.append((k, at, at + room, held.get(k, 0)))
        at += room
    room = spark.createDataFrame(free, "to int, low long, high long, used long")
    over = placed.where("n > kept").select("hub", "bucket", F.col("shard").alias("was"), (F.col("n") - F.col("kept")).alias("n"), F.lit(0).alias("all"))
    over = running_total(over, ["all"], "bucket", ["hub", "was"], "n", "begin")
    # Eight intervals of free seats at most: each row meets those that it overlaps.
    over = over.join(F.broadcast(room), (F.col("begin") < F.col("high")) & (F.col("begin") + F.col("n") > F.col("low")))
    low, high = F.greatest("begin", "low"), F.least(F.col("begin") + F.col("n"), F.col("high"))
    moved = over.select("hub", F.col("to").alias("shard"), (high - low).alias("n"), (F.col("used") + low - F.col("low")).alias("slot"))
    return placed.where("kept > 0").select("hub", "shard", F.col("kept").alias("n"), "slot").union(moved)


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 100) -> DataFrame:
    """Puts documents into shards so that counts differ by one at most and equal texts stay together where they fit.

    Returns one row per row of docs: doc_id, size (UTF-8 bytes plus 1),
    text_crc32, law ('rows'), shard, slot (gapless from 0 in each shard),
    grown_shard (null under this law), group_size (documents with that text)
    and group_shards (shards that hold them; more than one: the text is cut).
    A null text has size 1 and counts as equal to an empty one. Null and repeated doc_ids are
    placed like others. Which of several equal texts lies where depends on
    doc_id alone. rounds is a safety bound that is not reached in practice.
    Very long texts move as hashes only; other columns are ignored. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("hub"))
    rows = saved(rows, "sharded-rows")
    n = rows.count()
    # Parts of a text's documents: about 20,000 rows each at most, however many a text has.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(bucket_count(n))).cast("int")
    parts = saved(rows.groupBy("hub", part.alias("part")).agg(F.count(F.lit(1)).alias("n")), "parts")
    texts = saved(parts.groupBy("hub").agg(F.sum("n").alias("total")), "texts")
    n_texts = texts.count()
    counts = [n // shards + (k < n % shards) for k in range(shards)]
    # At most four texts a shard.
    large = counts[-1] // 4
    big = texts.where((F.col("total") > 1) & (F.col("total") > large)).orderBy(F.col("total").desc(), "hub").collect()
    laid = _large([r["total"] for r in big], counts)
    pinned = [(bytes(r["hub"]), r["total"], k, n) for r, row in zip(big, laid, strict=True) for k, n in enumerate(row) if n]
    pinned = spark.createDataFrame(pinned, "hub binary, total long, shard int, n long")
    moved = _propagate(texts.where((F.col("total") > 1) & (F.col("total") <= large)), [sum(row[k] for row in laid) for k in range(shards)], counts, rounds)
    single = texts.where("total = 1").select("hub", "total", F.pmod(F.xxhash64("hub"), F.lit(shards)).cast("int").alias("shard"), F.col("total").alias("n"))
    cells = saved(pinned.union(moved).union(single), "cells")
    pieces = _seated(cells, counts, n_texts, large)
    own = Window.partitionBy("hub")
    order = own.orderBy("shard", "slot").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("low", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("high", F.col("low") + F.col("n"))
    pieces = pieces.select("hub", "shard", "slot", "low", "high", F.size(F.collect_set("shard").over(own)).alias("group_shards"), F.sum("n").over(own).alias("group_size"))

    # Where each part's documents lie among their equals, and so in which pieces.
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).join(pieces, "hub").where((F.col("first") < F.col("high")) & (F.col("first") + F.col("n") > F.col("low")))
    begin = F.greatest("first", "low")
    placed = placed.select(F.col("hub").alias("_hub"), F.col("part").alias("_part"), "shard", (F.col("slot") + begin - F.col("low")).alias("slot"), (begin - F.col("first")).alias("low"), (F.least(F.col("first") + F.col("n"), F.col("high")) - F.col("first")).alias("high"), "group_size", "group_shards")
    at = F.row_number().over(Window.partitionBy("hub", "part").orderBy("doc_id")) - 1
    ranked = rows.withColumn("part", part).withColumn("at", at.cast("long"))
    out = ranked.join(placed, (F.col("hub") == F.col("_hub")) & (F.col("part") == F.col("_part")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot") + F.col("at") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_size", "group_shards")
