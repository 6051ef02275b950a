"""Similarity of names with many others: an index decides by lengths and characters which pairs are worth the exact ratio."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of an index. Bins of characters; those that share one only make the bound wider.
INDEX, BINS = 2000, 64
#: Cells of the table of bounds that are worked out at once.
CELLS = 1 << 20


def counts(names: list[str]) -> np.ndarray:
    """How often the characters of each bin occur in each name."""
    out = np.zeros((len(names), BINS), np.int32)
    size = np.fromiter(map(len, names), np.int64, len(names))
    points = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
    np.add.at(out, (np.repeat(np.arange(len(names)), size), points % BINS), 1)
    return out


def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For all pairs the largest ratio that they can have: twice the characters in common, in any order, of both lengths."""
    common = np.zeros((len(a), len(b)), np.int32)
    for k in np.flatnonzero((a.any(axis=0)) & (b.any(axis=0))):
        common += np.minimum(a[:, k][:, None], b[:, k][None, :])
    total = a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :]
    return np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)


def best_ratios(names: list[str], others: list[str]) -> tuple[list[float], list[int]]:
    """Of each name the largest ratio with any of the others, and how many of these were compared.

    Others come in order of their bounds and end where no bound is above the
    best ratio so far, so a name is compared with few. Of an equal name the
    ratio is 1 without comparing.
    """
    best, compared, known = [], [], set(others)
    theirs = counts(others)
    step = max(1, CELLS // max(1, len(others)))
    for i in range(0, len(names), step):
        part = names[i : i + step]
        table = bounds(counts(part), theirs)
        for name, row in zip(part, table, strict=True):
            most, done = 0.0, 0
            if name in known:
                best.append(1.0)
                compared.append(0)
                continue
            # The few with the largest bounds nearly always decide; all others are only sorted if they don't.
            order = np.argpartition(-row, 8)[:8] if len(row) > 8 else np.arange(len(row))
            order = order[np.argsort(-row[order], kind="stable")]
            for part_of in (order, None):
                if part_of is None:
                    rest = np.flatnonzero(row > most)
                    part_of = rest[~np.isin(rest, order)]
                    part_of = part_of[np.argsort(-row[part_of], kind="stable")]
                for k in part_of:
                    if row[k] <= most:
                        break
                    most = max(most, difflib.SequenceMatcher(None, name, others[k]).ratio())
                    done += 1
            best.append(most)
            compared.append(done)
    return best, compared


BEST = "_name string, similarity double, compared long"


def _looked_up(names: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    best, compared = best_ratios(names["_name"].tolist(), others["_seed"].tolist())
    return pd.DataFrame({"_name": names["_name"].tolist(), "similarity": best, "compared": compared})


def name_similarities(symbols: DataFrame, seeds: DataFrame) -> DataFrame:
    """_name, similarity, compared: of every different name (not null or empty) the largest ratio with a name of seeds, and how many of these were compared exactly.

    Names are dealt out to as many tasks as the session shuffles to, and seeds
    to indexes; a part of the names meets each index once. The order of a
    ratio's names counts, as in the sequence matcher: the symbol's comes first.
    """
    names = symbols.select(F.col("name").alias("_name")).where("name != ''").distinct()
    others = seeds.select(F.col("name").alias("_seed")).where("name != ''").distinct()
    indexes, parts = max(1, -(-others.count() // INDEX)), int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # With a fixed number of partitions, as the few bytes of names would be put into one task otherwise.
    left = names.withColumn("part", deal("_name", parts)).withColumn("index", every(indexes)).repartition(parts, "part", "index")
    right = others.withColumn("index", deal("_seed", indexes)).withColumn("part", every(parts)).repartition(parts, "part", "index")
    found = left.groupBy("part", "index").cogroup(right.groupBy("part", "index")).applyInPandas(lambda a, b: _looked_up(a, b) if len(a) and len(b) else pd.DataFrame({"_name": [], "similarity": [], "compared": []}).astype({"_name": str}), BEST)
    return found.groupBy("_name").agg(F.max("similarity").alias("similarity"), F.sum("compared").alias("compared"))


def best_name_similarity(symbols: DataFrame, seeds: DataFrame) -> DataFrame:
    """symbols with similarity: the largest of the name with any name of seeds; 0 without a name or seeds."""
    best = name_similarities(symbols, seeds).drop("compared")
    return symbols.join(best, F.col("name") == F.col("_name"), "left").drop("_name").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))

