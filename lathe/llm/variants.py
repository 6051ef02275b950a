"""Spelling variants: the pairs of a vocabulary that lie one edit apart, by a trie self-join with active-node sets.

The vocabulary's trie is partitioned: words of a partition share a prefix and,
in mirrored partitions, a suffix too, so that a partition's trie holds only
what lies between. Two words one edit apart agree in all points but one, hence
in the first half of the points between or in the last half. Each word
therefore goes into two partitions, and a pair meets in exactly one of them:
in the second only if it differs within the first half. Partitions that are
still too large are cut in the same way until only one point is left between,
of which there are as many words as letters. So no partition is unbounded,
however many words share a prefix.

In a partition the trie is walked level by level. Of each node the active nodes
are kept: those whose paths are at most one edit away. At distance 0 that is the
node itself; an edit begins there (another child, or a child against the node)
and from then on only equal children stay active. Two words that end at active
nodes are a pair. All partitions of a block are walked at once, as a forest.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pieces, saved, shuffle_width

#: Fixed value: the letters of a word, after A-Z have been lower-cased.
RUN, GAP = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
#: A run whose hash this divides loses a point.
DROPS = 97
#: Points of a text that are cut into runs at once; distinct words that a task counts before it hands them on.
POINTS_AT_ONCE, WORDS_AT_ONCE = 1 << 20, 300_000
#: Words of a partition beyond which it is cut further; rows of a block that are walked at once.
PARTITION, BLOCK = 20_000, 100_000


def runs(text: bytes | None) -> Iterator[list[str]]:
    """The maximal runs of letters of a text with A-Z lower-cased, in portions."""
    s = (text or b"").lower().decode("utf-8", "replace")
    at = 0
    while at < len(s):
        end = GAP.search(s, at + POINTS_AT_ONCE)
        end = end.start() if end else len(s)
        yield RUN.findall(s, at, end)
        at = end


def _count(drops: int):
    """Words and how often a task's texts hold them; repeated only where the task's words have become too many."""

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in pieces(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                start, own = zlib.crc32(f"{'' if doc is None else doc}:".encode()), Counter()
                for found in runs(text):
                    own.update(found)
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % drops == 0:
                        i = h % len(word)
                        word = word[:i] + word[i + 1 :]
                    if word:
                        counts[word] += n
                if len(counts) > WORDS_AT_ONCE:
                    yield batch_of(counts)
                    counts = Counter()
        if counts:
            yield batch_of(counts)

    return run


def vocabulary(docs: DataFrame, least_length: int = 5, least: int = 3, drops: int = DROPS) -> DataFrame:
    """word, n: the words of all texts that have so many code points and occur so often."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(_count(drops), "word string, n long").where(F.char_length("word") >= least_length)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row (word, n, m, kp, ks, below) twice: with half of what lies between added to its prefix, or the rest to its suffix.

    m is the length of the shorter words of its pairs, kp and ks how long the
    shared prefix and suffix are, and below bounds the length of the longest
    common prefix of a pair that counts in the partition.
    """
    gap = F.col("m") - F.col("kp") - F.col("ks")
    half = F.floor(gap / 2).cast("int")
    ahead = F.struct((F.col("kp") + half).alias("kp"), F.col("ks").alias("ks"), F.col("below").alias("below"))
    behind = F.struct(F.col("kp").alias("kp"), (F.col("ks") + gap - half).alias("ks"), F.least("below", F.col("kp") + half).alias("below"))
    return rows.withColumn("_to", F.explode(F.array(ahead, behind))).select("word", "n", "m", "_to.kp", "_to.ks", "_to.below")


def _keyed(rows: DataFrame) -> DataFrame:
    """With the partition's key of 128 bits and what lies between the shared prefix and suffix."""
    size = F.char_length("word")
    middle = F.substring("word", F.col("kp") + 1, size - F.col("kp") - F.col("ks"))
    shared = ["m", "kp", "ks", "below", F.substring("word", F.lit(1), F.col("kp")), F.substring("word", size - F.col("ks") + 1, F.col("ks"))]
    return rows.withColumns({"middle": middle, "gap": F.col("m") - F.col("kp") - F.col("ks"), "key": F.xxhash64(*shared), "more": F.xxhash64(F.lit("more"), *shared)})


class Level:
    """One level of a forest of tries: its nodes in order, each with its parent, its letter and the row that ends there (or -1)."""

    def __init__(self, parent: np.ndarray, letter: np.ndarray, parents: int, ends: np.ndarray):
        self.parent, self.letter, self.ends = parent, letter, ends
        self.key = (parent << 8) | letter
        self.begin = np.searchsorted(parent, np.arange(parents + 1))

    def children(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of this level below nodes of the one above, as (place in of, node)."""
        many = self.begin[of + 1] - self.begin[of]
        place = np.repeat(np.arange(len(of)), many)
        return place, np.repeat(self.begin[of] - np.cumsum(many) + many, many) + np.arange(len(place))

    def child(self, of: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node below each by this letter, or -1."""
        want = (of << 8) | letter
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, at, -1)


def levels(first: np.ndarray, points: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[Level]:
    """The tries of sorted rows, one behind the other. first tells where a trie's rows begin; a row's letters are points[at : at + size]."""
    rows, node, found = np.arange(len(size)), np.cumsum(first) - 1, []
    parent, letter, parents = np.zeros(int(first.sum()), np.int64), np.zeros(int(first.sum()), np.int64), 1
    while True:
        ends = np.full(len(parent), -1, np.int64)
        here = size[rows] == len(found)
        ends[node[here]] = rows[here]
        found.append(Level(parent, letter, parents, ends))
        rows, node = rows[~here], node[~here]
        if not len(rows):
            return found
        letters = points[at[rows] + len(found) - 1].astype(np.int64)
        fresh = np.append(True, (node[1:] != node[:-1]) | (letters[1:] != letters[:-1]))
        parents, parent, letter = len(parent), node[fresh], letters[fresh]
        node = np.cumsum(fresh) - 1


def walk(trie: list[Level]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows one edit apart, the longer one first, with the length of their longest common prefix.

    Active nodes at distance 1 of nodes on the same level (another letter in
    place of one) and one level further up (a letter more) are carried down.
    The pairs of nodes are held once, with the level at which the edit began.
    """
    same, more = (np.zeros((3, 0), np.int64) for _ in range(2))

    def ended(upper: np.ndarray, lower: np.ndarray, prefix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        both = (upper >= 0) & (lower >= 0)
        if both.any():
            yield upper[both], lower[both], prefix[both]

    for depth, now in enumerate(trie):
        yield from ended(now.ends[same[0]], now.ends[same[1]], same[2])
        if depth + 1 == len(trie):
            return
        below = trie[depth + 1]
        # A letter more begins here: each child against its parent.
        fresh = np.arange(len(below.parent))
        begun = np.array([fresh, below.parent, np.full(len(fresh), depth)])
        yield from ended(below.ends[more[0]], now.ends[more[1]], more[2])
        yield from ended(below.ends[begun[0]], now.ends[begun[1]], begun[2])
        # Another letter begins here: two children of one node. What has begun goes on with equal letters.
        place, other = below.children(below.parent)
        later = other > place
        place, other = place[later], other[later]
        source, a = below.children(same[0])
        b = below.child(same[1][source], below.letter[a])
        same = np.concatenate([np.array([a, b, same[2][source]])[:, b >= 0], np.array([place, other, np.full(len(place), depth)])], axis=1)
        if depth + 2 == len(trie):
            more = np.zeros((3, 0), np.int64)
            continue
        # The letter behind the one more mustn't repeat it, or the pair would have begun one level further down.
        deepest, onward = trie[depth + 2], []
        for pairs, new in ((more, False), (begun, True)):
            source, a = deepest.children(pairs[0])
            b = below.child(pairs[1][source], deepest.letter[a])
            keep = (b >= 0) & ((deepest.letter[a] != below.letter[pairs[0][source]]) if new else True)
            onward.append(np.array([a, b, pairs[2][source]])[:, keep])
        more = np.concatenate(onward, axis=1)


PAIRS = "word string, n long, other string, other_n long"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, more, middle): both directions of the pairs of each partition."""

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.array([table.column("key").to_numpy(), table.column("more").to_numpy()])
        change = (key[:, 1:] != key[:, :-1]).any(axis=0)
        # A partition with one word has no pairs.
        keep = np.flatnonzero(np.append(False, ~change) | np.append(~change, False))
        if not len(keep):
            return
        table, first = table.take(pa.array(keep)), np.append(True, change)[keep]
        gap, kp, below, n = (table.column(c).to_numpy() for c in ("gap", "kp", "below", "n"))
        words, middles = table.column("word").combine_chunks(), [w.encode("latin-1") for w in table.column("middle").to_pylist()]
        size = np.fromiter(map(len, middles), np.int64, len(middles))
        for i, j, prefix in walk(levels(first, np.frombuffer(b"".join(middles), np.uint8), np.cumsum(size) - size, size)):
            # Pairs of two longer words belong to the partitions of words of their length.
            good = (kp[i] + prefix < below[i]) & (np.minimum(size[i], size[j]) == gap[i])
            a, b = np.append(i[good], j[good]), np.append(j[good], i[good])
            if len(a):
                yield pa.RecordBatch.from_arrays([words.take(pa.array(a)), pa.array(n[a]), words.take(pa.array(b)), pa.array(n[b])], names=["word", "n", "other", "other_n"])

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= BLOCK:
            table = pa.Table.from_batches(kept)
            key = table.column("key").to_numpy()
            ends = np.flatnonzero(key[1:] != key[:-1])
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield from found(table.slice(0, cut))
            kept = table.slice(cut).to_batches()
    if kept:
        yield from found(pa.Table.from_batches(kept))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: both directions of every pair of words (word, n) that differ by one inserted, deleted or replaced code point.

    Words are those of vocabulary(): distinct, not null, of letters up to
    U+00FF and at least 2 code points. An empty table gives no pairs.
    """
    width = shuffle_width(words.sparkSession)
    size = F.char_length("word")
    # As one of the shorter words of a pair or one as long, and as the longer one.
    both = words.withColumn("m", F.explode(F.array(size, size - 1))).select("word", "n", F.col("m").cast("int").alias("m"))
    rows = both.withColumns({"kp": F.lit(0), "ks": F.lit(0), "below": F.lit(1 << 30)})
    rows, spent = _halves(rows), []
    done = None
    while True:
        keyed = saved(_keyed(rows), "partitions")
        spent.append(keyed)
        many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("gap").alias("gap"))
        heavy = saved(many.where((F.col("rows") > PARTITION) & (F.col("gap") > 1)).select(F.col("key").alias("_key")), "heavy")
        spent.append(heavy)
        if heavy.isEmpty():
            done = keyed if done is None else done.unionByName(keyed)
            break
        light = keyed.join(heavy, keyed["key"] == heavy["_key"], "left_anti")
        done = light if done is None else done.unionByName(light)
        rows = _halves(keyed.join(heavy, keyed["key"] == heavy["_key"], "left_semi"))
    pairs = done.repartition(width, "key").sortWithinPartitions("key", "more", "middle").mapInArrow(_joined, PAIRS)
    out = saved(pairs, "near")
    for table in spent:
        discard(table)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of a table word, form: by doubling the steps until nobody has one left. Every step at least doubles n, so there are few."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        after = saved(now.join(step, now["root"] == step["_word"], "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        moved = not after.where("moved").isEmpty()
        discard(now)
        now = after.drop("moved")
        if not moved:
            return now


def spelling_variants(docs: DataFrame, least_length: int = 5, least: int = 3, ratio: int = 2) -> DataFrame:
    """Words of all texts with the frequent word that each is a variant of.

    docs needs doc_id and text; other columns are ignored. Words are vocabulary()'s. Returns word, form (its near word
    with the largest n, of equal ones the first by code points, if that is ratio times its own n or more; else null), root (the
    last form from the word on; itself without a form), n (occurrences in all texts, repeated rows too), n_near (near
    words), form_n (n of form). Null and empty texts hold no words, texts of any length are read whole, a null doc_id counts as
    an empty one, and an empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms end")
    words = saved(vocabulary(docs, least_length, least), "words")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    best = best.select(F.col("word").alias("_word"), "n_near", F.col("best.form").alias("_form"), (-F.col("best.less")).alias("_n"))
    told = words.join(best, words["word"] == best["_word"], "left")
    good = F.col("_n") >= ratio * F.col("n")
    told = saved(told.select("word", F.when(good, F.col("_form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("_n")).alias("form_n")), "told")
    for table in (near, words):
        discard(table)
    roots = _roots(told.where("form is not null")).select(F.col("word").alias("_word"), F.col("root").alias("_root"))
    out = told.join(roots, told["word"] == roots["_word"], "left")
    return out.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
