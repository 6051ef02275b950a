"""URL filters: rules by host and path, and for all other URLs a ratio of character language models.

Two variable-order Markov models over the bytes of host and path are counted
over all URLs of the table: one over the rejected ones, and one over the
accepted ones. A URL is rejected if a rule blocks it, if its host holds one of
the rejected words, or if its site is told by its pages: most of the host's
pages show signs in their visible text. All others are accepted, but for those
whose page can't be read, which neither model counts. So the models learn words
of hosts that no list has, and find these where no page tells.
Orders 0 to ORDER are interpolated, each smoothed with the next lower one.
Grams are counted by their own bytes, with nothing hashed or left out, so the
models grow with the URLs; the most frequent grams are scored from a broadcast
of bounded size, all others by joins. A URL is allowed if the
length-normalised log-likelihood difference reaches a threshold, which is
calibrated on a fifth of the URLs that the models haven't counted: the one that
tells both kinds apart best, but none that blocks more than FALSE_BLOCKS of the
accepted ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, pieces, saved

#: Fixed values: (host, path, verdict); a rule's name is its host and path.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Words in hosts that count as rejected.
REJECTED_WORDS = ("casino", "poker", "bets", "pills", "pharma", "ads-", "track", "porn", "xxx", "loan")
#: Words in a page's visible text that are signs of a rejected site.
REJECTED_SIGNS = ("casino", "poker", "bets", "pills", "pharma", "porn", "xxx", "loan")
#: Signs that a page must show to count, the share of a host's pages that must, and pages at the table's own rate that each host is given besides.
SIGNS, SITE_SHARE, PRIOR_PAGES = 3, 0.5, 0.5
#: What isn't visible: scripts, styles, comments and tags, each up to the text's end if it isn't closed, so that a search is linear.
HIDDEN = r"(?is)<(script|style)\b.*?(</\1\s*>|\z)|<!--.*?(-->|\z)|<[^>]*(>|\z)"
ORDER, KAPPA = 5, 4.0
BINS, SPAN = 4000, 4.0
#: Share of the accepted URLs held out that the threshold may block at most.
FALSE_BLOCKS = 0.005
#: Bytes of URLs that are turned into grams at once; each makes some hundred bytes.
AT_ONCE = 1 << 18
#: Bits of a symbol of a gram: a byte, or 256 before the first one.
BITS = 9


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no '://'."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits: its host is the URL's or a parent domain of it, its path begins the URL's."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def signs(html: Column) -> Column:
    """How many of the rejected words a page's visible text holds, as whole words in either case; repeats count. 0 for null."""
    visible = F.regexp_replace(html, HIDDEN, " ")
    return F.coalesce(F.regexp_count(visible, F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}])({'|'.join(REJECTED_SIGNS)})(?![\p{{L}}\p{{N}}])")), F.lit(0))


def rejected_sites(pages: DataFrame) -> DataFrame:
    """host of every site that its pages tell to be rejected. pages has host and shown (boolean: the page shows signs; null if it can't be read).

    The share of a host's pages is drawn towards that of all pages, by as much
    as PRIOR_PAGES further ones would; an empty host is no site.
    """
    by_host = pages.where("host != ''").groupBy("host").agg(F.count("shown").alias("n"), F.count_if("shown").alias("k"))
    all_ = pages.agg(F.count_if("shown").alias("k"), F.count("shown").alias("n")).first()
    rate = all_["k"] / max(1, all_["n"])
    return by_host.where(F.col("k") > 0).where((F.col("k") + F.lit(PRIOR_PAGES * rate)) / (F.col("n") + PRIOR_PAGES) >= SITE_SHARE).select("host")


def _grams(urls: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For all bytes of all URLs, about AT_ONCE at a time: the owner, and the byte with the ORDER symbols before it as one number (the byte lowest)."""
    lot: list[tuple[int, bytes, int]] = []

    def made() -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(r for _, r, _ in lot), np.uint8).astype(np.int64)
        sizes = np.array([len(r) for _, r, _ in lot])
        owner = np.repeat([k for k, _, _ in lot], sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # Before a URL's first byte stand symbols of their own; before a later part of a long one, its own bytes.
        flat[(place < ORDER) & np.repeat([first == 0 for *_, first in lot], sizes)] = 256
        at, gram = np.flatnonzero(place >= ORDER), np.int64(0)
        for k in range(ORDER + 1):
            gram = gram + (flat[at - k] << (BITS * k))
        return owner[at], gram

    size = 0
    for k, u in enumerate(urls):
        raw = bytes(ORDER) + u.encode()
        for first in range(0, len(raw) - ORDER, AT_ONCE):
            part = raw[first : first + AT_ONCE + ORDER]
            lot.append((k, part, first))
            size += len(part)
            if size >= AT_ONCE:
                yield made()
                lot, size = [], 0
    if lot:
        yield made()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of every lot: how often they occur, and how often in URLs the models count, accepted and rejected."""
    for batch in pieces(batches):
        urls = batch.column(0).to_pylist()
        bad, held = (np.array(batch.column(k).to_pylist(), bool) for k in (1, 2))
        for owner, gram in _grams(urls):
            found, at = np.unique(gram, return_inverse=True)
            counts = [np.bincount(at[x[owner]], minlength=len(found)) for x in (np.ones(len(urls), bool), ~held & ~bad, ~held & bad)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found, *counts)], names=["gram", "n", "n0", "n1"])


def _ratios(grams: DataFrame) -> DataFrame:
    """gram, n and d, the log-likelihood difference of the two models for the gram's last byte.

    A gram of order k meets its context and the gram one symbol shorter, which
    no more than 257 grams share, so the joins have no hot keys.
    """
    levels = [grams]
    for k in range(ORDER - 1, -1, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1)).alias("gram")
        levels.insert(0, saved(levels[0].groupBy(shorter).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams"))
    lower, context = None, F.shiftright("gram", BITS)
    for k, level in enumerate(levels):
        all_ = level.groupBy(context.alias("context")).agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
        here = level.withColumn("context", context).join(all_, "context")
        if k:
            here = here.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))).join(lower, "short")
        else:
            here = here.withColumn("p0", F.lit(1 / 256)).withColumn("p1", F.lit(1 / 256))
        p = [(F.col(f"n{c}") + KAPPA * F.col(f"p{c}")) / (F.col(f"c{c}") + KAPPA) for c in (0, 1)]
        lower = here.select(F.col("gram").alias("short"), *[x.alias(f"p{c}") for c, x in enumerate(p)])
    found = saved(here.select("gram", "n", (F.log(p[0]) - F.log(p[1])).alias("d")), "ratios")
    for level in levels[:-1]:
        discard(level)
    return found


def _scored(rows: DataFrame, ratios: DataFrame, hot: int) -> DataFrame:
    """rows (with a unique _row and text) and score; the hot most frequent grams are broadcast, the others joined."""
    spark = rows.sparkSession
    most = ratios.orderBy(F.col("n").desc(), "gram").limit(hot).select("gram", "d").toPandas().sort_values("gram")
    model = spark.sparkContext.broadcast((most["gram"].to_numpy(np.int64), most["d"].to_numpy(np.float64)))

    def found(urls: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        keys, values = model.value
        for owner, gram in _grams(urls):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
                known = keys[at] == gram
                yield owner, gram, known, np.where(known, values[at], 0.0)
            else:
                yield owner, gram, np.zeros(len(gram), bool), np.zeros(len(gram))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            urls = batch.column("text").to_pylist()
            total, size = np.zeros(len(urls)), np.zeros(len(urls), np.int64)
            for owner, _, _, d in found(urls):
                total, size = total + np.bincount(owner, d, len(urls)), size + np.bincount(owner, minlength=len(urls))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total), pa.array(size)], names=[*batch.schema.names, "total", "bytes"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row = np.array(batch.column("_row").to_pylist(), np.int64)
            for owner, gram, known, _ in found(batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(row[owner[~known]]), pa.array(gram[~known])], names=["_row", "gram"])

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    parts = rows.mapInArrow(part, f"{kinds}, total double, bytes long")
    if len(most) == hot:
        joined = rows.select("_row", "text").mapInArrow(rest, "_row long, gram long").join(ratios.select("gram", "d"), "gram")
        # Whole numbers, as sums of doubles depend on their order and equal URLs get equal scores.
        more = joined.groupBy("_row").agg((F.sum(F.round(F.col("d") * (1 << 40)).cast("long")) / (1 << 40)).alias("more"))
        parts = parts.join(more, "_row", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0))).drop("more")
    return parts.withColumn("score", F.col("total") / F.greatest(F.col("bytes"), F.lit(1))).drop("total", "bytes")


def judge_urls(pages: DataFrame, rules=RULES, hot: int = 1 << 19) -> DataFrame:
    """A verdict for every URL, one row per row of pages: page_id, host, path, rule, verdict, score.

    rule is null where none fits; then the models decide. Sites are told by the column
    html, where pages has one. A null or blank html can't be read, so its URL is counted
    by no model unless a rule, its host or other pages of its site reject it; without
    the column all URLs count. An html of any length is read as a whole. Other columns are ignored. score is the mean
    log-likelihood difference per byte of host and path (0 if both are empty).
    A null URL or one without '://' has an empty host and path and is allowed
    if 0 reaches the threshold. Without URLs of both kinds the
    threshold is the lowest, so all are allowed. Very long URLs are counted and
    scored in parts. hot grams (16 bytes each) are
    broadcast; the result doesn't depend on their number. Repeated rows get
    equal results; an empty table an empty result.
    """
    host, path = host_and_path(F.col("url"))
    html = F.col("html").cast("string") if "html" in pages.columns else F.lit("-")
    shown = F.when(html.rlike(r"\S"), signs(html) >= SIGNS)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), shown.alias("shown"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", "shown", name.alias("rule"), verdict.alias("ruled"), F.concat("host", "path").alias("text"))
    word = F.lit(False)
    for w in REJECTED_WORDS:
        word = word | F.contains("host", F.lit(w))
    held = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    rows = saved(rows.select("*", word.alias("listed"), held.alias("held"), F.monotonically_increasing_id().alias("_row")), "urls")
    # Only the hosts of rejected sites come to the join, one row each.
    sites = saved(rejected_sites(rows), "sites").withColumn("_site", F.lit(True))
    rejected = F.col("listed") | F.col("_site").isNotNull()
    bad = F.when(F.col("ruled") == "block", 1).when(F.col("ruled").isNull() & rejected, 1).otherwise(0)
    rows = rows.join(sites, "host", "left").withColumn("bad", bad).withColumn("known", (F.col("bad") == 1) | F.col("shown").isNotNull()).drop("shown", "listed", "_site")
    grams = saved(rows.select("text", "bad", (F.col("held") | ~F.col("known")).alias("held")).mapInArrow(_count, "gram long, n long, n0 long, n1 long").groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")]), "grams")
    scored = saved(_scored(rows, _ratios(grams), hot), "scored")
    seen = grams.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    threshold = -SPAN
    if min(seen) > 0:
        bins = F.least(F.greatest(F.floor((F.col("score") + SPAN) * (BINS / (2 * SPAN))), F.lit(0)), F.lit(BINS - 1)).cast("int")
        binned = scored.where("held and known and text != ''").groupBy(bins.alias("bin"), "bad").count().collect()
        by = np.zeros((2, BINS + 1))
        for r in binned:
            by[r["bad"], r["bin"]] = r["count"]
        # Of all thresholds the one with the best mean of both rates; the middle of a stretch of equals.
        share = by / np.maximum(1, by.sum(axis=1, keepdims=True))
        right = np.append(0, np.cumsum(share[1]))[: BINS + 1] + 1 - np.append(0, np.cumsum(share[0]))[: BINS + 1]
        best = np.flatnonzero(right >= right.max() - 1e-12)
        # None of the lowest bins that hold more than the share of accepted ones that may be blocked.
        harmless = int(np.searchsorted(np.cumsum(share[0]), FALSE_BLOCKS, side="right"))
        threshold = min(best[len(best) // 2], harmless) * (2 * SPAN / BINS) - SPAN
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score")
