"""Quality by hierarchical empirical Bayes: a document classifier's evidence with posteriors of host and path.

Labels are counted by host and by path. Hosts are shrunk towards the global
rate and paths towards their host's posterior, each by a concentration that
the method of moments finds from grouped sums, so sites with few labels keep
close to the level above. A document's log odds are those of its path plus
the classifier's evidence, its log odds less those of its training sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Bound of the classifier's training sample, half of each label; places for hashed trigrams of character kinds.
SAMPLE, PLACES = 4000, 1 << 11
RIDGE, STEPS = 1e-3, 30
_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1] = ord("a")
_KIND[128:] = ord("a")
_KIND[ord("A") : ord("Z") + 1] = ord("A")
_KIND[ord("0") : ord("9") + 1] = ord("0")


def features(text: bytes) -> np.ndarray:
    """Root shares of the trigrams of character kinds of a whole text, its share of repeated words, and a one."""
    out = np.zeros(PLACES + 2, np.float32)
    out[-1] = 1
    kinds = _KIND[np.frombuffer(text, np.uint8)].astype(np.uint32)
    if len(kinds) > 2:
        h = (kinds[:-2] * 7919 + kinds[1:-1] * 104729 + kinds[2:] * 1299709) * np.uint32(2654435761)
        out[:PLACES] = np.sqrt(np.bincount((h >> 16) & (PLACES - 1), minlength=PLACES) / (len(kinds) - 2))
    words = text.split()
    if words:
        out[-2] = 1 - len(set(words)) / len(words)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = [features(t or b"").tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(rows, pa.binary())], names=["good", "x"])


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, by Newton steps on the rows' kernel where these are fewer than columns."""
    x = x.astype(np.float64)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE * len(x))
    penalty[-1] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _evidence(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(model.value, np.float64)
        for batch in pieces(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            score = [float(features(t) @ w) if t else None for t in texts]
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(score, pa.float64())], names=[*rest, "evidence"])

    return run


def _concentration(counts: DataFrame, prior: str) -> float:
    """How strongly groups agree with their prior, by the method of moments over groups of two or more labels; between 1 and 10,000."""
    excess = (F.col("k") / F.col("n") - F.col(prior)) ** 2 - F.col(prior) * (1 - F.col(prior)) / F.col("n")
    r = counts.where("n > 1").agg(F.sum(excess * F.col("n")).alias("v"), F.sum(F.col(prior) * (1 - F.col(prior)) * F.col("n")).alias("m")).first()
    if not r["m"] or r["v"] is None or r["v"] <= 0:
        return 10_000.0
    return min(10_000.0, max(1.0, r["m"] / r["v"] - 1))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_posteriors(labelled: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Posterior rates by host and by (host, path), and the global rate. labelled has host, path, good (0 or 1)."""
    total = labelled.agg(F.count("good").alias("n"), F.sum("good").alias("k")).first()
    rate = ((total["k"] or 0) + 1) / (total["n"] + 2)
    by_path = labelled.groupBy("host", "path").agg(F.count("good").alias("n"), F.sum("good").alias("k"))
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("prior", F.lit(rate))
    s = _concentration(by_host, "prior")
    hosts = by_host.select("host", ((F.col("k") + s * rate) / (F.col("n") + s)).alias("host_posterior"))
    joined = by_path.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    s = _concentration(joined, "host_posterior")
    paths = joined.select("host", "path", ((F.col("k") + s * F.col("host_posterior")) / (F.col("n") + s)).alias("path_posterior"))
    return hosts, paths, rate


def judge_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep_from: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Quality of every document, one row per row of docs: doc_id, evidence, prior, quality (0 to 1), kept.

    labels has doc_id and quality (0 or 1; others are ignored). prior is the
    posterior of the document's host and path, of its host where the path has
    no labels, else the global rate. host and path name the columns that stand
    for these; documents have no URL, so their source and language do. A null or empty text has no evidence; a
    null host or path is a site of its own. Without labels of both kinds there
    is no evidence at all. Of a doc_id's several labels the highest counts. A text
    of any length counts as a whole; further columns are ignored. Repeated rows get
    equal results; an empty table gives an empty result. The classifier is fitted on
    about sample labelled rows, half of each label, which a hash of doc_id chooses, so a
    rerun takes the same.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    marks = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("good"))
    labelled = rows.select("doc_id", "host", "path").join(marks, "doc_id")
    hosts, paths, rate = site_posteriors(labelled)
    counts = {r["good"]: r["count"] for r in marks.groupBy("good").count().collect()}
    w, base = np.zeros(PLACES + 2), 0.0
    if len(counts) == 2:
        # A bounded sample by hash, about half of each label, however many labels there are.
        share = F.when(F.col("good") == 1, sample / 2 / counts[1]).otherwise(sample / 2 / counts[0])
        chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
        # Of rows that share a doc_id one.
        sample = rows.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("good").alias("good"), F.min("text").alias("text"))
        sample = sample.select("good", "text").mapInArrow(_features, "good int, x binary").collect()
        y = np.array([r["good"] for r in sample], float)
        if len(y) and 0 < y.sum() < len(y):
            w = fit(np.frombuffer(b"".join(bytes(r["x"]) for r in sample), np.float32).reshape(len(y), -1), y)
            base = math.log(y.mean() / (1 - y.mean()))
    model = spark.sparkContext.broadcast(w.tobytes())
    scored = rows.mapInArrow(_evidence(model), "doc_id long, host string, path string, evidence double")
    scored = scored.join(paths.withColumnsRenamed({"host": "_h", "path": "_p"}), F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")), "left")
    scored = scored.join(hosts.withColumnRenamed("host", "_g"), F.col("host").eqNullSafe(F.col("_g")), "left")
    scored = scored.withColumn("prior", F.coalesce("path_posterior", "host_posterior", F.lit(rate)))
    evidence = F.coalesce(F.col("evidence") - base, F.lit(0.0))
    quality = 1 / (1 + F.exp(-(_logit(F.col("prior")) + evidence)))
    return scored.select("doc_id", evidence.alias("evidence"), "prior", quality.alias("quality"), (quality >= keep_from).alias("kept"))
