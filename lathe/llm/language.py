"""Language identification by a string kernel: presence of character n-grams, Nyström landmarks, ridge regression.

The kernel of two texts is the number of n-grams of 1 to 4 characters (a
blended spectrum) that occur in both, normalised by their own numbers.
n-grams are hashed into DIM places. Landmarks are texts of the training
sample; the kernel to them, whitened by their own kernel matrix, gives the
features of one-versus-rest ridge regressions. As the kernel is linear in the
presences, the landmarks' part folds into one matrix, and a batch of whole
texts is scored by one matrix product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import pieces, unused

DIM = 1 << 15
#: Bounds of the training sample: rows and landmarks per language; of more than SHARED languages each gets fewer, but FEWEST rows.
ROWS, LANDMARKS, SHARED, FEWEST = 400, 50, 64, 8
RIDGE, SHARPNESS = 0.1, 4.0
#: Rows that are unpacked at once while the model is fitted.
FEW = 32
#: Characters whose n-grams are hashed at once.
PIECE = 1 << 16
_K = np.uint64(0x9E3779B97F4A7C15)


def presences(texts: list[str]) -> np.ndarray:
    """A row of DIM zeros and ones for every text: which n-grams occur in it. Works on PIECE characters at once, however long a text is."""
    out = np.zeros(len(texts) * DIM, np.uint8)
    lowered = [f" {t.lower()} " for t in texts]
    flat = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in lowered])
    for begin in range(0, len(flat), PIECE):
        # n-grams that begin in this piece, so with the characters that they reach into the next.
        part = flat[begin : begin + PIECE + 3].astype(np.uint64)
        owner = np.searchsorted(ends, np.arange(begin, begin + len(part)), side="right")
        h = np.zeros(min(len(part), PIECE), np.uint64)
        for n in range(1, 5):
            size = min(len(h), len(part) - n + 1)
            if size <= 0:
                break
            h = (h[:size] ^ (part[n - 1 : n - 1 + size] + np.uint64(n))) * _K
            h ^= h >> np.uint64(31)
            slots = (h >> np.uint64(7)) & np.uint64(DIM - 1)
            whole = owner[:size] == owner[n - 1 : n - 1 + size]
            out[(owner[:size] * DIM + slots.astype(np.int64))[whole]] = 1
    return out.reshape(len(texts), DIM)


def has_letter(text: str) -> bool:
    """Whether any character is a letter by Unicode (category L), as \\p{L} has it; numbers like ½ and Ⅷ aren't."""
    return any(map(str.isalpha, text))


def _batches(texts: list[str], rows: int = 64, chars: int = 1 << 20) -> Iterator[list[int]]:
    """Indexes of texts in lots of bounded rows and, but for single long texts, characters."""
    lot, size = [], 0
    for i, t in enumerate(texts):
        if lot and (len(lot) == rows or size + len(t) > chars):
            yield lot
            lot, size = [], 0
        lot.append(i)
        size += len(t)
    if lot:
        yield lot


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts = batch.column("text").to_pylist()
        bits = [b for lot in _batches(texts) for b in np.packbits(presences([texts[i] for i in lot]), axis=1)]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([b.tobytes() for b in bits], pa.binary())], names=["lang", "bits"])


def fit(langs: list[str], bits: np.ndarray, names: list[str], landmarks: int = LANDMARKS) -> np.ndarray:
    """Weights (DIM + 1 rows, a column per name) such that presences / sqrt(their number) times the weights, plus the last row, are the scores.

    bits are packed presences. The sample stays packed; a few rows at a time become numbers.
    """

    def rows(at: np.ndarray) -> np.ndarray:
        x = np.unpackbits(bits[at], axis=1)
        size = np.sqrt(np.maximum(1, x.sum(axis=1, dtype=np.int64))).astype(np.float32)
        x = x.astype(np.float32)
        x /= size[:, None]
        return x

    own: dict[str, list[int]] = {name: [] for name in names}
    for i, lang in enumerate(langs):
        own[lang].append(i)
    pick = np.array([i for name in names for i in own[name][:landmarks]])
    marks = np.empty((len(pick), bits.shape[1] * 8), np.float32)
    for i in range(0, len(pick), FEW):
        marks[i : i + FEW] = rows(pick[i : i + FEW])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    white = vectors[:, keep] / np.sqrt(values[keep])
    place = {name: k for k, name in enumerate(names)}
    label = np.array([place[lang] for lang in langs])
    squares, sums = np.zeros((white.shape[1] + 1, white.shape[1] + 1)), np.zeros((white.shape[1] + 1, len(names)))
    for i in range(0, len(bits), FEW):
        at = np.arange(i, min(i + FEW, len(bits)))
        features = np.hstack([(rows(at) @ marks.T).astype(np.float64) @ white, np.ones((len(at), 1))])
        y = np.where(label[at][:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
        squares += features.T @ features
        sums += features.T @ y
    penalty = RIDGE * np.eye(len(squares))
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(squares + penalty, sums)
    return np.vstack([marks.T @ (white @ beta[:-1]).astype(np.float32), beta[-1:]]).astype(np.float32)


def _predict(names: list[str], model, columns: tuple[str, str] = ("lang_pred", "score"), carry: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(model.value, np.float32).reshape(DIM + 1, max(1, len(names)))
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if (names or carry) and has_letter(t)]
            if not names:
                for i in known:
                    lang[i] = None
                known = []
            for lot in _batches([texts[i] for i in known]):
                at = [known[i] for i in lot]
                x = presences([texts[i] for i in at]).astype(np.float32)
                s = (x @ weights[:-1]) / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True))) + weights[-1]
                e = np.exp(SHARPNESS * (s - s.max(axis=1, keepdims=True)))
                score[at] = e.max(axis=1) / e.sum(axis=1)
                for i, k in zip(at, s.argmax(axis=1), strict=True):
                    lang[i] = names[k]
            rest = [n for n in batch.schema.names if carry or n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(lang, pa.string()), pa.array(score)], names=[*rest, *columns])

    return run


def _held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learned(docs: DataFrame) -> tuple[list[str], Broadcast]:
    """Languages and weights from the labelled rows that aren't held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    usable = rows.where(~_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    count = max(1, usable.select("lang").distinct().count())
    per = min(ROWS, max(FEWEST, ROWS * SHARED // count))
    lettered = usable.where(F.col("text").rlike(r"\p{L}"))
    # Of large languages about as many rows as are wanted, by hash, so none meets in a task as a whole; equal rows are one.
    sizes = lettered.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    order = F.xxhash64("doc_id", "text")
    share = (per + 8 * math.sqrt(per) + 16) / F.col("rows")
    few = lettered.select("doc_id", "lang", "text", order.alias("order")).join(F.broadcast(sizes), "lang").where(F.pmod("order", F.lit(1 << 30)) < share * (1 << 30))
    few = few.groupBy("lang", "order", "doc_id").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("order", F.lit(1 << 30)), "order", "doc_id"))
    # At most ROWS * SHARED rows of DIM / 8 bytes each, or FEWEST a language.
    sample = few.withColumn("rank", rank).where(F.col("rank") <= per).select("lang", "text").mapInArrow(_packed, "lang string, bits binary").collect()
    sample = sorted((r["lang"], r["bits"]) for r in sample)
    names, weights = sorted({lang for lang, _ in sample}), np.zeros((DIM + 1, 1), np.float32)
    if names:
        bits = np.frombuffer(b"".join(b for _, b in sample), np.uint8).reshape(len(sample), -1)
        weights = fit([lang for lang, _ in sample], bits, names, min(LANDMARKS, max(1, LANDMARKS * SHARED // len(names))))
    model = spark.sparkContext.broadcast(weights.tobytes())
    return names, model


def identify(docs: DataFrame) -> DataFrame:
    """The language of every whole text, one row per row of docs: doc_id, held_out, lang_pred, score.

    Learns from text and lang of rows whose crc32(doc_id) mod 4 isn't 2 (these
    are held_out), from the first ROWS with a letter of every language in an
    order that a hash of doc_id and text gives, equal rows once; all languages are learned, of more than
    SHARED from fewer rows each. A null text or one without a letter gets 'und' and 0, and so does
    everything if nothing can be learned. A null lang isn't learned from, a
    null doc_id isn't held out. Ties go to the first language by name. Repeated rows get equal
    results; an empty table gives an empty result.
    """
    names, model = learned(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predict(names, model), "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: the predicted language and its score. Its own columns pass through as they are, whatever they are called.

    Where nothing can be learned, the language is null for texts with a letter and 'und' for others.
    """
    names, model = learned(docs)
    lang, score = unused(docs, "lang_pred"), unused(docs, "score")
    # mapInArrow can't take names with a dot in them.
    plain = docs.toDF(*[unused(docs, f"column{k}") if "." in c else c for k, c in enumerate(docs.columns)])
    schema = StructType([*plain.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])
    return plain.mapInArrow(_predict(names, model, (lang, score), carry=True), schema).toDF(*docs.columns, lang, score), lang, score
