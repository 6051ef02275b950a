"""Vector codes: product quantisation with codebooks from integer Lloyd rounds, by heaps of bounds.

Vectors become integers and are cut into parts, and each part position has a
codebook. A round assigns every part to the nearest entry and moves each entry
to the mean of its parts. A part that has been compared with all entries knows
how much nearer its own entry is than the next (lower minus upper bound). This
slack shrinks by no more than its own entry and the fastest other one move. So
each block of vectors keeps, for every entry, a heap of its parts by slack plus
the entry's drift so far; a round pops only what the cumulative drift has
reached, compares that exactly with all entries, and pushes it again. All other
parts provably stay, ties included, so results are those of comparing all.

Heaps are arrays in rising order, of which a round pops a prefix. The blocks, with
their heaps, are a table that each round reads and writes; only sums of what has
moved, one row per task and component, come together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pieces, saved, unused

#: Fixed values of the code: components per unit, parts, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Largest magnitude of an integer component; beyond it, a component counts as that, so that squared distances fit 64 bits.
MOST = 1 << 25
#: Vectors of a block.
BLOCK = 16_384
#: Share by which a slack is taken as smaller than computed, as distances are rounded.
ROUNDING = 1e-9


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is neither null nor empty and holds no null or non-finite component."""
    sick = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~sick)


def integers(flat: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Components as floor(scale * x); of floats a power of two as scale keeps this exact."""
    return np.clip(np.floor(flat.astype(np.float64) * scale), -MOST, MOST).astype(np.int64)


def padded(column: pa.Array, width: int, kind) -> np.ndarray:
    """Lists of one column as rows of a matrix, the shorter ones followed by zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(size) * width:
        return flat.reshape(len(size), width).astype(kind)
    out = np.zeros((len(size), width), kind)
    rows = np.repeat(np.arange(len(size)), size)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all parts (rows) to all entries, exact."""
    out = np.zeros((len(parts), len(book)), np.int64)
    for k in range(parts.shape[1]):
        step = parts[:, k : k + 1] - book[None, :, k]
        out += step * step
    return out


def compared(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's nearest entry (ties to the lower) and its slack: how much nearer that is than the next, rounded down."""
    found = distances(parts, book)
    own = found.argmin(axis=1)
    if len(book) == 1:
        return own, np.full(len(parts), np.inf)
    near = np.sqrt(np.partition(found, 1, axis=1)[:, :2].astype(np.float64))
    return own, (near[:, 1] - near[:, 0]) - ROUNDING * (1 + near[:, 1])


class Heaps:
    """A block's heaps of one part position: for every entry its parts in rising order of slack plus drift."""

    def __init__(self, key: np.ndarray, part: np.ndarray, size: np.ndarray):
        self.key, self.part, self.size = key, part, size

    @classmethod
    def of(cls, key: np.ndarray, part: np.ndarray, entry: np.ndarray, entries: int) -> Heaps:
        order = np.lexsort((key, entry))
        return cls(key[order], part[order], np.bincount(entry, minlength=entries))

    @classmethod
    def read(cls, raw: bytes, entries: int) -> Heaps:
        size = np.frombuffer(raw, np.int64, entries)
        n = int(size.sum())
        return cls(np.frombuffer(raw, np.float64, n, 8 * entries), np.frombuffer(raw, np.int32, n, 8 * (entries + n)), size)

    def written(self) -> bytes:
        return self.size.tobytes() + self.key.tobytes() + self.part.astype(np.int32).tobytes()

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    def popped(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, Heaps]:
        """The parts whose slack the drift of their entry has used up, their entries, and the heaps without them."""
        ends = np.cumsum(self.size)
        starts = ends - self.size
        cut = np.array([np.searchsorted(self.key[i:j], d, side="right") for i, j, d in zip(starts, ends, drift, strict=True)], np.int64)
        place = np.arange(len(self.key)) - np.repeat(starts, self.size)
        out = place < np.repeat(cut, self.size)
        return self.part[out], np.repeat(np.arange(len(cut)), cut), Heaps(self.key[~out], self.part[~out], self.size - cut)

    def pushed(self, key: np.ndarray, part: np.ndarray, entry: np.ndarray) -> Heaps:
        if not len(part):
            return self
        # Each entry's new parts are merged into its run.
        order = np.lexsort((key, entry))
        key, part, entry = key[order], part[order], entry[order]
        starts = np.cumsum(self.size) - self.size
        fresh = np.bincount(entry, minlength=len(self.size))
        ends = np.cumsum(fresh)
        at = [starts[e] + np.searchsorted(self.key[starts[e] : starts[e] + self.size[e]], key[ends[e] - fresh[e] : ends[e]]) for e in range(len(fresh))]
        at = np.concatenate(at).astype(np.int64)
        return Heaps(np.insert(self.key, at, key), np.insert(self.part, at, part), self.size + fresh)


STATE = "ids binary, id_null binary, label binary, label_null binary, parts array<binary>, heaps array<binary>, width int, rescanned long, sums array<long>, counts array<long>"
_STATE = pa.schema(
    [("ids", pa.binary()), ("id_null", pa.binary()), ("label", pa.binary()), ("label_null", pa.binary()), ("parts", pa.list_(pa.binary())), ("heaps", pa.list_(pa.binary())), ("width", pa.int32()), ("rescanned", pa.int64()), ("sums", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)


def _row(ids, id_null, label, label_null, parts: list[np.ndarray], heaps: list[Heaps], rescanned: int) -> pa.RecordBatch:
    """A block's row. Components take as few bytes as they can."""
    most = max((int(np.abs(p).max()) for p in parts if p.size), default=0)
    kind = np.int16 if most < 1 << 15 else np.int32
    values = [[ids], [id_null], [label], [label_null], [[p.astype(kind).tobytes() for p in parts]], [[h.written() for h in heaps]], [np.dtype(kind).itemsize], [rescanned], [None], [None]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _STATE, strict=True)], schema=_STATE)


def _totals(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A task's row of changes of all sums and counts."""
    values = [[None], [None], [None], [None], [None], [None], [None], [0], [sums.ravel().tolist()], [counts.ravel().tolist()]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _STATE, strict=True)], schema=_STATE)


def _added(sums: np.ndarray, counts: np.ndarray, j: int, entry: np.ndarray, parts: np.ndarray, sign: int) -> None:
    counts[j] += sign * np.bincount(entry, minlength=counts.shape[1])
    for k in range(parts.shape[1]):
        np.add.at(sums[j, :, k], entry, sign * parts[:, k])


def _first(books: np.ndarray, width: int):
    """Cut vectors into blocks and assign all parts: every part is compared with every entry once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, kept, rows = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64), [], 0

        def block(kept: list[tuple]) -> pa.RecordBatch:
            ids, id_null, label, label_null, x = (np.concatenate(c) for c in zip(*kept, strict=True))
            parts, heaps = np.split(x, len(books), axis=1), []
            for j, part in enumerate(parts):
                entry, slack = compared(part, books[j])
                heaps.append(Heaps.of(slack, np.arange(len(part)), entry, books.shape[1]))
                _added(sums, counts, j, entry, part, 1)
            return _row(ids.tobytes(), id_null.tobytes(), label.tobytes(), label_null.tobytes(), parts, heaps, len(x) * len(books))

        for batch in pieces(batches, rows=BLOCK):
            plain = [(batch.column(c).fill_null(0).to_numpy(zero_copy_only=False), batch.column(c).is_null().to_numpy(zero_copy_only=False)) for c in ("vec_id", "label")]
            kept.append((*plain[0], *plain[1], integers(padded(batch.column("vector"), width, np.float64))))
            rows += batch.num_rows
            if rows >= BLOCK:
                yield block(kept)
                kept, rows = [], 0
        if kept:
            yield block(kept)
        if counts.any():
            yield _totals(sums, counts)

    return run


def _again(books: np.ndarray, drift: np.ndarray):
    """One more assignment: pops the parts that the drift has reached, compares them, and pushes them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                parts = [np.frombuffer(p, f"i{row['width']}").reshape(-1, books.shape[2]) for p in row["parts"]]
                heaps, rescanned = [Heaps.read(h, books.shape[1]) for h in row["heaps"]], 0
                for j, part in enumerate(parts):
                    which, before, rest = heaps[j].popped(drift[j])
                    rescanned += len(which)
                    if not len(which):
                        continue
                    own = part[which].astype(np.int64)
                    entry, slack = compared(own, books[j])
                    heaps[j] = rest.pushed(slack + drift[j][entry], which, entry)
                    moved = entry != before
                    _added(sums, counts, j, before[moved], own[moved], -1)
                    _added(sums, counts, j, entry[moved], own[moved], 1)
                yield _row(row["ids"], row["id_null"], row["label"], row["label_null"], parts, heaps, rescanned)
        if counts.any() or sums.any():
            yield _totals(sums, counts)

    return run


CODES = "vec_id long, label long, code string, error long"


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, label = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["label"], np.int64)
                id_null, label_null = np.frombuffer(row["id_null"], bool), np.frombuffer(row["label_null"], bool)
                code, error = np.zeros((len(ids), len(books)), np.uint8), np.zeros(len(ids), np.int64)
                for j, (part, heap) in enumerate(zip(row["parts"], row["heaps"], strict=True)):
                    held = Heaps.read(heap, books.shape[1])
                    code[held.part, j] = held.owners()
                    step = np.frombuffer(part, f"i{row['width']}").reshape(-1, books.shape[2]).astype(np.int64) - books[j][code[:, j]]
                    error += (step * step).sum(axis=1)
                columns = [pa.array(ids, mask=id_null), pa.array(label, mask=label_null), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return run


def _moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each entry as the mean of its parts, rounded down; unused ones stay."""
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def _drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each entry how much the slack of its parts may have shrunk: its own move and the largest of the others, rounded up."""
    step = (after - before).astype(np.float64)
    move = np.sqrt((step * step).sum(axis=2)) * (1 + ROUNDING)
    others = np.zeros_like(move)
    for e in range(move.shape[1]):
        rest = np.delete(move, e, axis=1)
        others[:, e] = rest.max(axis=1) if rest.shape[1] else 0
    return move + others


def fitted(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame | None, np.ndarray]:
    """The blocks after the last assignment, and the codebooks (part, entry, component); no blocks without usable vectors."""
    rows = usable(vectors, vector).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return None, np.zeros((parts, 0, 0), np.int64)
    width = -(-width // parts) * parts
    heads = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = np.zeros((len(heads), width))
    for i, r in enumerate(heads):
        start[i, : len(r["vector"])] = r["vector"]
    books = np.stack(np.split(integers(start), parts, axis=1))
    sums, counts, drift = np.zeros(books.shape, object), np.zeros(books.shape[:2], object), np.zeros(books.shape[:2])
    state = saved(rows.mapInArrow(_first(books, width), STATE), "codes")
    for _ in range(rounds):
        changes = state.where("sums is not null")
        for name, totals in (("sums", sums), ("counts", counts)):
            # As many rows as the codebooks have components.
            for at, change in changes.select(F.posexplode(name).alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)"))).collect():
                totals.reshape(-1)[at] += int(change)
        after = _moved(books, sums, counts).astype(np.int64)
        drift = (drift + _drifts(books, after)) * (1 + ROUNDING)
        before, books = state, after
        state = saved(before.where("sums is null").mapInArrow(_again(books, drift), STATE), "codes")
        discard(before)
    return state.where("sums is null"), books


def vector_codes(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Each vector as one code byte per part, with the squared error of that.

    vectors needs vec_id, label and the column that vector names; other columns are ignored. Returns vec_id, code (two hex digits a
    part), error, label_error (the errors of all vectors of the same label, nulls together), codebooks_sha256. Vectors
    that are null, empty or hold a null or non-finite component have no row. Shorter vectors count as if zeros followed,
    and so do those whose length isn't a multiple of parts. Components from 8,192 on count as that. Repeated rows
    have a code each; of equal vec_ids the smaller vector is taken first for a codebook, null vec_ids last, and fewer rows than
    entries give smaller codebooks. Ties go to the lower entry. An empty table gives an empty result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    blocks, books = fitted(vectors, vector, parts, entries, rounds)
    spark = vectors.sparkSession
    if blocks is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = blocks.select("ids", "id_null", "label", "label_null", "parts", "heaps", "width").mapInArrow(_codes(books), CODES)
    coded = saved(coded, "coded")
    discard(blocks)
    name = unused(coded, "_label")
    by = coded.groupBy(F.col("label").alias(name)).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(by, coded["label"].eqNullSafe(by[name])).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
