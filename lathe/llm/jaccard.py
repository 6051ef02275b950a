"""N-gram Jaccard join on a token-group matrix: components of documents whose shingle sets are similar.

Documents are partitioned into groups by the smallest hash of their shingle
set, which similar documents share with a probability of their similarity;
inside such a family, members link to a few pivots, those that hold the most
frequent tokens first, as the origin of many copies does. Each group keeps the
union of its members' prefix tokens (the token-group matrix, stored sparsely as
token, group). Tokens are ordered by how often they occur (from a count sketch
of fixed size, which only decides about the order), so passages that many
documents hold hardly ever come up.

Two sets of sizes a and b that reach the threshold t overlap in
o = ceil(t (a + b) / (1 + t)) tokens at least. Of the first
n - ceil(t n) + e(n) tokens of both, in any order of all tokens, they share
all of o but those that either prefix leaves out (see needed()), so a group is
opened for a query only if the unions share that many.

Groups are opened in two phases. First each token that many groups hold links
them to its few foremost groups; what turns out to be similar is contracted.
Then pairs are formed between components only, so a large group of copies
makes no pairs with itself, and every pair of different components is still
judged. A group is opened by its root first, and its members only if the two
aren't in one component by then. What is opened is verified exactly on the
full sets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, pieces, saved, shuffle_width

#: Prefix tokens that two similar sets of equal prefix bounds share at least: a share of the set's size, EXTRA at least, and one for small sets.
EXTRA, EXTRA_SHARE, SMALL = 2, 20, 10
#: Members of a family against which all its others are compared before anything else, and sets in a family; larger ones are dealt out by hash.
PIVOTS, FAMILY = 16, 1000
#: A token that more groups hold links these to its first HUBS groups before pairs are formed.
HEAVY, HUBS = 16, 4
#: Query sets that one verification task holds; pairs that are formed at once.
BLOCK, AT_ONCE = 2000, 1 << 20
SKETCH_BITS, SLICES = 20, 64
#: Ids that a broadcast filter may hold (16 MB); beyond that documents are chosen by a join.
FILTER_MOST = 1 << 23
#: Tokens that one task sorts at once, about.
TOKENS_PER_BUCKET = 1_000_000
#: Least sizes of the classes that stand for set sizes in the matrix: exact up to 40, then in steps of 5 %.
_least = list(range(41))
while len(_least) < 256:
    _least.append(max(_least[-1] + 1, _least[-1] * 21 // 20))
LOW = np.array(_least, np.int64)
HIGH = np.append(LOW[1:] - 1, 1 << 40)

_K, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; empty without words.

    A-Z are lower-cased, words are split at ASCII white space; a text of fewer
    words is one shingle as a whole.
    """
    parts = (text or b"").lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, n)
    size = min(words, n)
    s = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        s = (s ^ h[i : n - size + 1 + i]) * _K
        s ^= s >> np.uint64(29)
    s *= _C
    s ^= s >> np.uint64(32)
    return np.unique(s)


def extra(n):
    return np.maximum(np.where(np.asarray(n) < SMALL, 1, EXTRA), n // EXTRA_SHARE)


def prefix_tokens(tokens: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int, int]:
    """The rarest tokens of a set, as many as the prefix bound asks for; how frequent these are, from 0 to 255; and where the last of them stands in the order of all tokens."""
    n = len(tokens)
    keep = min(n, n - -(-percent * n // 100) + int(extra(n)))
    often = counts[(tokens & np.uint64(len(counts) - 1)).astype(np.int64)]
    order = np.argsort(often, kind="stable")[:keep]
    last = order[-1]
    return tokens[order], min(255, int(16 * np.log2(1.0 + often[order]).mean())), int(often[last]) << 47 | int(tokens[last]) >> 17


def size_class(n):
    return np.searchsorted(LOW, n, side="right") - 1


def needed(percent: int, low_a, high_a, low_b, high_b):
    """Prefix tokens that two sets of sizes within these bounds share at least if they reach the threshold.

    For exact sizes this is their least overlap, less what either prefix may
    leave out. Over a range it is smallest where the larger set's size is as
    large as the smaller one's allows; 2 less make up for rounding.
    """

    def least(small, low, high):
        large = np.clip(small * 100 // percent, low, high)
        small = np.maximum(np.minimum(small, large), -(-percent * large // 100))
        overlap = -(-percent * (large + small) // (100 + percent))
        return overlap - np.maximum(-(-percent * large // 100) - extra(large), -(-percent * small // 100) - extra(small))

    found = np.minimum(least(low_b, low_a, high_a), least(low_a, low_b, high_b))
    return np.maximum(found - 2 * ((low_a != high_a) | (low_b != high_b)), extra(np.minimum(low_a, low_b)))


def linked(percent: int, inter: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    return (inter > 0) & (100 * inter >= percent * (a + b - inter))


class Opened:
    """Query sets against which members are compared, all at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.tokens, starts = np.unique(flat[order], return_index=True)
        self.starts = np.append(starts, len(flat))

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.tokens, tokens)
        at = at[at < len(self.tokens)] if len(at) and at[-1] >= len(self.tokens) else at
        at = at[self.tokens[at] == tokens[: len(at)]]
        first, many = self.starts[at], self.starts[at + 1] - self.starts[at]
        total = int(many.sum())
        if not total:
            return np.zeros(len(self.sizes), np.int64)
        spread = np.repeat(first - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(total)
        return np.bincount(self.owners[spread], minlength=len(self.sizes))


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _signature(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _as_long(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def _hit(bits: np.ndarray, value: int) -> bool:
    """Whether a filter may hold a value; all do if there is no filter."""
    if not len(bits):
        return True
    mask, other = len(bits) - 1, value >> 29
    return bool(bits[(value >> 6) & mask] >> (value & 63) & 1 and bits[(other >> 6) & mask] >> (other & 63) & 1)


def _filter_of(df: DataFrame, column: str) -> np.ndarray:
    """A filter with two bits for each value of a long column, of 16 MB at most for FILTER_MOST values; false hits cost work, never results."""
    words = 1 << max(10, (16 * df.count() - 1).bit_length() - 6)
    sides = F.explode(F.array(F.col(column), F.shiftrightunsigned(column, 29)))
    slot = F.shiftrightunsigned("_x", 6).bitwiseAND(words - 1).cast("int")
    bit = F.expr("shiftleft(1L, cast(_x & 63L as int))")
    found = df.select(sides.alias("_x")).groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def _chosen(texts: DataFrame, ids: DataFrame) -> tuple[DataFrame, bytes]:
    """texts (doc_id, text) for the ids in rep: with a filter that tells them, which may be broadcast; or joined, if these are too many for one."""
    spark = texts.sparkSession
    if ids.count() <= FILTER_MOST:
        return texts, _filter_of(ids, "rep").tobytes()
    return texts.join(ids, texts["doc_id"] == ids["rep"], "left_semi"), b""


BASE = "doc_id long, n int, sig binary, fam long, slice int, blob binary"


def _describe(words: int):
    """Pass 1: per document its set's size, signature and family; per task the counts of its tokens by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, schema = np.zeros(1 << SKETCH_BITS, np.uint32), set(), None
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("fam", pa.int64()), ("slice", pa.int32()), ("blob", pa.binary())])
        for batch in pieces(batches):
            sizes, sigs, fams, fresh = [], [], [], []
            for text in _texts(batch):
                tokens = shingle_set(text, words)
                sig = _signature(tokens) if len(tokens) else b""
                sizes.append(len(tokens))
                sigs.append(sig)
                fams.append(tokens[0] if len(tokens) else 0)
                if len(tokens) and sig not in seen:
                    seen.add(sig)
                    fresh.append(tokens)
            if fresh:
                at = (np.concatenate(fresh) & np.uint64(len(counts) - 1)).astype(np.int64)
                counts += np.bincount(at, minlength=len(counts)).astype(np.uint32)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary()), pa.array(_as_long(fams)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        if seen:
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int32()), pa.nulls(SLICES, pa.binary()), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return run


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.int64)
            sums[k] = sums[k] + part if k in sums else part
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(v, 65535).astype(np.uint16).tobytes() for v in sums.values()], pa.binary())], names=["slice", "blob"])


PARTS = "fam long, sig binary, n int, blob binary, whole boolean, gid long, hub int, last long"
_PARTS = pa.schema([("fam", pa.int64()), ("sig", pa.binary()), ("n", pa.int32()), ("blob", pa.binary()), ("whole", pa.bool_()), ("gid", pa.int64()), ("hub", pa.int32()), ("last", pa.int64())])


def _first_id(kind: int) -> int:
    """Where a task begins to number its groups: the numbers of two tasks or kinds never meet, and a repeated task gives the same."""
    return (TaskContext.get().partitionId() << 33) + (kind << 32)


def _part(words: int, percent: int, counts, many, firsts):
    """Pass 2: per set its prefix tokens if no other set is in its family, else the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits, seen, gid = np.frombuffer(counts.value, np.uint16), np.frombuffer(many.value, np.uint64), set(), _first_id(0)
        chosen = np.frombuffer(firsts.value, np.uint64)
        for batch in pieces(batches):
            rows, known = [], batch.column("whole").to_pylist()
            for doc, text, whole in zip(batch.column("doc_id").to_pylist(), _texts(batch), known, strict=True):
                if doc is None or not _hit(chosen, doc):
                    continue
                tokens = shingle_set(text, words)
                if not len(tokens) or (sig := _signature(tokens)) in seen:
                    continue
                seen.add(sig)
                whole = _hit(bits, int(tokens[0])) if whole is None else whole
                prefix, hub, end = prefix_tokens(tokens, table, percent)
                rows.append((tokens[0], sig, len(tokens), (tokens if whole else prefix).tobytes(), whole, gid, hub, end))
                gid += 1
            if rows:
                fams, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(_as_long(fams)), *(pa.array(list(c), f.type) for c, f in zip(rest, list(_PARTS)[1:], strict=True))], schema=_PARTS)

    return run


STARS = "sig binary, pivot binary, grp binary, gid long, n int, blob binary, hub int, last long"
_STARS = pa.schema([("sig", pa.binary()), ("pivot", pa.binary()), ("grp", pa.binary()), ("gid", pa.int64()), ("n", pa.int32()), ("blob", pa.binary()), ("hub", pa.int32()), ("last", pa.int64())])


def _star(percent: int, counts):
    """Families in order of (fam, part, down, sig): link members to the first PIVOTS of their family. Holds only these, whatever the family's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, gid = np.frombuffer(counts.value, np.uint16), _first_id(1)
        fam, last, pivots, sigs, roots, opened = None, None, [], [], [], None
        for batch in pieces(batches):
            rows = []
            for *f, hub, sig, n, blob in zip(*(batch.column(c).to_pylist() for c in ("fam", "part", "hub", "sig", "n", "blob")), strict=True):
                if f != fam:
                    fam, last, pivots, sigs, roots = f, None, [], [], []
                if sig == last:
                    continue
                last, tokens = sig, np.frombuffer(blob, np.uint64)
                links = np.flatnonzero(linked(percent, opened.overlaps(tokens), opened.sizes, n)) if pivots else ()
                if len(links):
                    root = roots[links[0]]
                else:
                    root, gid = (sig, gid), gid + 1
                prefix, _, end = prefix_tokens(tokens, table, percent)
                prefix = prefix.tobytes()
                rows += [(sig, sigs[i], *root, n, prefix if k == 0 else None, hub, end) for k, i in enumerate(links)] or [(sig, None, *root, n, prefix, hub, end)]
                if len(pivots) < PIVOTS:
                    pivots.append(tokens)
                    sigs.append(sig)
                    roots = [root if r in {roots[i] for i in links} else r for r in roots] + [root]
                    opened = Opened(pivots)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _STARS, strict=True)], schema=_STARS)

    return run


TOKENS = "bucket int, first long, size binary, hub binary, at binary, token binary"


def _spread(buckets: int):
    """Packs tokens by bucket: each row has those of some hundred thousand tokens that fall into a bucket, with their groups' numbers (as steps from first on), size classes and hubs.

    Of a token, 48 bits above those that give the bucket are kept; a chance
    agreement opens a group in vain at worst.
    """

    def packed(tokens: list[np.ndarray], gids: np.ndarray, sizes: np.ndarray, hubs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for task in np.unique(gids >> 32):
            own = np.flatnonzero(gids >> 32 == task)
            own = own[np.argsort(gids[own], kind="stable")]
            flat, owner = np.concatenate([tokens[i] for i in own]), np.repeat(own, [len(tokens[i]) for i in own])
            bucket = (flat % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, flat, owner = bucket[order], flat[order], owner[order]
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(starts[1:], len(bucket))
            low = flat.view(np.uint8).reshape(-1, 8)[:, 2:]
            first, at = int(gids[own[0]]), gids[owner]
            step = np.diff(at, prepend=first)
            step[starts] = at[starts] - first
            step = step.astype(np.uint16 if step.max() < 1 << 16 else np.uint32)
            size, hub = size_class(sizes[owner]).astype(np.uint8), hubs[owner].astype(np.uint8)
            cut = [(size[i:j].tobytes(), hub[i:j].tobytes(), step[i:j].tobytes(), low[i:j].tobytes()) for i, j in zip(starts, ends, strict=True)]
            columns = [pa.array([c[k] for c in cut], pa.binary()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(np.full(len(cut), first, np.int64)), *columns], names=["bucket", "first", "size", "hub", "at", "token"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, total = [], 0
        for batch in batches:
            kept.append(([np.frombuffer(b, np.uint64) for b in batch.column("blob").to_pylist()], *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("gid", "n", "hub"))))
            total += batch.column("blob").nbytes // 8
            if total >= TOKENS_PER_BUCKET // 2:
                yield from packed([t for k in kept for t in k[0]], *(np.concatenate([k[i] for k in kept]) for i in (1, 2, 3)))
                kept, total = [], 0
        if kept:
            yield from packed([t for k in kept for t in k[0]], *(np.concatenate([k[i] for k in kept]) for i in (1, 2, 3)))

    return run


#: Either a pair of groups from a heavy token, or a shared token's group (a) with the classes of its sets' sizes.
SHARED = "token long, a long, b long, low int, high int, need long"


def _shared(percent: int):
    """Rows in order of bucket: the tokens that several groups hold, and of those that many hold the pairs with their first groups."""

    def found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        raw = np.zeros((sum(len(r[-1]) // 6 for r in rows), 8), np.uint8)
        raw[:, 2:] = np.frombuffer(b"".join(r[-1] for r in rows), np.uint8).reshape(-1, 6)
        token = raw.view(np.uint64).ravel()
        gid = np.concatenate([first + np.cumsum(np.frombuffer(at, np.uint16 if len(at) == 2 * len(size) else np.uint32), dtype=np.int64) for first, size, _, at, _ in rows])
        size, hub = (np.frombuffer(b"".join(r[k] for r in rows), np.uint8).astype(np.int64) for k in (1, 2))
        order = np.argsort(token)
        token = token[order]
        same = token[1:] == token[:-1]
        order = order[np.append(False, same) | np.append(same, False)]
        token = raw.view(np.uint64).ravel()[order]
        order = order[np.lexsort((gid[order], token))]
        token, gid, size, hub = raw.view(np.uint64).ravel()[order], gid[order], size[order], hub[order]
        if not len(token):
            return
        starts = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (gid[1:] != gid[:-1])))
        token, gid, low, high, hub = token[starts], gid[starts], np.minimum.reduceat(size, starts), np.maximum.reduceat(size, starts), np.maximum.reduceat(hub, starts)
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        held = np.diff(np.append(starts, len(token)))
        many = np.repeat(held, held)
        token, gid, low, high, hub, many = (x[many > 1] for x in (token, gid, low, high, hub, many))
        name = (token >> np.uint64(16)).astype(np.int64)
        nothing = pa.nulls(len(gid), pa.int64())
        columns = [pa.array(name), pa.array(gid), nothing, pa.array(low, pa.int32()), pa.array(high, pa.int32()), nothing]
        yield pa.RecordBatch.from_arrays(columns, names=["token", "a", "b", "low", "high", "need"])

        order = np.flatnonzero(many > HEAVY)
        order = order[np.lexsort((gid[order], -hub[order], token[order]))]
        token, gid, low, high, held = token[order], gid[order], LOW[low[order]], HIGH[high[order]], many[order]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.empty(0, np.int64)
        place = np.arange(len(token)) - np.repeat(starts, held[starts])
        for k in range(HUBS):
            b = np.flatnonzero(place > k)
            a = b - place[b] + k
            fits = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
            a, b = a[fits], b[fits]
            if len(a):
                nothing = pa.nulls(len(a), pa.int64())
                need = needed(percent, low[a], high[a], low[b], high[b])
                yield pa.RecordBatch.from_arrays([nothing, pa.array(gid[a]), pa.array(gid[b]), nothing.cast(pa.int32()), nothing.cast(pa.int32()), pa.array(need)], names=["token", "a", "b", "low", "high", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "first", "size", "hub", "at", "token")), strict=True):
                if k != bucket and rows:
                    yield from found(rows)
                    rows = []
                bucket = k
                rows.append(row)
        if rows:
            yield from found(rows)

    return run


PAIRS = "a long, b long, need long"


def _crossed(percent: int):
    """Rows in order of (token, alone, component): all pairs of a token's groups that aren't in one component, if their sets' sizes allow a link.

    alone tells that the group is a component of its own; most, how many
    tokens it can have in common with a set whose prefix doesn't end before
    last, where the first of its own prefixes ends in the order of tokens.
    """

    def pairs_of(token, alone, comp, gid, low, high, most, last) -> Iterator[pa.RecordBatch]:
        ends = np.append(np.flatnonzero(token[1:] != token[:-1]) + 1, len(token))
        changes = (token[1:] != token[:-1]) | alone[1:] | alone[:-1] | (comp[1:] != comp[:-1])
        runs = np.append(np.flatnonzero(changes) + 1, len(token))
        at = np.arange(len(token))
        begin, end = runs[np.searchsorted(runs, at, side="right")], ends[np.searchsorted(ends, at, side="right")]
        upto = np.cumsum(end - begin)
        i = 0
        while i < len(at):
            # Rows whose pairs are formed at once; of a row with very many, all.
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + AT_ONCE, side="right")))
            size = (end - begin)[i:j]
            a = np.repeat(at[i:j], size)
            b = np.repeat(begin[i:j] - np.cumsum(size) + size, size) + np.arange(len(a))
            fits = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
            both = np.where(last[a] < last[b], most[a], np.where(last[b] < last[a], most[b], np.maximum(most[a], most[b])))
            fits &= (100 + percent) * both >= percent * (low[a] + low[b])
            a, b, i = a[fits], b[fits], j
            if len(a):
                need = needed(percent, low[a], high[a], low[b], high[b])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(gid[a], gid[b])), pa.array(np.maximum(gid[a], gid[b])), pa.array(need)], names=["a", "b", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "alone", "comp", "gid", "low", "high", "most", "last")]
            now = now if kept is None else [np.concatenate(x) for x in zip(kept, now, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            # The last token may go on in the next batch.
            if cut:
                yield from pairs_of(*(x[:cut] for x in now))
            kept = [x[cut:] for x in now]
        if kept is not None:
            yield from pairs_of(*kept)

    return run


def _need(percent: int):
    """Keeps pairs that share enough tokens for the exact sizes of their groups' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, la, ha, lb, hb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shared", "la", "ha", "lb", "hb"))
            keep = pa.array(shared >= needed(percent, la, ha, lb, hb), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("ga"), batch.column("gb")], names=["a", "b"]).filter(keep)

    return run


SETS = "sig binary, n int, blob binary, places binary"


def places(tokens: np.ndarray) -> bytes:
    """How many tokens of a set fall into each of about half as many places; empty if a count exceeds a byte.

    The smaller counts of two sets, summed over all places, bound their overlap.
    """
    size = 1 << max(4, len(tokens).bit_length() - 2)
    counts = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size)
    return b"" if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def may_link(percent: int, a: bytes, b: bytes, na: int, nb: int) -> bool:
    """False only if two sets can't reach the threshold, by their places."""
    if not a or not b:
        return True
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    size = min(len(x), len(y))
    most = int(np.minimum(x.reshape(-1, size).sum(axis=0), y.reshape(-1, size).sum(axis=0)).sum())
    return 100 * most >= percent * (na + nb - most)


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("pa", "pb", "na", "nb")), strict=True)
            keep = pa.array([may_link(percent, *r) for r in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("home"), batch.column("query")], names=["home", "query"]).filter(keep)

    return run


def _sets(words: int, wanted):
    """Pass 3: the whole sets of the groups to be opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(wanted.value, np.uint64), set()
        for batch in pieces(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                if doc is None or not _hit(bits, doc):
                    continue
                tokens = shingle_set(text, words)
                if len(tokens) and (sig := _signature(tokens)) not in seen:
                    seen.add(sig)
                    rows.append((sig, len(tokens), tokens.tobytes(), places(tokens)))
            if rows:
                types = [pa.binary(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["sig", "n", "blob", "places"])

    return run


LINKS = "a binary, b binary"


def _open(percent: int):
    """Rows in order of (home, block, member): compare a group's members with the queries that it qualifies for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, sets, sigs, opened, last = None, [], [], None, None
        for batch in batches:
            found = []
            for h, block, member, sig, n, blob in zip(*(batch.column(c).to_pylist() for c in ("home", "block", "member", "sig", "n", "blob")), strict=True):
                if (h, block) != home:
                    home, sets, sigs, opened, last = (h, block), [], [], None, None
                if (member, sig) == last:
                    continue
                last, tokens = (member, sig), np.frombuffer(blob, np.uint64)
                if not member:
                    sets.append(tokens)
                    sigs.append(sig)
                elif sets:
                    opened = opened or Opened(sets)
                    found += [(sigs[i], sig) for i in np.flatnonzero(linked(percent, opened.overlaps(tokens), opened.sizes, n))]
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def jaccard_components(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """Components under links of Jaccard similarity >= threshold between sets of word shingles.

    docs needs doc_id and text; other columns are ignored. Returns one row per
    row of docs: doc_id, n_shingles (size of its set), component_id (smallest
    doc_id reachable by links, its own included). A null or empty text has an
    empty set and no links. Equal sets are one class and link as a whole. A
    text that occurs with null doc_ids only is returned with a null component_id
    and links no others. A text of any length gives its whole set, which one task holds. Rows that share a doc_id count as one document. An
    empty table gives an empty result. Links are exact but for collisions of 64-bit
    shingle hashes. threshold must be 0.75 or more (see EXTRA).
    """
    if not 0.75 <= threshold <= 1:
        raise ValueError("threshold must be from 0.75 to 1")
    spark, percent = docs.sparkSession, math.ceil(round(threshold * 100, 6))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = shuffle_width(spark)

    base = saved(texts.mapInArrow(_describe(words), BASE), "base")
    found = base.where("slice is not null").select("slice", "blob").repartition(min(SLICES, width), "slice").mapInArrow(_sum_slices, "slice int, blob binary").collect()
    parts = {r["slice"]: bytes(r["blob"]) for r in found}
    empty = bytes(2 << SKETCH_BITS)[: (2 << SKETCH_BITS) // SLICES]
    counts = spark.sparkContext.broadcast(b"".join(parts.get(k, empty) for k in range(SLICES)))
    rows = base.where("slice is null")

    reps = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("fam").alias("fam"), F.min("n").alias("n"))
    reps = saved(reps, "reps")
    ids = reps.where("rep is not null").select("sig", "rep")
    families = saved(reps.groupBy("fam").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "families")
    many = b""
    if families.count() <= FILTER_MOST:
        many = _filter_of(families, "fam").tobytes()
        source, bits = _chosen(texts, ids.select("rep"))
        source = source.select("doc_id", "text", F.lit(None).cast("boolean").alias("whole"))
    else:
        told = reps.where("rep is not null").join(families, "fam", "left").select("rep", F.col("members").isNotNull().alias("whole"))
        source, bits = texts.join(told, texts["doc_id"] == told["rep"]).select("doc_id", "text", "whole"), b""
    many = spark.sparkContext.broadcast(many)
    part = saved(source.mapInArrow(_part(words, percent, counts, many, spark.sparkContext.broadcast(bits)), PARTS), "parts")
    # Whole sets of one family meet in a task; those of a large one are dealt out, and its parts meet as groups.
    sub = F.pmod(F.xxhash64("sig"), F.ceil(F.coalesce("members", F.lit(1)) / FAMILY)).cast("int")
    whole = part.where("whole").join(families.where(F.col("members") > FAMILY), "fam", "left").select("fam", sub.alias("part"), "hub", (-F.col("hub")).alias("down"), "sig", "n", "blob")
    stars = whole.repartition(width, "fam", "part").sortWithinPartitions("fam", "part", "down", "sig").mapInArrow(_star(percent, counts), STARS)
    stars = saved(stars, "stars")

    own, grouped = part.where("not whole"), stars.where("blob is not null")
    total = (own.agg(F.sum(F.length("blob"))).first()[0] or 0) + (grouped.agg(F.sum(F.length("blob"))).first()[0] or 0)
    buckets = max(width, -(-total // (8 * TOKENS_PER_BUCKET)))
    tokens = own.select("gid", "n", "hub", "blob").union(grouped.select("gid", "n", "hub", "blob")).mapInArrow(_spread(buckets), TOKENS)
    shared = saved(tokens.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared(percent), SHARED), "shared")
    names = own.select("gid", F.col("sig").alias("grp"), F.col("n").cast("long").alias("low"), F.col("n").cast("long").alias("high"), F.lit(1).cast("long").alias("m"), "last")
    names = names.union(grouped.groupBy("gid").agg(F.first("grp"), F.min("n").cast("long"), F.max("n").cast("long"), F.count(F.lit(1)), F.min("last")))
    # Only groups that share a token are named from here on.
    names = saved(names.join(shared.where("token is not null").select(F.col("a").alias("gid")).distinct(), "gid", "left_semi"), "names")
    linked_to = saved(stars.where("pivot is not null").select("grp", "sig", "pivot"), "linked")
    groups = saved(grouped.select("grp", "sig"), "groups")
    for done in (families, part, stars):
        discard(done)

    spent: list[DataFrame] = []
    cores = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = saved(cores.join(groups, "grp").select("grp", "sig"), "members")

    def named(pairs: DataFrame) -> DataFrame:
        """Pairs of groups by their roots, of counted tokens as many as their sizes ask for."""
        counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("need")).where("shared >= need")
        left, right = (names.select(F.col("gid").alias(x), F.col("grp").alias(f"g{x}"), F.col("low").alias(f"l{x}"), F.col("high").alias(f"h{x}")) for x in ("a", "b"))
        sized = counted.join(left, "a").join(right, "b").select("ga", "gb", "shared", "la", "ha", "lb", "hb")
        return sized.mapInArrow(_need(percent), "a binary, b binary")

    def with_sizes(pairs: DataFrame) -> DataFrame:
        """Pairs as home, the group with more members, and query."""
        sized = pairs.join(cores.select(F.col("grp").alias("a"), F.col("m").alias("ma")), "a", "left").join(cores.select(F.col("grp").alias("b"), F.col("m").alias("mb")), "b", "left")
        first = F.coalesce("ma", F.lit(1)) >= F.coalesce("mb", F.lit(1))
        return sized.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("home"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("query"), F.greatest("ma", "mb").isNotNull().alias("core"), (F.col("ma").isNotNull() & F.col("mb").isNotNull()).alias("cores"))

    def sets_of(sigs: DataFrame) -> DataFrame:
        """The whole sets of these."""
        source, bits = _chosen(texts, sigs.distinct().join(ids, "sig").select("rep"))
        return saved(source.mapInArrow(_sets(words, spark.sparkContext.broadcast(bits)), SETS), "sets")

    def each(df: DataFrame, group: str, all_: bool) -> DataFrame:
        """With every member's sig, or the root's alone."""
        if not all_:
            return df.withColumn("sig", F.col(group))
        right = members.select(F.col("grp").alias(group), F.col("sig").alias("_sig"))
        return df.join(right, group, "left").withColumn("sig", F.coalesce("_sig", group)).drop("_sig")

    def compared(opened: DataFrame, sets: DataFrame, all_queries: bool, all_members: bool) -> DataFrame:
        """Links between what stands for the groups home and query."""
        asked = each(opened, "query", all_queries).select("home", "sig")
        homes = asked.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        asked = asked.join(homes, "home").select("home", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("member"), "sig")
        held = each(homes, "home", all_members).select("home", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("member"), "sig")
        # Saved, so its size is known before the join is planned: where few sets are asked for, the others stay where they are.
        roles = saved(asked.union(held), "roles")
        spent.append(roles)
        roles = roles.join(sets.select("sig", "n", "blob"), "sig")
        return roles.repartition(width, "home", "block").sortWithinPartitions("home", "block", "member", "sig").mapInArrow(_open(percent), LINKS)

    def bounded(sized: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs whose roots may be linked, by their places."""
        light = sets.select("sig", "n", "places")
        both = sized.join(light.select(F.col("sig").alias("home"), F.col("n").alias("na"), F.col("places").alias("pa")), "home").join(light.select(F.col("sig").alias("query"), F.col("n").alias("nb"), F.col("places").alias("pb")), "query")
        return both.select("home", "query", "pa", "pb", "na", "nb").mapInArrow(_bounded(percent), "home binary, query binary")

    def numbered(links: DataFrame) -> DataFrame:
        out = links.join(ids.select(F.col("sig").alias("a"), F.col("rep").alias("src")), "a")
        return out.join(ids.select(F.col("sig").alias("b"), F.col("rep").alias("dst")), "b").select("src", "dst")

    of_group = groups.select(F.col("sig").alias("b"), F.col("grp").alias("_b"))

    def components(links: DataFrame) -> DataFrame:
        """sig and component of the roots of linked groups; a member stands for its group, as groups are connected."""
        ends = links.join(of_group, "b", "left").select("a", F.coalesce("_b", "b").alias("b")).join(of_group.withColumnsRenamed({"b": "a", "_b": "_a"}), "a", "left").select(F.coalesce("_a", "a").alias("a"), "b")
        comps = connected_components(numbered(ends))
        found = saved(ids.join(comps.withColumnRenamed("node", "rep"), "rep").select("sig", "component"), "component-of")
        discard(comps)
        return found

    # First phase: each heavy token's groups with its foremost ones, root by root.
    pairs = saved(named(shared.where("token is null").select("a", "b", "need")), "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")))
    within = linked_to.select("grp", F.col("pivot").alias("sig")).join(groups.select("sig", F.col("grp").alias("other")), "sig").where("grp != other").select(F.col("grp").alias("a"), F.col("other").alias("b"))
    links = saved(compared(bounded(with_sizes(pairs), sets), sets, False, False).union(within.distinct()), "links")
    for done in (pairs, sets):
        discard(done)

    # Second phase: all pairs of groups of different components.
    of = components(links)
    placed = names.select("gid", F.col("grp").alias("sig"), "low", "high", "m", "last").join(of, "sig", "left").select(F.col("gid").alias("a"), "low", "high", "m", "last", "component")
    postings = shared.where("token is not null").select("token", "a").join(placed, "a")
    # A single set has no more in common with one whose prefix ends later than its shared prefix tokens and all tokens behind its prefix. With any linked set it shares few prefix tokens at least.
    few = F.greatest(F.when(F.col("low") < SMALL, 1).otherwise(EXTRA), F.floor(F.col("low") / EXTRA_SHARE))
    rest = F.ceil(F.col("low") * percent / F.lit(100)) - few
    postings = postings.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("a"))).withColumn("few", few)
    postings = postings.where("m > 1 or held >= few").withColumn("most", F.when(F.col("m") == 1, F.col("held") + rest).otherwise(F.col("high")))
    postings = postings.select("token", F.col("component").isNull().alias("alone"), F.coalesce("component", F.lit(0).cast("long")).alias("comp"), F.col("a").alias("gid"), "low", "high", F.col("most").cast("long").alias("most"), "last")
    crossed = postings.repartition(width, "token").sortWithinPartitions("token", "alone", "comp").mapInArrow(_crossed(percent), PAIRS)
    pairs = saved(named(crossed), "pairs")
    for done in (shared, names, of):
        discard(done)
    sized = saved(with_sizes(pairs), "sized")
    asked = pairs.select(F.col("a").alias("grp")).union(pairs.select("b")).distinct()
    sets = sets_of(asked.join(members, "grp", "left").select(F.coalesce("sig", "grp").alias("sig")))
    spent += [pairs, links, sets, members, sized]
    links = saved(links.union(compared(bounded(sized, sets), sets, False, False)), "links")
    spent.append(links)
    # Roots with members, then members with members, of what isn't connected yet.
    for which, all_queries in (("core", False), ("cores", True)):
        of = components(links)
        left = sized.where(which).select("home", "query", "cores").join(of.select(F.col("sig").alias("home"), F.col("component").alias("ca")), "home", "left").join(of.select(F.col("sig").alias("query"), F.col("component").alias("cb")), "query", "left")
        left = saved(left.where("ca is null or cb is null or ca != cb").select("home", "query", "cores"), "left")
        spent += [of, left]
        if left.isEmpty():
            break
        links = saved(links.union(compared(left, sets, all_queries, True)), "links")
        spent.append(links)
        if left.where("cores").isEmpty():
            break

    edges = linked_to.select(F.col("sig").alias("a"), F.col("pivot").alias("b")).union(links).where("a != b").distinct()
    comps = connected_components(numbered(edges))
    # The components are saved by now, and only base and reps are read from here on.
    for done in (*spent, linked_to, groups):
        discard(done)
    return _labelled(rows, reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component")))


def _labelled(rows: DataFrame, classes: DataFrame) -> DataFrame:
    right = classes.select(F.col("sig").alias("_sig"), "component")
    out = rows.join(right, F.col("sig") == F.col("_sig"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
