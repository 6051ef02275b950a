"""Nearest vectors by cosine: inverted lists whose candidates are abandoned early, dimension by dimension.

Vectors are scaled to length 1, so the largest cosine is the least distance,
and rotated at random, so that any of their dimensions tell about all. Lists are
cut around centroids; a list's vectors are stored in packs of rotated column
blocks beside the originals. A query scans the lists around it. After each column
block the distance so far, extended to all dimensions, is tested against the
query's k-th best so far: if it is larger by more than chance allows, the
candidate is abandoned. What survives all blocks is scored exactly.

A query first scans the lists nearest to it that hold enough vectors; its k-th
best there bounds the scan of the others. How many lists a query needs isn't a
constant: it is calibrated by an exact search for a bounded sample of queries.

Equal vectors are one class: of each only the ids that can be among the nearest are
indexed, and equal queries search once. So a vector that a third of all rows hold is
no larger than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .codes import padded, usable
from .common import discard, saved, shuffle_width

#: Most lists, and most vectors on which these are fitted. Below that there are as many lists as the root of the vectors.
LISTS, SAMPLE, FITS = 1024, 16_384, 8
#: Queries that calibrate how many lists are scanned, and the share of their true neighbours that must lie there.
CHECKED, TARGET = 200, 0.97
#: How far above the bound an extended distance may lie by chance, in parts of the root of the dimensions seen (the larger, the fewer candidates are abandoned).
CHANCE = 2.1
#: Column blocks that the dimensions are cut into; vectors of a pack, queries of one, and queries whose distances are held at once.
STEPS, PACK, QUERIES, AT_ONCE = 4, 4096, 2048, 128
#: By so much rounding may change a squared distance.
ROUNDING = 1e-5


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), np.finfo(float).tiny)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), np.finfo(float).tiny)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with that of b, summed from the first dimension to the last, so that equal vectors have equal scores."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for k in range(a.shape[1]):
        dot += a[:, k] * b[:, k]
        aa += a[:, k] * a[:, k]
        bb += b[:, k] * b[:, k]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def rotation(width: int, seed: int = 12) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, lists: int, seed: int = 12) -> np.ndarray:
    """Directions around which unit vectors gather."""
    found = x[np.random.default_rng(seed).permutation(len(x))[:lists]].copy()
    for _ in range(FITS):
        own = np.concatenate([(x[i : i + 4096] @ found.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        used, starts = np.unique(own[order], return_index=True)
        found[used] = unit(np.add.reduceat(x[order], starts, axis=0))
    return found


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return padded(batch.column("vector"), width, np.float64)


def _assigned(middles: np.ndarray):
    """Each row with the list of the nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(_matrix(batch, middles.shape[1]))
            yield batch.append_column("list", pa.array((x @ middles.T).argmax(axis=1).astype(np.int32)))

    return run


def _probes(middles: np.ndarray, sizes: np.ndarray, probes: int, least: int):
    """Each query with the lists that it scans; first tells those that hold the least vectors that it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argsort(-(unit(_matrix(batch, middles.shape[1])) @ middles.T), axis=1, kind="stable")
            held = np.cumsum(sizes[near], axis=1)
            first = np.minimum((held < least).sum(axis=1) + 1, near.shape[1])
            many = np.maximum(first, probes)
            query = np.repeat(np.arange(len(near)), many)
            place = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many)
            keep = sizes[near[query, place]] > 0
            query, place = query[keep], place[keep]
            out = batch.select(["id", "vector"]).take(pa.array(query))
            yield out.append_column("list", pa.array(near[query, place].astype(np.int32))).append_column("first", pa.array(place < first[query]))

    return run


PACKS = "list int, part int, ids binary, vectors binary, turned array<binary>, bounds binary"


def _packed(turn: np.ndarray):
    """Rows in order of (list, part): the vectors of each in one row, with their rotated column blocks."""

    def pack(where: tuple[int, int], ids: list, x: list, bounds: list) -> pa.RecordBatch:
        ids, x, bounds = (np.concatenate(c) for c in (ids, x, bounds))
        blocks = np.array_split((unit(x) @ turn).astype(np.float32), min(STEPS, x.shape[1]), axis=1)
        columns = [pa.array([where[0]], pa.int32()), pa.array([where[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([[b.tobytes() for b in blocks]], pa.list_(pa.binary())), pa.array([bounds.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["list", "part", "ids", "vectors", "turned", "bounds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, kept = None, ([], [], [])
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "part")])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for i, j in zip(cuts, cuts[1:], strict=False):
                here, piece = (int(at[0, i]), int(at[1, i])), batch.slice(i, j - i)
                if here != where and kept[0]:
                    yield pack(where, *kept)
                    kept = ([], [], [])
                where = here
                for held, value in zip(kept, (piece.column("id").to_numpy(zero_copy_only=False), _matrix(piece, len(turn)), piece.column("bound").to_numpy(zero_copy_only=False)), strict=True):
                    held.append(value)
        if kept[0]:
            yield pack(where, *kept)

    return run


def _packs(rows: DataFrame, size: int, turn: np.ndarray, name: str) -> tuple[DataFrame, dict[int, int]]:
    """rows (list, id, vector, bound) in packs of about size, saved; and how many packs each list has (LISTS rows at most)."""
    counts = rows.groupBy("list").agg(F.count(F.lit(1)).alias("rows")).collect()
    parts = {r["list"]: -(-r["rows"] // size) for r in counts}
    # Lists are bounded in number, so this map is as well.
    many = F.element_at(F.from_json(F.lit("{" + ",".join(f'"{k}":{v}' for k, v in parts.items()) + "}"), "map<string,int>"), F.col("list").cast("string")) if parts else F.lit(1)
    placed = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), many).cast("int"))
    placed = placed.repartition(shuffle_width(rows.sparkSession), "list", "part").sortWithinPartitions("list", "part")
    return saved(placed.mapInArrow(_packed(turn), PACKS), name), parts


def best_of(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each owner, best first, ties to smaller ids; owners in order."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
    return order[rank < k]


def scanned(queries: list[np.ndarray], blocks: list[np.ndarray], bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, vector) that no test abandons, and how many components were read for it.

    queries and blocks are column blocks of rotated unit vectors, bound each
    query's largest squared distance of interest.
    """
    width, seen, read = sum(b.shape[1] for b in blocks), 0, 0
    i = j = so_far = None
    for q, x in zip(queries, blocks, strict=True):
        seen += x.shape[1]
        if i is None:
            dist = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T)
            read += dist.size * x.shape[1]
        else:
            read += len(i) * x.shape[1]
            step = q[i] - x[j]
            so_far = so_far + np.einsum("ij,ij->i", step, step)
        limit = (bound + ROUNDING) * (seen / width * (1 + CHANCE / seen**0.5) ** 2 if seen < width else 1) + ROUNDING
        if i is None:
            i, j = np.nonzero(dist <= limit[:, None])
            so_far = dist[i, j]
        else:
            keep = so_far <= limit[i]
            i, j, so_far = i[keep], j[keep], so_far[keep]
    return i, j, read


FOUND = "query long, vec_id long, score double"


def _scan(k: int):
    """Packs of queries beside packs of vectors of their list: the k best of each query there, if they can be among its k best at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, asked, bound = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("q_ids", np.int64), ("q_bounds", np.float64)))
                x, q = (np.frombuffer(row[c], np.float64).reshape(n, -1) for c, n in (("vectors", len(ids)), ("q_vectors", len(asked))))
                turned, q_turned = ([np.frombuffer(b, np.float32).reshape(n, -1) for b in row[c]] for c, n in (("turned", len(ids)), ("q_turned", len(asked))))
                for at in range(0, len(asked), AT_ONCE):
                    own = np.arange(at, min(at + AT_ONCE, len(asked)))
                    limit, best = bound[own].copy(), (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
                    # The bound falls as slices of the pack are scanned.
                    for start in range(0, len(ids), PACK // 4):
                        part = slice(start, start + PACK // 4)
                        i, j, _ = scanned([b[own] for b in q_turned], [b[part] for b in turned], limit)
                        j = j + start
                        if not len(i):
                            continue
                        best = tuple(np.concatenate(c) for c in zip(best, (i, cosines(q[own[i]], x[j]), ids[j]), strict=True))
                        top = best_of(*best, k)
                        best = tuple(c[top] for c in best)
                        count = np.bincount(best[0], minlength=len(own))
                        last = np.cumsum(count) - 1
                        full = count == k
                        limit[full] = np.minimum(limit[full], np.maximum(0, 2 - 2 * best[1][last[full]]))
                    if len(best[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(asked[own[best[0]]]), pa.array(best[2]), pa.array(best[1])], names=["query", "vec_id", "score"])

    return run


def _exact(asked: np.ndarray, k: int):
    """For a bounded sample of queries: the k nearest of each pack, by all dimensions, with the pack's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                score = unit(asked) @ unit(np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)).T
                most = min(k, len(ids))
                near = np.argpartition(-score, most - 1, axis=1)[:, :most]
                query = np.repeat(np.arange(len(asked)), most)
                n = len(query)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(score[query, near.ravel()]), pa.array(np.full(n, row["list"], np.int32))], names=["query", "score", "list"])

    return run


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)


def _lists_needed(index: DataFrame, asked: np.ndarray, middles: np.ndarray, k: int) -> int:
    """In how many of a query's nearest lists TARGET of the true neighbours of the sample lie."""
    found = index.select("ids", "vectors", "list").mapInArrow(_exact(asked, k + 1), "query long, score double, list int")
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "list"))).where(F.col("rank") <= k + 1)
    near = np.argsort(-(unit(asked) @ middles.T), axis=1, kind="stable")
    place = np.argsort(near, axis=1)
    # What equals the query, itself too, lies in its nearest list and would flatter the others.
    ranks = sorted(int(place[r["query"], r["list"]]) for r in top.collect() if r["score"] < 1 - 1e-9)
    return ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))) - 1)] + 1 if ranks else 1


def nearest_vectors(vectors: DataFrame, asked: str = "vec_id % 50 = 0", k: int = 5, vector: str = "embedding", lists: int | None = None) -> DataFrame:
    """The k nearest other vectors of each vector that meets a condition, by cosine.

    vectors needs vec_id and the column that vector names; other columns are ignored. Returns query_id, rank (from 1),
    vec_id, score (the cosine of the original vectors in double precision), ties to the smaller vec_id; all candidates
    if there are fewer than k. Vectors that are null, empty, zero or hold a null or non-finite component, and rows without a
    vec_id, take no part. Shorter vectors count as if zeros followed. Repeated rows count once, a vec_id is never its
    own neighbour, and one with several vectors is searched with each. An empty table gives an empty result.
    Every vector is indexed; the lists are fitted on at most SAMPLE vectors, and how many of them are scanned is calibrated
    on at most CHECKED queries, so that TARGET of their true neighbours lie there. lists overrides that number.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vector).select(F.col("vec_id").cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.exists("vector", lambda x: x != 0))
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Of equal vectors, k + 1 ids may be nearest to a query: k, and one that is its own. Equal rows leave before that.
    classes = rows.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("_n") <= k + 1).drop("_n")
    classes = saved(classes, "classes")
    count, width = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not count:
        return nothing

    def drawn(table: DataFrame, most: int) -> np.ndarray:
        """A bounded sample, the same on every run."""
        found = table.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(most).toArrow()
        return padded(found.column("vector").combine_chunks(), width, np.float64)

    middles = centroids(unit(drawn(classes, SAMPLE)), max(1, min(LISTS, round(count**0.5))))
    turn = rotation(width)
    placed = saved(classes.mapInArrow(_assigned(middles), "id long, vector array<double>, list int").withColumn("bound", F.lit(0.0)), "placed")
    index, parts = _packs(placed, PACK, turn, "index")
    sizes = np.zeros(len(middles), np.int64)
    for r in placed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    discard(placed)
    discard(classes)

    own = saved(rows.join(rows.select(F.col("id").alias("vec_id")).where(asked).distinct(), F.col("id") == F.col("vec_id"), "left_semi").distinct(), "queries")
    plain = saved(own.groupBy("vector").agg(F.min("id").alias("least")).select(F.monotonically_increasing_id().alias("id"), "vector"), "plain")
    if plain.isEmpty():
        return nothing
    probes = min(len(middles), lists or _lists_needed(index, drawn(plain, CHECKED), middles, k))
    probed = plain.mapInArrow(_probes(middles, sizes, probes, k + 1), "id long, vector array<double>, list int, first boolean")
    probed = saved(probed, "probed")

    def search(some: DataFrame) -> DataFrame:
        """The k + 1 best of each query (list, id, vector, bound) in these of its lists; every pack of a list meets every pack of its queries."""
        asked, _ = _packs(some, QUERIES, turn, "asked")
        packs = F.element_at(F.from_json(F.lit("{" + ",".join(f'"{x}":{v}' for x, v in parts.items()) + "}"), "map<string,int>"), F.col("list").cast("string"))
        spread = asked.select("list", F.explode(F.sequence(F.lit(0), packs - 1)).alias("part"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("turned").alias("q_turned"), F.col("bounds").alias("q_bounds"))
        met = index.drop("bounds").join(spread, ["list", "part"]).select("ids", "vectors", "turned", "q_ids", "q_vectors", "q_turned", "q_bounds")
        out = saved(met.mapInArrow(_scan(k + 1), FOUND), "found")
        discard(asked)
        return out

    # No squared distance between unit vectors is above 4.
    near = search(probed.where("first").select("list", "id", "vector", F.lit(4.0).alias("bound")))
    kth = _ranked(near, ["query"], k + 1).groupBy("query").agg(F.max("rank").alias("rank"), F.min("score").alias("score"))
    kth = saved(kth.select("query", F.when(F.col("rank") == k + 1, F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).otherwise(4.0).alias("bound")), "bounds")
    far = search(probed.where("not first").join(kth, F.col("id") == F.col("query")).select("list", "id", "vector", "bound"))
    best = saved(_ranked(near.union(far), ["query"], k + 1).drop("rank"), "best")
    for done in (near, far, kth, probed, index):
        discard(done)
    # Equal queries share what was found; each leaves itself out.
    asks = own.select(F.col("id").alias("query_id"), F.col("vector").alias("_vector")).join(plain.withColumnRenamed("id", "query"), F.col("_vector") == F.col("vector")).select("query_id", "query")
    out = asks.join(best, "query").where("vec_id != query_id")
    return _ranked(out, ["query_id", "query"], k).select("query_id", "rank", "vec_id", "score")
