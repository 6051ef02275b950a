"""Spelling variants, nearest vectors and vector codes against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from lathe.llm import codes, neighbours, variants  # noqa: E402

random.seed(31)
DOCS = "doc_id long, text string, word string, n long, m int, kp int, below long, key long, other string, form string"
VECTORS = "vec_id long, embedding array<float>, label int, id long, list int, part int, score double, query long, vector string, error long, code string"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows):
    """Words and counts as the contract has them."""
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def variants_of(rows):
    words = counted(rows)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


@pytest.mark.parametrize("partition", [20_000, 40, 3])
def test_near_words_in_partitions_of_any_size(spark, monkeypatch, partition):
    """Few letters, so that nearly all words have near ones; a third share a long prefix, some a long suffix."""
    monkeypatch.setattr(variants, "PARTITION", partition)
    words = {"".join(random.choice("abé") for _ in range(random.randint(2, 8))) for _ in range(900)}
    words |= {"prefixprefixprefix" + "".join(random.choice("abcde") for _ in range(3)) for _ in range(100)}
    words |= {"".join(random.choice("abcde") for _ in range(3)) + "suffixsuffix" for _ in range(60)} | {"aaaaa" * 300, "aaaaa" * 300 + "a", "b" + "aaaaa" * 300}
    words = sorted(words)
    want = sorted((a, b) for a in words for b in words if a != b and one_edit(a, b))
    found = variants.near_words(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")).collect()
    assert sorted((r.word, r.other) for r in found) == want
    assert all(words[r.n] == r.word and words[r.other_n] == r.other for r in found)


def test_variants_of_odd_texts(spark):
    stems = ["".join(random.choice("abcdeéß") for _ in range(random.randint(4, 9))) for _ in range(60)]
    edited = lambda w: w[: (i := random.randrange(len(w)))] + random.choice(["", "x", w[i]]) + w[i + 1 :]
    texts = [None, "", " ", "1234 ×÷×÷× ÀÉÎÕÜ Àéîõü", "x" * 5000, "İstanbul straße STRASSE Σigma"]
    texts += [" ".join(random.choice([w, w, w, edited(w), w.upper()]) for w in random.choices(stems, k=random.randint(1, 80))) for _ in range(120)]
    texts.append("-".join(random.choice(stems) for _ in range(40_000)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "anders anders anderx"), (7, texts[7]), (7, texts[7])]
    df = spark.createDataFrame([(i, t, "w", 1, 1, 1, 1, 1, "o", "f") for i, t in rows], DOCS).repartition(3)
    got = {tuple(r) for r in variants.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = variants_of(rows)
    assert got == want and sum(w[1] is not None for w in want) > 30
    assert variants.spelling_variants(df.limit(0)).count() == 0


def test_long_texts_are_cut_between_runs(monkeypatch):
    text = " ".join("".join(random.choice("abcé") for _ in range(random.randint(1, 30))) for _ in range(400)).encode()
    want = [r for found in variants.runs(text) for r in found]
    monkeypatch.setattr(variants, "POINTS_AT_ONCE", 7)
    assert [r for found in variants.runs(text) for r in found] == want == re.findall("[a-zÀ-ÿ]+", text.decode())


def vectors(n, d=16, clusters=6):
    draw = np.random.default_rng(n)
    middles = draw.standard_normal((clusters, d))
    return [[float(np.float32(v)) for v in middles[i % clusters] + draw.standard_normal(d) * 0.8] for i in range(n)]


def cosine(a, b):
    size = max(len(a), len(b))
    a, b = ([*x, *[0.0] * (size - len(x))] for x in (a, b))
    return math.fsum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(math.fsum(x * x for x in a)) / math.sqrt(math.fsum(x * x for x in b))


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 1, 1, 0.0, 1, "v", 1, "c") for i, v, label in rows], VECTORS)


def odd_vectors():
    rows = [(i, v, i % 3 if i % 7 else None) for i, v in enumerate(vectors(600))]
    rows += [(1000 + i, rows[50][1], 4) for i in range(40)]  # a frequent vector; 1000 asks
    rows += [(2000, None, 1), (2050, [0.0] * 16, 1), (2100, [1.0, None] + [0.0] * 14, 1), (2150, [float("nan")] * 16, 1), (2200, [float("inf")] + [0.0] * 15, 1), (2250, [], 1), (2300, [1.0, 2.0, 3.0], 2), (2350, [3e38] * 16, 2), (2400, [1e-30] * 16, 2)]
    return rows + [rows[10], rows[10], rows[100], (None, rows[3][1], 1)]


def test_nearest_vectors_against_all(spark):
    rows = odd_vectors()
    good = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    found = defaultdict(list)
    for r in neighbours.nearest_vectors(table(spark, rows).repartition(4)).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    queries = [(i, v) for i, v in good if i % 50 == 0]
    assert set(found) == {i for i, _ in queries}
    by, hit = dict(good), 0
    for q, v in queries:
        got = sorted(found[q])
        assert [k for k, _, _ in got] == [1, 2, 3, 4, 5]
        assert all(abs(s - cosine(by[x], v)) < 1e-12 and x != q for _, x, s in got)
        assert got == [(k + 1, *t) for k, t in enumerate(sorted(((x, s) for _, x, s in got), key=lambda t: (-t[1], t[0])))]
        want = sorted((-cosine(w, v), x) for x, w in good if x != q)[:5]
        hit += len({x for _, x in want} & {x for _, x, _ in got})
    assert hit >= 0.9 * 5 * len(queries)
    # Equal vectors come by their ids, whichever of them asks.
    assert [x for _, x, _ in sorted(found[1000])] == [50, 1001, 1002, 1003, 1004] and [x for _, x, _ in sorted(found[50])] == [1000, 1001, 1002, 1003, 1004]


def test_nearest_vectors_of_small_tables(spark):
    few = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 1.0], 1)]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest_vectors(table(spark, few)).collect())
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert neighbours.nearest_vectors(table(spark, few[:1])).count() == 0
    assert neighbours.nearest_vectors(table(spark, few[1:])).count() == 0
    assert neighbours.nearest_vectors(table(spark, few).limit(0)).columns == ["query_id", "rank", "vec_id", "score"]


def test_abandoned_candidates_are_far(monkeypatch):
    """Nearly no candidate within the bound is abandoned, and of those beyond it most are before all dimensions are read."""
    draw = np.random.default_rng(3)
    x, q = (neighbours.unit(draw.standard_normal((n, 64)) @ np.diag(np.linspace(2, 0.2, 64))) for n in (4000, 100))
    turn = neighbours.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    true = 2 - 2 * q @ x.T
    bound = np.sort(true, axis=1)[:, 4]
    i, j, read = neighbours.scanned(np.array_split(q @ turn, 4, axis=1), np.array_split(x @ turn, 4, axis=1), bound)
    near = {(int(a), int(b)) for a, b in zip(*np.nonzero(true <= bound[:, None]), strict=True)}
    assert len(near & set(zip(i.tolist(), j.tolist(), strict=True))) >= 0.99 * len(near) and read < 0.75 * true.size * 64


def coded(rows, parts=8, entries=16, rounds=6):
    """All parts against all entries in every round, by Python's integers."""
    rows = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in rows) // parts) * parts
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[max(-codes.MOST, min(codes.MOST, math.floor(c * 4096))) for c in [*v, *[0.0] * (width - len(v))]] for _, v, _ in rows]
    w, out, errors, books = width // parts, [[] for _ in rows], [0] * len(rows), []
    for j in range(parts):
        part = [v[j * w : (j + 1) * w] for v in x]
        book = [list(p) for p in part[:entries]]
        near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), k) for k, e in enumerate(book))
        for _ in range(rounds):
            own = defaultdict(list)
            for p in part:
                own[near(p, book)[1]].append(p)
            for k, held in own.items():
                book[k] = [sum(c) // len(held) for c in zip(*held, strict=True)]
        for i, p in enumerate(part):
            d, k = near(p, book)
            out[i].append(k)
            errors[i] += d
        books += book
    of = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        of[label] += e
    digest = hashlib.sha256(",".join(str(c) for e in books for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k in o), e, of[label], digest) for (i, _, label), o, e in zip(rows, out, errors, strict=True)), key=str)


@pytest.mark.parametrize("block", [codes.BLOCK, 50])
def test_codes_against_all_comparisons(spark, block):
    rows = odd_vectors() + [(5000 + i, [random.choice([0.0, 0.25, -0.25]) for _ in range(16)], None) for i in range(200)]  # ties
    ask = lambda rows: sorted((tuple(r) for r in codes.vector_codes(table(spark, rows).repartition(3)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    rows = [(i, v and [x and max(-8000.0, min(8000.0, x)) if x is not None and math.isfinite(x) else x for x in v], label) for i, v, label in rows]
    assert ask(rows) == coded(rows)
    assert ask(rows[:5]) == coded(rows[:5])
    assert codes.vector_codes(table(spark, rows).limit(0)).count() == 0


def test_heaps_pop_only_what_the_drift_has_reached(spark):
    """Of well separated clusters few parts are compared again, with the same result."""
    df = table(spark, [(i, v, 1) for i, v in enumerate(vectors(3000, 32, 16))])
    blocks, books = codes.fitted(df)
    again = blocks.agg({"rescanned": "sum"}).first()[0]
    assert again < 0.75 * 3000 * 8
    draw = np.random.default_rng(1)
    key, entry = draw.random(500), draw.integers(0, 4, 500)
    heap = codes.Heaps.of(key, np.arange(500), entry, 4)
    drift = np.array([0.1, 0.0, 0.9, 2.0])
    part, before, rest = heap.popped(drift)
    assert set(part.tolist()) == set(np.flatnonzero(key <= drift[entry]).tolist()) and (entry[part] == before).all()
    back = rest.pushed(key[part], part, (before + 1) % 4)
    back = codes.Heaps.read(back.written(), 4)
    entry[part] = (before + 1) % 4
    want = codes.Heaps.of(key, np.arange(500), entry, 4)
    assert (back.key == want.key).all() and (back.part == want.part).all() and (back.size == want.size).all()
