"""Text operators where rows are odd: clashing names, many copies, other paths beyond a size, letters, and the models against brute force."""

import math
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline  # noqa: E402
from lathe.llm import chat, common, decontaminate, exact, jaccard, language, mixing, quality, secrets, sharding, urls  # noqa: E402

random.seed(23)
WORDS = ["".join(random.choice("abcdefghijklmn") for _ in range(random.randint(2, 8))) for _ in range(4000)]
prose = lambda n, words=WORDS: [random.choice(words) for _ in range(n)]


def grams(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)]


def linked_groups(rows):
    sets, parent = {i: set(grams(t.split())) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in ids}


def near_copies(n):
    base = prose(120)
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        edited = list(base)
        for _ in range(random.randint(0, 6)):
            edited[random.randrange(120)] = random.choice(WORDS)
        rows.append((i, " ".join(edited)))
    return rows


def test_components_by_every_path(spark, monkeypatch):
    """Many edited copies, some of which don't link with most others; then the same in small blocks, with joins for filters, and in small families."""
    rows = near_copies(260) + [(1000 + i, t) for i, t in near_copies(60)] + [(2000 + i, " ".join(prose(random.randint(1, 12)))) for i in range(60)]
    want = linked_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == want
    for name, value in (("BLOCK", 7), ("FILTER_MOST", 0), ("FAMILY", 20), ("PIVOTS", 2), ("HEAVY", 3), ("AT_ONCE", 50)):
        monkeypatch.setattr(jaccard, name, value)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == want


def test_needed_tokens_never_exceed_the_truth():
    for _ in range(3000):
        p = random.choice((75, 80, 90, 100))
        a, b = random.randint(1, 200), random.randint(1, 200)
        if 100 * min(a, b) < p * max(a, b):
            continue
        spread = lambda n: (n - random.randint(0, min(5, n - 1)), n + random.randint(0, 5))
        (la, ha), (lb, hb) = spread(a), spread(b)
        overlap = -(-p * (a + b) // (100 + p))
        truth = overlap - max(-(-p * n // 100) - int(jaccard.extra(np.int64(n))) for n in (a, b))
        assert jaccard.needed(p, *(np.array([x]) for x in (la, ha, lb, hb)))[0] <= max(truth, 1)
        assert jaccard.LOW[jaccard.size_class(a)] <= a <= jaccard.HIGH[jaccard.size_class(a)]


def test_pairs_of_linked_sets_pass_every_bound_on_their_sizes():
    """Two linked sets that share tokens with nobody else still meet, wherever either prefix ends."""
    draw, met, tight = np.random.default_rng(5), 0, 0
    for _ in range(4000):
        counts = (2 ** draw.integers(0, 9, 1024)).astype(np.uint16)
        universe = draw.choice(1 << 40, 400, replace=False).astype(np.uint64)
        n = int(draw.integers(8, 180))
        a, inside = universe[:n], int(round(n * draw.uniform(0.82, 1)))
        b = np.concatenate([a[:inside], universe[200 : 200 + int(draw.integers(0, max(1, n // 5)))]])
        both = inside
        if 100 * both < 80 * (n + len(b) - both):
            continue
        (left, _, end), (right, _, other_end) = (jaccard.prefix_tokens(np.sort(x), counts, 80) for x in (a, b))
        shared = np.intersect1d(left, right)
        sizes, rest = np.array([n, len(b)]), []
        for x in sizes:
            rest.append(len(shared) + -(-80 * int(x) // 100) - int(jaccard.extra(np.int64(x))))
        assert len(shared) >= jaccard.extra(sizes).min() and both <= (rest[0] if end < other_end else rest[1] if other_end < end else max(rest))
        tight += both > min(rest)
        k = len(shared)
        columns = [np.repeat(np.sort(shared).astype(np.int64), 2), np.ones(2 * k, bool), np.zeros(2 * k, np.int64), np.tile([1, 2], k), *(np.tile(sizes, k) for _ in range(2)), np.tile(rest, k), np.tile([end, other_end], k)]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "alone", "comp", "gid", "low", "high", "most", "last"])
        need = [x for out in jaccard._crossed(80)(iter([batch])) for x in out.column("need").to_pylist()]
        assert len(need) == k and k >= need[0]
        met += 1
    assert met > 1000 and tight > 20


def test_links_near_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.87 and just below, of many sizes, made of passages of very different frequency."""
    passages, rows = [prose(12) for _ in range(30)], []
    for k in range(700):
        words = [w for _ in range(random.randint(0, 5)) for w in passages[min(29, int(random.expovariate(0.15)))]] + prose(random.randint(10, 90))
        size = len(words) - 4
        edge = random.randint(int(0.09 * size), int(0.24 * size) + 1)
        front = random.randint(0, edge)
        other = prose(front // 2) + words[front : len(words) - (edge - front)] + prose(random.choice((0, 0, front // 3)))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    holders, sets = defaultdict(list), {i: set(grams(t.split())) for i, t in rows}
    for i, found in sets.items():
        for gram in found:
            holders[gram].append(i)
    shared = Counter((a, b) for ids in holders.values() for x, a in enumerate(ids) for b in ids[x + 1 :])
    top, close = {i: i for i in sets}, 0
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            close += 100 * n < 85 * (len(sets[a]) + len(sets[b]) - n)
            x, y = sorted((top[a], top[b]))
            top = {i: x if t == y else t for i, t in top.items()}
    assert close > 80
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == top


def test_pipeline_with_clashing_names_and_no_ids(spark, tmp_path):
    """Every stage keeps columns that are called like its own, and rows without a doc_id."""
    names = ("score", "lang_pred", "_gone", "_leaking", "_key", "_key2", "_source", "_turn", "_copy", "_end0", "hub", "size", "a.b")
    item, long = " ".join(prose(30)), " ".join(prose(30_000))
    texts = ["some plain words here now", "some plain words here now", long, long + " more", f"x y {item} z", "12 %", None, "", "one two three"]
    rows = [(i if i % 4 else None, t, "en", None if i == 8 else "s", 1, *(f"{n}{i}" for n in names)) for i, t in enumerate(texts)] + [(77, "more words to take part in it", "en", "s", 1, *(f"{n}77" for n in names))] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, schema)
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k == 4:
            assert out.count() == docs.count()
            break
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.collect())
        known = {tuple(r) for r in spark.createDataFrame(rows, schema).collect()}
        assert {tuple(r) for r in seen[-1]} <= known, name
    assert {r.text for r in seen[0]} == {t for t in texts if t and any(c.isalpha() for c in t)} | {rows[-1][1]}
    # Rows without a doc_id are no duplicates, but are judged by their text.
    assert sum(r.doc_id is None for r in seen[1]) == sum(r.doc_id is None for r in seen[0])
    assert not any(item in r.text for r in seen[2]) and len(seen[2]) == len(seen[1]) - 1
    assert sum(r.doc_id == 77 for r in seen[3]) in (2, 4)


def test_settings_stay_as_they_are(spark):
    names = [f"spark.sql.execution.arrow.max{what}PerBatch" for what in ("Records", "Bytes")]
    before = [spark.conf.get(name) for name in names]
    df = spark.createDataFrame([(1, "a b c d e f", "en", "s")], "doc_id long, text string, lang string, source string")
    for made in (secrets.secret_digests(df), language.identify(df), jaccard.jaccard_components(df), mixing.mix(df)):
        assert made.count() == 1 and [spark.conf.get(name) for name in names] == before


def test_letters_by_category(spark):
    texts = ["½ 3", "² ①", "Ⅷ", "٣ ४", "_ %", "ʰ", "字", "a"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(100 + i, "some words", "en") for i in range(8)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i][0] for i in range(8)] == ["und"] * 5 + ["en"] * 3 and all(got[i][1] == 0 for i in range(5))


def test_pieces_of_texts_lose_no_ngram(monkeypatch):
    """A row has the n-grams of its own text only, wherever the pieces are cut: the same as every text's n-grams one by one."""
    texts = ["", "a", "é字😀 ab", " ".join(prose(60)), "x" * 300, "ΩİK\t1½", " ".join(prose(400))]
    slots: dict[str, int] = {}
    for gram in sorted({f" {t.lower()} "[i : i + n] for t in texts for n in range(1, 5) for i in range(len(t.lower()) + 3 - n)}):
        h = 0
        for n, c in enumerate(gram, 1):
            h = ((h ^ (ord(c) + n)) * int(language._K)) % (1 << 64)
            h ^= h >> 31
        slots[gram] = (h >> 7) % language.DIM
    want = np.zeros((len(texts), language.DIM), np.uint8)
    for row, t in zip(want, texts, strict=True):
        padded = f" {t.lower()} "
        row[[slots[padded[i : i + n]] for n in range(1, 5) for i in range(len(padded) - n + 1)]] = 1
    for piece in (1, 2, 3, 5, 64, 1 << 16):
        monkeypatch.setattr(language, "PIECE", piece)
        assert (language.presences(texts) == want).all()


def test_language_model_is_the_kernel_ridge():
    """The folded weights score texts as landmarks' kernels, whitened, and a ridge regression do."""
    texts = [" ".join(random.choice(v) for _ in range(12)) for v in (WORDS[:40], WORDS[40:80], WORDS[80:120]) for _ in range(12)]
    langs = [name for name in ("x", "y", "z") for _ in range(12)]
    presence = language.presences(texts)
    bits = np.packbits(presence, axis=1)
    weights = language.fit(langs, bits, ["x", "y", "z"], landmarks=5)
    x = presence / np.sqrt(presence.sum(axis=1, keepdims=True))
    marks = np.vstack([x[i * 12 : i * 12 + 5] for i in range(3)])
    values, vectors = np.linalg.eigh(marks @ marks.T)
    keep = values > 1e-6 * values[-1]
    features = np.hstack([(x @ marks.T) @ (vectors[:, keep] / np.sqrt(values[keep])), np.ones((36, 1))])
    y = np.where(np.array(langs)[:, None] == np.array(["x", "y", "z"])[None, :], 1.0, -1.0)
    penalty = language.RIDGE * np.eye(features.shape[1])
    penalty[-1, -1] = 1e-9
    want = features @ np.linalg.solve(features.T @ features + penalty, features.T @ y)
    assert np.allclose(x @ weights[:-1] + weights[-1], want, atol=1e-3)


def test_site_posteriors_against_counting(spark):
    """Planted sites: rich and one-sided, sparse, without a host or path; posteriors by hand, and sparse ones near the rate."""
    rows = [("good", "a", 1)] * 60 + [("good", "b", 1)] * 2 + [("bad", "a", 0)] * 50 + [("mixed", "a", 1), ("mixed", "a", 0)] * 10 + [(None, "a", 1), ("tiny", None, 0), ("tiny2", "q", 1)]
    hosts, paths, rate = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, good int"))
    n, k = len(rows), sum(g for *_, g in rows)
    assert rate == (k + 1) / (n + 2)

    def strength(groups):
        groups = [(a, b, prior) for a, b, prior in groups if b > 1]
        v, m = sum(b * ((a / b - p) ** 2 - p * (1 - p) / b) for a, b, p in groups), sum(b * p * (1 - p) for _, b, p in groups)
        return 10_000.0 if not m or v <= 0 else min(10_000.0, max(1.0, m / v - 1))

    by_host, by_path = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for h, p, g in rows:
        for table, key in ((by_host, h), (by_path, (h, p))):
            table[key][0] += g
            table[key][1] += 1
    s = strength([(a, b, rate) for a, b in by_host.values()])
    want = {h: (a + s * rate) / (b + s) for h, (a, b) in by_host.items()}
    got = {r.host: r.host_posterior for r in hosts.collect()}
    assert set(got) == set(want) and all(abs(got[h] - want[h]) < 1e-12 for h in want)
    s = strength([(a, b, want[h]) for (h, _), (a, b) in by_path.items()])
    deep = {(r.host, r.path): r.path_posterior for r in paths.collect()}
    assert all(abs(deep[h, p] - (a + s * want[h]) / (b + s)) < 1e-12 for (h, p), (a, b) in by_path.items())
    assert got["good"] > 0.9 > 0.1 > got["bad"] and abs(got["tiny2"] - rate) < abs(got["good"] - rate)
    docs = spark.createDataFrame([(1, "text", "good", "new"), (2, None, "bad", "a"), (3, "", None, None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.judge_quality(docs, labels).collect()}
    assert found[2].evidence == found[3].evidence == 0.0 and all(0 < r.quality < 1 for r in found.values())


def test_quality_against_brute_force(spark):
    """evidence, prior, quality and kept of every document, from features, regression and posteriors that are worked out in plain Python."""
    made = random.Random(5)
    kind = lambda b: "a" if 97 <= b <= 122 or b >= 128 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b)
    good = lambda: " ".join(made.choice(("the", "House", "Wälder", "of", "1984", "rain")) for _ in range(made.randint(3, 40)))
    poor = lambda: "".join(made.choice(("| ", "### ", "the ", "99 ", "!!", "A")) for _ in range(made.randint(3, 40)))
    docs, labels = [], []
    for i in range(160):
        fine = made.random() < 0.5
        text = made.choice((None, "", "a")) if i % 20 == 19 else (good if fine != (i % 17 == 0) else poor)()
        docs.append((i, text, made.choice(("rich", "rich", "rich" if fine else "poor", f"s{i}", None)), made.choice(("p", "q", None))))
        if i % 2:
            labels.append((i, int(fine)))
    labels += [(1, 0), (3, 1), (3, 0), (5, 7), (999, 1)]
    marks = {}
    for i, q in labels:
        if q in (0, 1):
            marks[i] = max(q, marks.get(i, 0))

    def described(text):
        raw, x = text.encode(), np.zeros(quality.PLACES + 2)
        for a, b, c in zip(raw, raw[1:], raw[2:]):  # noqa: B905
            place = (ord(kind(a)) * 7919 + ord(kind(b)) * 104729 + ord(kind(c)) * 1299709) * 2654435761 % 2**32 >> 16 & quality.PLACES - 1
            x[place] += 1 / (len(raw) - 2)
        words = raw.split()
        return np.append(np.sqrt(x[:-2]), [1 - len(set(words)) / len(words) if words else 0, 1])

    known = [(described(t or ""), marks[i], h, p) for i, t, h, p in docs if i in marks]
    x, y = np.array([k[0] for k in known]), np.array([k[1] for k in known], float)
    penalty = np.full(x.shape[1], quality.RIDGE * len(x))
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(60):
        # Reweighted least squares, in place of Newton steps on the gradient.
        p = 1 / (1 + np.exp(-(x @ w)))
        weight = p * (1 - p)
        w = np.linalg.solve((x.T * weight) @ x + np.diag(penalty), x.T @ (weight * (x @ w) + y - p))
    base = math.log(y.mean() / (1 - y.mean()))
    # All labels count for the rate of a site only if a document has them.
    rate = (y.sum() + 1) / (len(y) + 2)
    of = lambda key: {k: [g for _, g, h, p in known if key(h, p) == k] for k in {key(h, p) for *_, h, p in known}}

    def shrunk(groups, prior):
        many = {k: g for k, g in groups.items() if len(g) > 1}
        v = sum(len(g) * (sum(g) / len(g) - prior(k)) ** 2 - prior(k) * (1 - prior(k)) for k, g in many.items())
        m = sum(len(g) * prior(k) * (1 - prior(k)) for k, g in many.items())
        s = 10_000.0 if not m or v <= 0 else min(10_000.0, max(1.0, m / v - 1))
        return {k: (sum(g) + s * prior(k)) / (len(g) + s) for k, g in groups.items()}

    hosts = shrunk(of(lambda h, p: h), lambda k: rate)
    paths = shrunk(of(lambda h, p: (h, p)), lambda k: hosts[k[0]])
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").repartition(3)
    got = {r.doc_id: r for r in quality.judge_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == len(docs)
    for i, t, h, p in docs:
        evidence = described(t) @ w - base if t else 0.0
        prior = paths.get((h, p), hosts.get(h, rate))
        value = 1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + evidence)))
        assert abs(got[i].evidence - evidence) < 1e-3 and abs(got[i].prior - prior) < 1e-12 and abs(got[i].quality - value) < 1e-3, i
        assert got[i].kept == (got[i].quality >= 0.5)
    assert any(got[i].prior == rate for i in got) and len({r.kept for r in got.values()}) == 2


def test_false_blocks_are_bounded(spark):
    """Accepted URLs that the models never saw are hardly ever blocked, bad ones are; long ones are scored in parts."""
    bad = lambda: f"http://{random.choice(('casino', 'free-bets'))}-zx{random.randint(0, 99)}.example.info/zx/{random.randint(0, 9999)}"
    good = lambda: f"http://{random.choice(WORDS)}.example.info/{random.choice(WORDS)}/{random.randint(0, 999)}"
    rows = [(i, good() if i % 5 else bad()) for i in range(3000)] + [(9002, "http://plain.example.info/" + "abc/" * 200_000)]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    clean = [i for i in range(3000) if i % 5]
    assert sum(got[i].verdict == "block" for i in clean) <= 0.02 * len(clean)
    assert sum(got[i].verdict == "block" for i in range(0, 3000, 5)) >= 0.95 * 600 and got[9002].host == "plain.example.info"
    parts = [(own, int(g)) for owner, gram in urls._grams(["x" * 700_000, "ab"]) for own, g in zip(owner, gram, strict=True)]
    assert Counter(o for o, _ in parts) == {0: 700_000, 1: 2} and len({g for o, g in parts if o == 0}) == urls.ORDER + 1


def test_contamination_by_length(spark):
    """Planted passages with a tenth of their words changed or none: all windows that reach the threshold are found, whatever the item's length."""
    items, rows = [], []
    for k, n in enumerate([6, 9, 15, 25, 40, 80, 160, 400, 1200] * 4):
        words = prose(n)
        items.append((k, " ".join(words)))
        edited = list(words)
        if k % 2 and n >= 40:
            for at in random.sample(range(n), max(1, n // 60)):
                edited[at] = "changed"
        rows.append((k, " ".join(prose(30) + edited + prose(20))))
    rows += [(1000 + i, " ".join(prose(200))) for i in range(100)]
    want = {}
    for i, t in rows:
        sh = grams(t.split())
        for item, other in items:
            own = grams(other.split())
            if set(sh) & set(own):
                best = max(((lambda both: both / (len(sh[s : s + len(own)]) + len(own) - both))(sum((Counter(sh[s : s + len(own)]) & Counter(own)).values())) for s in range(max(1, len(sh) - len(own) + 1))), default=0)
                if best >= 0.8:
                    want[i, item] = round(best, 6)
    got = {}
    for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("contaminated").collect():
        got.update({(r.doc_id, int(x)): r.similarity for x in r.item_ids.split(",")})
    assert set(got) <= set(want) and len(want) >= 25 and len(got) >= 0.97 * len(want)
    assert all(got[k] == want[k] for k in got if sum(d == k[0] for d, _ in got) == 1)


def test_weak_identifiers_are_told_apart(spark):
    rows = [(i, t) for i, t in enumerate(["aan bb aan cc aan dd", "bb", "x" * 20_000, "x" * 20_000, "x" * 19_999 + "y", "слово на дом", "漢字" * 5000, "漢字" * 5000, "", None, " "])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact.exact_duplicates(df).collect()}
    weak = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact.exact_duplicates(df, identifier=lambda c: F.length(c).cast("long")).collect()}
    assert plain == weak and [plain[i][0] for i in range(11)] == [0, 1, 2, 2, 4, 5, 6, 6, 8, 8, 10]
    joined = df.select("text", F.array_join(exact.chunks(exact.normalised(F.col("text"))), "").alias("j"), F.size(exact.chunks(F.col("text"))).alias("n")).collect()
    assert all(r.j == (r.text or "") for r in joined)
    long = df.limit(1).select(F.size(exact.chunks(F.lit(" ".join(prose(5000))))).alias("n")).first().n
    assert long > 20


def test_mix_is_cut_in_global_order(spark):
    """Packets by hand: sorted by virtual finish time over all sources and cut off at the budget."""
    rows = [(i, " ".join(prose(random.randint(0, 40))), f"s{i % 3}") for i in range(60)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    import hashlib

    size = {i: len(t.split()) for i, t, _ in rows}
    turn = {i: hashlib.md5(f"mix-1:{i}".encode()).hexdigest() for i in size}
    target = {s: next(got[i].target for i, _, x in rows if x == s) for s in ("s0", "s1", "s2")}
    packets = []
    for s, whole in target.items():
        queue, at = sorted((i for i, _, x in rows if x == s), key=lambda i: (turn[i], size[i])), 0
        for _ in range(2):
            for i in queue:
                most = max(1, int(whole // 1000))
                for k in range(0, size[i], most):
                    words = min(most, size[i] - k)
                    packets.append(((at + k + words) / whole, s, turn[i], size[i], k, i, words))
                at += size[i]
    left, taken = int(sum(target.values()) + 1e-6), Counter()
    for *_, i, words in sorted(packets):
        taken[i] += min(words, left)
        left -= min(words, left)
    assert {i: got[i].taken for i in size} == {i: taken[i] for i in size}


def test_long_texts_have_their_own_token_ids(spark):
    path = Path(chat.VOCABULARY)
    if not path.exists():
        pytest.skip("no vocabulary")
    codec = chat.codec(path.read_bytes())
    for text in (" ".join(prose(20_000)), "word  two\n\n three " * 9000, "ab" * 70_000, "é ü  x" * 30_000):
        assert codec.encode(text) == codec.coder.encode_ordinary(text) and len(text) > chat.PIECE
    turns = spark.createDataFrame([(1, 0, "user", "q", "x", "y"), (1, 1, "assistant", " ".join(prose(30_000)), "x", "y")], "conv_id long, turn long, role string, text string, ids string, mask string")
    row = chat.conversation_digests(chat.format_turns(turns)).first()
    assert (row.n_turns, row.loss_chars) == (2, len(turns.where("turn = 1").first().text))


def test_shards_against_texts(spark):
    rows = [(i if i % 10 else None, random.choice(["a", "b", None, ""]) if i % 3 else f"t{i % 40}") for i in range(500)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = Counter((t or "") for _, t in rows)
    shards = defaultdict(set)
    for r in found:
        shards[r.text_crc32].add(r.shard)
    assert len(found) == 500 and sorted(r.group_size for r in found) == sorted(n for n in groups.values() for _ in range(n))
    assert all(len(shards[r.text_crc32]) == r.group_shards for r in found)


def test_components_that_never_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "src long, dst long")
    assert {r.component for r in common.connected_components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        common.connected_components(chain, rounds=1)
    assert math.isfinite(len(common.shared_folder(spark)))
