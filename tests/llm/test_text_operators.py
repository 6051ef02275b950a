"""Text operators on a table of odd rows, on an empty one, and against brute force or their SQL."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
from compare import duck_rows, spark_rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from lathe.llm import queries  # noqa: E402
from lathe.llm.chat import conversation_digests, escaped, format_turns, probe, unescaped  # noqa: E402
from lathe.llm.decontaminate import contamination  # noqa: E402
from lathe.llm.exact import exact_duplicates  # noqa: E402
from lathe.llm.jaccard import jaccard_components, may_link, places, shingle_set  # noqa: E402
from lathe.llm.language import identify  # noqa: E402
from lathe.llm.mixing import mix  # noqa: E402
from lathe.llm.quality import judge_quality  # noqa: E402
from lathe.llm.secrets import Scanner, secret_digests  # noqa: E402
from lathe.llm.sharding import shard_documents  # noqa: E402
from lathe.llm.urls import REJECTED_WORDS, judge_urls, rejected_sites, signs  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, hub string, n int, chunk string, _id long"
random.seed(7)
WORDS = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 7))) for _ in range(300)]
BASE = [random.choice(WORDS) for _ in range(120)]
ITEM = [random.choice(WORDS) for _ in range(30)]
LONG = " ".join(random.choice(WORDS) for _ in range(30_000))


def _made():
    texts = [None, "", " ", " \n\t ", "one", "One", "a b c d", "A b c d", "a b c d e", "%%% 123 ...", " ".join(BASE), " ".join(BASE), "\n".join(BASE), LONG, LONG + " tail", "é" * 50, "x" * 9000 + " y"]
    for k in range(6):
        edited = list(BASE)
        for _ in range(k):
            edited[random.randrange(120)] = "edit"
        texts.append(" ".join(edited))
    texts.append(" ".join(WORDS[:40] + ITEM + WORDS[40:80]))
    texts.append(" ".join(ITEM[:27]))
    texts.append(" ".join(ITEM[:10]))
    texts += [f"token = {'ab' * 10} und AKIA{'Z9' * 10} {i}" for i in range(3)]
    texts += [" ".join(random.choice(WORDS) for _ in range(random.randint(1, 60))) for _ in range(60)]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "c")[i % 4], len(t or ""), 1, "h", 1, "c", 1) for i, t in enumerate(texts)]
    return rows + [rows[10], rows[10], (None, "null id text here now", None, None, 0, 1, "h", 1, "c", 1), (None, None, "en", "a", 0, 1, "h", 1, "c", 1)]


ROWS = _made()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(ITEM)), (2, "a b c d"), (3, None), (4, ""), (5, " ".join(ITEM * 2)), (1, " ".join(ITEM))], "item_id long, text string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


ORACLES = queries.oracle_sql()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, name, sf):
    got = spark_rows(queries.queries()[name](spark, f"/root/testdata/{sf}"))
    assert got == duck_rows(duck(sf), ORACLES[name])


def test_secrets_against_regexes(odd, empty):
    rules = {"assign": re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    scanner = Scanner()

    def reference(t):
        keep = {"assign": lambda m: len(m[1]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
        return sorted((m.start(), k, m.end()) for k, (name, r) in enumerate(rules.items()) for m in r.finditer(t) if keep[name](m))

    parts = ["token", "=", ":", " ", '"', "'", "secret", "passWord", "api_key", "abc", "abcdef", "é", "AKIA", "AKIAABCD", "ABCDEFGH", "0123456789ab", "\n", "-", "xoxb-"]
    for _ in range(5000):
        t = "".join(random.choice(parts) for _ in range(random.randint(1, 16)))
        assert [x for x in scanner.scan(t.encode()) if x[1] < 3] == reference(t), t
    rows = {r.doc_id: r for r in secret_digests(odd).collect() if r.doc_id is not None}
    for i, t, *_ in ROWS:
        if i is not None:
            want = ",".join(f"{list(rules)[k]}:{a}:{b}" for a, k, b in reference(t or ""))
            assert rows[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert secret_digests(odd).count() == odd.count() and secret_digests(empty).count() == 0
    kinds = {scanner.rules[k][0] for _, k, _ in scanner.scan(b"ghp_" + b"a1" * 18 + b" eyJabcdefgh.eyJabcdefgh.abcdefgh xoxb-1234567890 -----BEGIN RSA PRIVATE KEY-----")}
    assert {"github", "jwt", "slack", "pem"} <= kinds


def test_quality_keeps_good_and_drops_bad(spark, odd, empty):
    docs = spark.createDataFrame([(i, " ".join(random.choice(WORDS) for _ in range(50)) if i % 2 else " | ".join(random.choice(WORDS) for _ in range(50)) + "###", "en", f"s{i % 5}", 0, 1, "h", 1, "c", 1) for i in range(400)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    rows = judge_quality(docs, labels).collect()
    held = [r for r in rows if r.doc_id >= 200]
    assert sum(r.kept == bool(r.doc_id % 2) for r in held) >= 0.95 * len(held)
    assert judge_quality(odd, labels).count() == odd.count() and judge_quality(empty, labels).count() == 0
    none = labels.limit(0)
    assert judge_quality(odd, none).where("quality is null").count() == 0


def test_urls_against_rules(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.COM/en/7?x", "https://example.com/en/8", "http://example.com/en", "x://xexample.net/de/8", "x://www.example.net/de/81#f", "x://example.net/de/9", "x://ORG/es/", "x://org?/es/", "x://free-bets.example.net/fr/1"]
    pages = spark.createDataFrame([(i, u, "html", "host") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in judge_urls(pages).collect()}
    assert [got[i].rule for i in range(len(urls))] == [None, None, None, None, "example.com/en/7", "com/en/", None, "net/de/", "example.net/de/8", "net/de/", "org/es/", None, None]
    assert (got[4].host, got[4].path, got[11].host, got[11].path, got[0].host, got[2].path) == ("a.example.com", "/en/7", "org", "", "", "")
    assert {got[i].verdict for i in range(len(urls))} <= {"allow", "block"} and got[5].verdict == "block" and got[4].verdict == "allow"
    assert judge_urls(pages.limit(0)).count() == 0
    many = spark.createDataFrame([(i, f"http://{random.choice(WORDS)}.{'free-bets' if i % 3 == 0 else 'news'}.example.info/{i}") for i in range(600)], "page_id long, url string")
    rows = judge_urls(many).collect()
    assert sum((r.verdict == "block") == (r.page_id % 3 == 0) for r in rows) >= 0.95 * len(rows)


def test_urls_learn_unlisted_words_from_pages(spark):
    """Sites that only their pages tell teach the models a word of hosts that no list has; it is found on sites whose pages show nothing."""
    prose = lambda: " ".join(random.choice(WORDS) for _ in range(30))
    spam = lambda: f"<html><p>{prose()} Casino {prose()} <b>POKER</b>, bets {prose()}</p>"
    number = lambda most: random.randint(0, most)
    site = lambda word: f"http://{random.choice(WORDS)}-{word}{number(99)}.example.info/{number(9999)}"
    rows = [(i, site(random.choice(WORDS)), f"<p>{prose()}</p><script>casino poker bets casino</script>") for i in range(2000)]
    rows += [(i, site("jackpot"), spam()) for i in range(2000, 2300)]
    # Never labelled: hosts of their own with the word, whose pages can't be read.
    rows += [(i, site("jackpot").replace("-", f"{random.choice(WORDS)}-", 1), random.choice((None, "", "  "))) for i in range(3000, 3100)]
    # Few of a large site's pages show signs: it stays.
    rows += [(i, f"http://press.example.info/{random.choice(WORDS)}/{number(9999)}", spam() if i % 20 == 0 else prose()) for i in range(4000, 4100)]
    assert not any(w in u for _, u, _ in rows for w in REJECTED_WORDS)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.verdict for r in judge_urls(pages).collect()}
    blocked = lambda ids: sum(got[i] == "block" for i in ids) / len(ids)
    assert len(got) == len(rows) and blocked(range(3000, 3100)) >= 0.95 and blocked(range(2000, 2300)) >= 0.95
    assert blocked(range(2000)) <= 0.02 and blocked(range(4000, 4100)) <= 0.02
    # Without pages there is nothing to learn from.
    assert judge_urls(pages.drop("html")).where("verdict = 'block'").count() == 0


def test_signs_and_sites_against_counting(spark):
    texts = [(None, 0), ("", 0), ("casino POKER xxx", 3), ("casinos apoker xxx1", 0), ("<p title='casino'>bets</p>", 1), ("<SCRIPT>casino</script>loan<style>pills</style >", 1), ("<script>casino", 0), ("a <!-- poker --> b <!-- bets", 0), ("porn<", 1), ("<script>" * 50_000, 0), ("<" * 200_000 + "casino", 0), ("casino " * 100_000, 100_000)]
    got = spark.createDataFrame(list(enumerate(t for t, _ in texts)), "i int, html string").select("i", signs(F.col("html")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: n for i, (_, n) in enumerate(texts)}
    pages = [(random.choice(["", "a", "b", "c.d", "e", "f", "g"]), random.random() < 0.45) for _ in range(60)] + [("one", True), ("two", False)]
    rate = sum(s for _, s in pages) / len(pages)
    of = {h: [s for x, s in pages if x == h] for h, _ in pages if h}
    want = {h for h, s in of.items() if sum(s) and (sum(s) + 0.5 * rate) / (len(s) + 0.5) >= 0.5}
    frame = spark.createDataFrame(pages, "host string, shown boolean")
    assert {r.host for r in rejected_sites(frame).collect()} == want and "one" in want
    assert rejected_sites(frame.limit(0)).count() == 0


def test_url_models_against_counting(spark):
    """Scores of many different URLs are those of models that count every context by itself, whatever is broadcast."""
    made = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(20)) for _ in range(1500)]
    urls = [f"x://{'free-bets' if i % 3 == 0 else 'news'}.{t[:8]}.info/{t[8:]}" for i, t in enumerate(made)]
    pages = spark.createDataFrame([*enumerate(urls), (9999, urls[7])], "page_id long, url string").repartition(4)
    texts = [u[4:] for u in urls] + [urls[7][4:]]
    held = [r.h for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", (F.pmod(F.xxhash64("t"), F.lit(5)) == 0).alias("h")).orderBy("i").collect()]
    joint, context = (Counter(), Counter()), (Counter(), Counter())
    for t, h in zip(texts, held, strict=True):
        # Random hosts may hold a listed word as well.
        bad = any(w in t.split("/")[0] for w in REJECTED_WORDS)
        for i in range(0 if h else len(t)):
            for k in range(6):
                before = ("^" * 5 + t)[i + 5 - k : i + 5]
                joint[bad][before, t[i]] += 1
                context[bad][before] += 1

    def logs(t, c):
        total = 0
        for i in range(len(t)):
            p = 1 / 256
            for k in range(6):
                before = ("^" * 5 + t)[i + 5 - k : i + 5]
                p = (joint[c][before, t[i]] + 4 * p) / (context[c][before] + 4)
            total += math.log(p)
        return total / len(t)

    want = {i: logs(t, 0) - logs(t, 1) for i, t in zip([*range(1500), 9999], texts, strict=True)}
    everything = {r.page_id: r for r in judge_urls(pages).collect()}
    assert len(everything) == 1501 and all(abs(everything[i].score - want[i]) < 1e-9 for i in want)
    few = {r.page_id: r for r in judge_urls(pages, hot=100).collect()}
    assert len(few) == 1501 and all(abs(few[i].score - want[i]) < 1e-9 for i in want)
    assert few[7].score == few[9999].score and all(everything[i].verdict == few[i].verdict for i in want)


def test_language_on_held_out_rows(spark, odd, empty):
    vocab = {"en": ["the", "and", "house", "water", "through"], "de": ["der", "und", "haus", "wasser", "durch"], "fr": ["le", "et", "maison", "eau", "travers"]}
    rows = [(i, " ".join(random.choice(vocab[lang]) for _ in range(20)), lang, "s", 0, 1, "h", 1, "c", 1) for i in range(300) for lang in [("en", "de", "fr")[i % 3]]]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in identify(docs).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in rows)
    found = {r.doc_id: r for r in identify(odd).collect() if r.doc_id is not None}
    for i, t, *_ in ROWS:
        if i is not None:
            assert (found[i].lang_pred == "und") == (not any(ch.isalpha() for ch in t or ""))
    assert identify(empty).count() == 0
    assert {r.lang_pred for r in identify(docs.withColumn("lang", docs.lang.substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang")).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """More languages than 64, the rarest too; and documents with letters stay where no row has a language."""
    r = random.Random(3)
    vocab = [["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for _ in range(70)]
    rows = [(i, " ".join(r.choice(vocab[k]) for _ in range(20)), f"l{k:02}", "s", 60) for i, k in enumerate(k for k in range(70) for _ in range(24 if k < 66 else 12))]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    got = {x.doc_id: x.lang_pred for x in identify(spark.createDataFrame(rows, columns)).collect()}
    assert len(got) == len(rows) and all(got[i] == lang for i, _, lang, *_ in rows)
    plain = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "12 %", None, "s", 4), (3, None, None, "s", 0)], columns)
    assert [x.doc_id for x in corpus_pipeline.language(spark, plain, "").collect()] == [1]


def test_contamination_against_all_windows(odd, items, empty):
    benchmark = {1: shingles(" ".join(ITEM)), 2: shingles("a b c d"), 5: shingles(" ".join(ITEM * 2))}
    want = {}
    for i, t, *_ in ROWS:
        sh = shingles(t)
        for item, other in benchmark.items():
            for s in range(max(1, len(sh) - len(other) + 1)):
                a, b = Counter(sh[s : s + len(other)]), Counter(other)
                both = sum((a & b).values())
                if both and 100 * both >= 80 * sum((a | b).values()):
                    want.setdefault(i, set()).add(item)
    got = {r.doc_id: {int(x) for x in r.item_ids.split(",")} for r in contamination(odd, items).collect() if r.contaminated}
    assert got == want and len(want) >= 3
    assert contamination(odd, items).count() == odd.count()
    assert contamination(empty, items).count() == 0 and contamination(odd, items.limit(0)).where("contaminated").count() == 0


def test_sharding_law(spark, odd, empty):
    rows = shard_documents(odd).collect()
    assert len(rows) == odd.count() and shard_documents(empty).count() == 0
    hot = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"group {i % 50}" if i % 3 == 1 else f"only {i}", "en", "s", 0, 1, "h", 1, "c", 1) for i in range(3001)], DOCS)
    hot_rows = shard_documents(hot).collect()
    for found in (rows, hot_rows):
        by = defaultdict(list)
        for r in found:
            by[r.shard].append(r.slot)
        counts = [len(by[k]) for k in range(8)]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    shards = defaultdict(set)
    for r in hot_rows:
        if r.group_size == 20:
            shards[r.text_crc32].add(r.shard)
    assert sum(len(s) == 1 for s in shards.values()) >= 0.8 * len(shards)
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by_id[0].size, by_id[15].size, by_id[15].text_crc32) == (1, 101, zlib.crc32(("é" * 50).encode()))


def test_sharding_settles_every_text(spark):
    """Groups whose documents are dealt evenly, a hot text and few single ones: only texts at a shard's edge are cut."""
    sixteen = [f"g{i // 16}" for i in range(1600)]
    sizes = [random.randint(2, 100) for _ in range(70)]
    mixed = [f"m{k}" for k, n in enumerate(sizes) for _ in range(n)]
    mixed += ["hot"] * (len(mixed) // 2) + [f"only {i}" for i in range(len(mixed) // 9)]
    for texts in (sixteen, mixed):
        rows = shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
        slots, shards = defaultdict(list), defaultdict(set)
        for r in rows:
            slots[r.shard].append(r.slot)
            shards[texts[r.doc_id]].add(r.shard)
        assert len(rows) == len(texts) and all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        assert len(shards.pop("hot", {0})) <= 4
        assert sum(len(v) > 1 for v in shards.values()) <= 7


def test_exact_duplicates_against_grouping(odd, empty):
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", t or "")].append(i)
    got = defaultdict(list)
    for r in exact_duplicates(odd).collect():
        got[r.doc_id].append(r)
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in set(ids) - {None}:
            assert all((r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for r in got[i])
    assert sum(map(len, got.values())) == odd.count() and exact_duplicates(empty).count() == 0


def test_chat_round_trip(spark):
    for t in ("<|", "<\\|", "<\\\\|im_end|>", "<|<|im_start|>", "plain", "<", "|>"):
        assert unescaped(escaped(t)) == t and "<|" not in escaped(t)
    turns = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "yo <\\|x"), (2, 0, None, None), (3, 2, "assistant", "z" * 70_000), (3, 1, "odd\nrole", "t"), (3, 1, "odd\nrole", "t"), (4, None, "assistant", "é\n"), (None, 0, "user", "q")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in conversation_digests(format_turns(df.unionByName(probe(df)))).collect()}
    for conv in (1, 2, 3, 4, None, -1):
        own = [(r or "", t or "") for c, n, r, t in sorted(turns, key=lambda x: (x[1] is not None, x[1] or 0)) if c == conv] if conv != -1 else [(r, "<|im_end|><|im_start|>assistant ok") for r in ("user", "assistant")]
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert conversation_digests(format_turns(df.limit(0))).count() == 0


def components(rows):
    sets, parent = {i: set(shingles(t)) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_jaccard_against_all_pairs(spark, odd, empty):
    want = components([(i, t) for i, t, *_ in ROWS if i is not None])
    rows = jaccard_components(odd).collect()
    assert len(rows) == odd.count() and jaccard_components(empty).count() == 0
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in rows if r.doc_id is not None)
    near = []
    for i in range(300):
        edited = list(BASE if i % 2 else BASE[::-1])
        for _ in range(random.randint(0, 4)):
            edited[random.randrange(120)] = f"w{random.randrange(9)}"
        near.append((i, " ".join(edited)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(near, "doc_id long, text string")).collect()}
    assert got == components(near)


def test_places_bound_the_overlap():
    for _ in range(300):
        a = shingle_set(" ".join(random.choice(WORDS[:40]) for _ in range(random.randint(5, 200))).encode())
        b = shingle_set(" ".join(random.choice(WORDS[:40]) for _ in range(random.randint(5, 200))).encode())
        both = len(set(a.tolist()) & set(b.tolist()))
        assert may_link(80, places(a), places(b), len(a), len(b)) or 100 * both < 80 * (len(a) + len(b) - both)


def test_mixing_reaches_targets(odd, empty):
    rows = mix(odd).collect()
    total = sum(r["size"] for r in rows)
    assert len(rows) == odd.count() and mix(empty).count() == 0
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    by = {}
    source = {i: s for i, _, _, s, *_ in ROWS}
    for r in rows:
        if r.doc_id is not None:
            by[source[r.doc_id]] = (r.source_size, r.target)
    names = sorted((s for s in by if s is not None)) + [None]
    weights, targets, full = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, {}, set()
    while True:
        left = 1.5 * total - sum(2 * by[s][0] for s in full)
        free = sum(weights[s] for s in names if s not in full)
        targets = {s: 2.0 * by[s][0] if s in full else left * weights[s] / free for s in names}
        over = {s for s in names if s not in full and targets[s] > 2 * by[s][0]}
        if not over:
            break
        full |= over
    assert all(abs(by[s][1] - targets[s]) < 1e-6 * max(1, targets[s]) for s in names)
    taken = defaultdict(int)
    for r in rows:
        taken[source[r.doc_id] if r.doc_id is not None else None if r["size"] else "a"] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in names)
    again = {(r.doc_id, r.taken, r.mix_start) for r in mix(odd).collect()}
    assert again == {(r.doc_id, r.taken, r.mix_start) for r in rows}


def test_pipeline_stages(spark, odd, empty, items, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = odd.select(*columns).where("doc_id is not null"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == columns, name
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            seen.append([r.doc_id for r in docs.collect()])
        else:
            assert out.count() == docs.count()
    texts = {i: t for i, t, *_ in ROWS if i is not None}
    language = {i for i, t in texts.items() if any(ch.isalpha() for ch in t or "")}
    assert set(seen[0]) == language
    comps = components([(i, texts[i]) for i in language])
    assert set(seen[1]) == {i for i in language if comps[i][1] == i}
    bad = {r.doc_id for r in contamination(odd, items).where("contaminated").collect()}
    assert set(seen[2]) == set(seen[1]) - bad
    assert set(seen[3]) <= set(seen[2]) and all(n <= 2 * Counter(seen[2])[i] for i, n in Counter(seen[3]).items())
    docs = empty.select(*columns)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)) if docs.columns == columns else docs
        assert docs.count() == 0
