"""Operators on small examples with hand-written results."""

import difflib
import random

from pyspark.sql import functions as F

from lathe.functions import scalar
from lathe.operators import breaker, diff, events, graph, metrics, names, review, text
from lathe.sources import parser, tree


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


def test_changed_lines(spark):
    lines = ["@@ -1,4 +1,6 @@", " def", "-", "+", "+", " ", "+"]
    assert one(spark, diff.changed_new_lines(F.col("l"), 1), l=lines) == [2, 3, 5]


def test_patch_lines(spark):
    patch = "junk\n@@ -1,2 +10,3 @@ f\n a\n+b\n-c\n\\ No newline\ndiff --git x\nlost\n@@ -5 +20 @@\n+z"
    rows = diff.patch_lines(spark.createDataFrame([("p", patch), ("q", None)], "path string, patch string")).orderBy("hunk", "idx").collect()
    assert [(r.hunk, r.idx, r.new_line) for r in rows] == [(1, 0, None), (1, 1, 10), (1, 2, 11), (1, 3, None), (1, 4, 12), (2, 0, None), (2, 1, 20)]


def test_hunk_id_is_short_and_stable(spark):
    a = one(spark, scalar.hunk_id(F.col("p"), F.col("h")), p="a.py", h="@@ -1 +1 @@")
    assert len(a) == 17 and a == one(spark, scalar.hunk_id(F.col("p"), F.col("h")), p="a.py", h="@@ -1 +1 @@")


def test_truncation(spark):
    assert one(spark, scalar.limit_lines(F.col("t"), 5), t="\n".join("abcdefgh")) == "a\nb\n... [truncated] ...\ng\nh"
    assert one(spark, scalar.limit_lines(F.col("t"), 3), t="a\nb\nc\nd") == "a\nb\nc"
    assert one(spark, scalar.keep_ends(F.col("t"), 10), t="x" * 50) == "[content too large]"
    assert len(one(spark, scalar.keep_ends(F.col("t"), 40), t="x" * 50)) == 40


def test_normalisation(spark):
    assert [one(spark, scalar.severity_from_response(F.col("s")), s=x) for x in ("Critical ", "minor", "?")] == ["blocker", "nit", "medium"]
    assert [one(spark, scalar.category_from_response(F.col("s")), s=x) for x in ("vulnerability", "docs", "?")] == ["security", "docs", "style"]
    assert [one(spark, scalar.severity_to_store(F.col("s")), s=x) for x in ("blocker", "nitpick", "odd")] == ["CRITICAL", "NIT", "ODD"]
    assert one(spark, scalar.normal_path(F.col("p")), p=" \\a\\b/ ") == "a/b"


def test_distance(spark):
    d = lambda a, b: round(one(spark, scalar.file_distance(F.col("a"), F.col("b")), a=a, b=b), 3)
    assert [d("a/b/c.py", "a/b/c.py"), d("a/b/c.py", "a/b/d.py"), d("a/c.py", "b/c.py")] == [0, 0.333, 1]


def test_chunks():
    lengths = lambda n: [b - a for a, b in text.chunk_spans("x" * n)]
    assert [lengths(n) for n in (1000, 1001, 1700, 1801)] == [[1000], [1000, 201], [1000, 900, 100], [1000, 1000, 201]]
    assert text.chunk_spans("") == [(0, 0)]


def test_lookup_and_hierarchy(spark):
    s = spark.createDataFrame([("1", "f", "a", None, "class", "x", 1, 50), ("2", "f", "b", "a.b", "method", "y", 2, 9), ("3", "f", "c", None, "function", "z", 3, 4)], "node_id string, path string, name string, qualified_name string, kind string, fingerprint string, start_line long, end_line long")
    r = spark.createDataFrame([(1, "f", "b", None, None, None), (2, "f", "b", "a.c", None, None), (3, "f", "a", None, "method", None)], "request_id long, path string, name string, qualified_name string, kind string, fingerprint string")
    assert [(x.request_id, x.node_id) for x in graph.lookup_symbols(r, s, 3).collect()] == [(1, "2")]
    assert {(x.node_id, x.parent_id) for x in graph.hierarchy(s).collect()} == {("2", "1"), ("3", "2")}
    points = spark.createDataFrame([("p", "f", 3), ("q", "f", 60)], "point_id string, path string, line long")
    assert [(x.point_id, x.node_id) for x in graph.enclosing(points, s).collect()] == [("p", "3")]


def test_findings(spark):
    rows = [(0, "f", "Bug here", 0.6, "high", True), (1, "f", " bug HERE ", 0.7, "low", True), (2, "f", "other", None, "nit", False), (3, "g", "Bug here", 0.9, "blocker", False)]
    f = spark.createDataFrame(rows, "ord long, file_path string, title string, confidence double, severity string, anchored boolean")
    kept = review.dedup_findings(review.confident(f))
    assert {(r.ord, r.position) for r in kept.collect()} == {(1, 0), (3, 3)}
    assert [(r.finding_id, r.ord) for r in review.ordered_findings(kept, 20).orderBy("number").collect()] == [("finding_1", 1), ("finding_2", 3)]


def test_greedy_budget_against_brute_force(spark):
    """Packs of one item up to thousands, with ties, sizes of zero, nothing that fits and no size at all."""
    made = random.Random(3)
    rows = []
    for pack in [*range(60), None]:
        for k in range(made.choice((1, 3, 20, 400)) if pack != 7 else 6000):
            size = None if k % 31 == 30 else made.choice((0, 5, made.randint(1, 40), made.randint(1, 300))) + (1000 if pack == 5 else 0)
            rows.append((pack, made.randint(0, 9), made.choice((None, 1, 2)), size, f"i{made.randint(0, 999)}"))
    items = spark.createDataFrame(rows, "pack int, a int, b int, size int, item_id string").repartition(5)
    for most, budget in ((4, 100), (35, 250), (200, 2000)):
        got = {r.pack: (r.n_items, r.used, r.item_ids) for r in review.greedy_budget(items, "pack", ["a", "b"], "size", most, budget).collect()}
        for pack in {r[0] for r in rows}:
            used, taken = 0, []
            for *_, size, item in sorted((r for r in rows if r[0] == pack and r[3] is not None), key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[3], r[4])):
                if len(taken) < most and used + size <= budget:
                    used, taken = used + size, [*taken, item]
            assert got[pack] == (len(taken), used, ",".join(taken)), (pack, most)
        assert len(got) == 61


def test_greedy_budget_leaves_rows_out_before_the_shuffle(spark):
    items = spark.range(1000).selectExpr("id % 2 AS pack", "id AS a", "id % 7 AS size", "CAST(id AS STRING) AS item_id")
    plan = review.greedy_budget(items, "pack", ["a"], "size", 3, 100)._jdf.queryExecution().executedPlan().toString()
    # What stands further down in the plan runs first.
    assert "WindowGroupLimit" in plan and plan.index("Partial") > plan.rindex("Exchange")


def test_greedy_budget_passes_over_what_does_not_fit(spark):
    items = spark.createDataFrame([(1, "a", 1, 50), (1, "b", 2, 70), (1, "c", 3, 40), (1, "d", 4, 10)], "pack long, item_id string, priority long, size long")
    r = review.greedy_budget(items, "pack", ["priority"], "size", 3, 100).first()
    assert (r.n_items, r.used, r.item_ids) == (3, 100, "a,c,d")


def test_breakers(spark):
    calls = [(1, t, f) for t, f in ((0, True), (1, True), (2, False), (3, True), (4, True), (5, True), (10, False), (70, False), (71, False), (72, True), (140, False), (141, False), (142, False))]
    df = spark.createDataFrame([(k, t, f, t) for k, t, f in calls], "name long, ts long, failed boolean, at long")
    r = breaker.breaker(df, "name", ["ts"], "failed", "at", threshold=3).first()
    assert (r.state, r.failures, r.trips) == ("closed", 0, 2)
    assert breaker.breaker(df.where("ts < 5"), "name", ["ts"], "failed", "at", threshold=3, decay=True).first().state == "open"


def folded(calls, threshold, wait, successes, decay):
    """The breaker call by call."""
    state, failures, good, opened, trips = "closed", 0, 0, 0, 0
    for failed, at in calls:
        if state == "open" and at - opened < wait:
            continue
        if state != "closed":
            good = good if state == "half_open" else 0
            if failed:
                state, failures, opened, trips = "open", failures + 1, at, trips + 1
            elif good + 1 >= successes:
                state, failures, good = "closed", 0, 0
            else:
                state, good = "half_open", good + 1
        elif failed and failures + 1 >= threshold:
            state, failures, opened, trips = "open", failures + 1, at, trips + 1
        else:
            failures = failures + 1 if failed else max(failures - 1, 0) if decay else 0
    return state, failures, trips


def test_breakers_of_random_histories_in_stretches(spark):
    """Stretches of any length give what a fold over all calls gives; one key has half of the calls."""
    draw, rows, at = random.Random(3), [], 0
    for i in range(6000):
        at += draw.choice((0, 0, 1, 1, 5, 40))
        rows.append((draw.choice(("hot", "hot", "hot", "a", "b", None, "c")), i, draw.random() < draw.choice((0.2, 0.5, 0.8)), at))
    df = spark.createDataFrame(rows, "k string, n long, failed boolean, at long").repartition(5)
    for threshold, wait, successes, decay, stretch in ((3, 60, 2, False, 7), (5, 30, 3, True, 50), (1, 0, 1, False, 3), (2, 500, 4, True, 1), (4, 60, 3, False, 20_000)):
        got = {r.k: (r.state, r.failures, r.trips) for r in breaker.breaker(df, "k", ["n"], "failed", "at", threshold, wait, successes, decay, stretch, 1000).collect()}
        assert got == {k: folded([(f, t) for key, _, f, t in rows if key == k], threshold, wait, successes, decay) for k in ("hot", "a", "b", "c", None)}
    plan = breaker.breaker(df, "k", ["n"], "failed", "at")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_percentile_is_nearest_index(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(10)], "k string, v double")
    r = metrics.exact_percentile(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (r.p50, r.p95) == (5.0, 9.0)


def test_events_end_at_the_terminal_one(spark):
    e = spark.createDataFrame([("w", i, k) for i, k in enumerate(("a", "workflow_completed", "b"), 1)] + [("v", 1, "a")], "workflow_id string, sequence long, event_type string")
    assert {(r.workflow_id, r.sequence) for r in events.until_terminal(e, "workflow_id").collect()} == {("w", 1), ("w", 2), ("v", 1)}


def test_tree_and_parsers(spark, tmp_path):
    files = {"src/a.py": "import os.path\nfrom .b import c\n\n\nclass A:\n    \"\"\"Doc.\"\"\"\n\n    def m(self,\n          x):\n        def inner(): pass\n        return c(x) or B()\n", "src/bad.py": "def (", "web/x.ts": "import {y} from './y'\nexport class K {\n  run(a) {\n    return new Z(a)\n  }\n}\nconst f = (a) => a\n", "node_modules/n.js": "x", ".env": "k", ".hidden": "h", "src/__init__.py": "z = 1", "README.md": "# hi"}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    scan = tree.scan_tree(spark, str(tmp_path))
    found = {r.path: r for r in tree.nodes(scan).collect()}
    assert set(found) == {".", "src", "web", "src/a.py", "src/bad.py", "src/__init__.py", "web/x.ts", ".env", "README.md"}
    assert (found["src/a.py"].type, found["src"].parent, found["README.md"].type) == ("python", ".", "UNKNOWN")
    symbols = {(r.path, r.qualified_name, r.kind) for r in parser.parse_symbols(scan).collect()}
    assert symbols == {("src/a.py", "A", "class"), ("src/a.py", "A.m", "method"), ("web/x.ts", "K", "class"), ("web/x.ts", "K.run", "method"), ("web/x.ts", "f", "function")}
    refs = {(r.path, r.what, r.target) for r in parser.parse_references(scan).collect()}
    assert {("src/a.py", "import", "os.path"), ("src/a.py", "from", "c"), ("src/a.py", "construct", "B"), ("web/x.ts", "import", "./y"), ("web/x.ts", "construct", "Z")} <= refs
    assert [r.path for r in tree.text_files(scan).collect()] == ["README.md"]


def test_repairs_and_boundaries():
    assert text.repaired('x ```json\n{"a": 1,}\n``` y') == '{"a": 1}' and text.repaired("{'a': None}") == '{"a": null}' and text.repaired("no") is None
    cut = text.cut_at_boundary("def a():\n    x = 1\n" * 20, 200)
    assert len(cut) <= 200 and cut.endswith("... [truncated] ...\n")


def test_best_name_similarity_is_over_all_seeds(spark):
    """Seeds of other files count, and a symbol without a seed in its file has a row."""
    symbols = spark.createDataFrame([("a", "x.py", "parse_file"), ("b", "y.py", "parse_line"), ("c", "y.py", "parse_file"), ("d", "z.py", None), ("e", "z.py", "")], "node_id string, path string, name string")
    seeds = spark.createDataFrame([("x.py", "run"), ("q.py", "parse_files"), ("q.py", "parse_files"), ("q.py", None)], "path string, name string")
    got = {r.node_id: r.similarity for r in names.best_name_similarity(symbols, seeds).collect()}
    want = {i: max((difflib.SequenceMatcher(None, n, s).ratio() for s in ("run", "parse_files")), default=0) if n else 0 for i, _, n in symbols.collect()}
    assert got == want and names.best_name_similarity(symbols, seeds.limit(0)).where("similarity = 0").count() == 5


def test_rank_name_similarity_has_every_symbol(spark):
    from lathe.plans import registry
    from lathe.plans.dialect import table

    d, query = "/root/testdata/sf0.001", registry.queries()["rank_name_similarity"]
    symbols, seeds = table(spark, d, "kg_symbols").collect(), {r.name for r in table(spark, d, "seeds").collect()}
    best = {n: max(round(difflib.SequenceMatcher(None, n, s).ratio(), 6) for s in seeds) for n in {r.name for r in symbols}}
    got = [(r.node_id, r.similarity) for r in query(spark, d).collect()]
    assert sorted(got) == sorted((r.node_id, best[r.name]) for r in symbols)


def test_spread_gives_free_lines(spark):
    rows = [("f", 1, 0, 2, 4), ("f", 1, 1, 2, 4), ("f", 1, 2, 2, 4)]
    got = text.spread(spark.createDataFrame(rows, "file string, hunk long, ord long, line long, n_lines long")).orderBy("ord").collect()
    assert [r.assigned for r in got] == [2, 3, 1]
