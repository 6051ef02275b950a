"""Review operators against brute force in plain Python and on hand-written examples."""

import difflib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lathe.operators import anchor, detect, diff, graph, metrics, names, persist, rank, response, validate
from lathe.plans import registry
from lathe.sources import recorded, snippets, tree
from lathe.streaming import events as streams

random.seed(11)


def found_line(message, fix, title, lines):
    """Where a finding belongs in a hunk's lines: its code, then its names, in added lines and then in all."""
    code = []
    for block in re.findall(r"```(?:\w+)?\s*(.*?)```", message + " " + fix, re.DOTALL):
        code += [x.strip() for x in block.split("\n") if x.strip()][:3]
    code += re.findall(r"`([^`]+)`", message + " " + fix)
    code = sorted((x.strip() for x in code if 2 < len(x.strip()) < 100), key=len, reverse=True)
    names = {}
    for word in re.findall(r"\b([a-zA-Z_$][a-zA-Z0-9_$]*)\b", f"{message} {title} {fix}"):
        if len(word) >= 3 and word.lower() not in anchor.SKIP_WORDS:
            names.setdefault(word.lower(), word)
    score = lambda w: len(w) + 5 * bool(re.search("[a-z][A-Z]", w)) + 3 * ("_" in w) + 3 * w.startswith("$")
    tests = [lambda line, c=c: c in line.lstrip("+-").strip() for c in code]
    tests += [lambda line, n=n: bool(re.search(r"\b" + re.escape(n) + r"\b", line, re.IGNORECASE)) for n in sorted(names.values(), key=score, reverse=True)[:10]]
    for test in tests:
        for places in ([i for i, x in enumerate(lines) if x.startswith("+")], range(len(lines))):
            for i in places:
                if test(lines[i]):
                    return i, "content_match"
    added = [i for i, x in enumerate(lines) if x.startswith("+")]
    return (added[0] if added else 0), "fallback"


def test_anchors_against_search(spark):
    words = ["userName", "load_file", "$scope", "value", "total", "parseJson", "x", "items[0]", "return", "call", "sum"]
    files = {f"f{k}.py": [[random.choice(" +-") + " ".join(random.choice(words) for _ in range(3)) for _ in range(random.randint(1, 8))] for _ in range(random.randint(1, 3))] for k in range(12)}
    lines = [(p, h, f"h{h}", i, x) for p, hunks in files.items() for h, own in enumerate(hunks) for i, x in enumerate(own)]
    findings = []
    for k in range(120):
        message = " ".join(random.choice(["`userName`", "load_file(", "see ```py\nparseJson total\n\n```", "`x`", "TOTAL", "nothing", "$scope", "the error"]) for _ in range(3))
        findings.append((k, random.choice([*files, "gone.py"]), random.choice(["h0", "h1", "h9", None]), random.choice(["Title parseJson", "", None]), message, random.choice(["`items[0]`", None])))
    got = {r.ord: r for r in anchor.anchored(spark.createDataFrame(findings, "ord long, file_path string, hunk_id string, title string, message string, suggested_fix string"), spark.createDataFrame(lines, "path string, hunk long, hunk_id string, idx long, line string")).collect()}
    assert len(got) == 120
    for k, path, hunk, title, message, fix in findings:
        if path not in files:
            assert (got[k].method, got[k].line_in_hunk, got[k].hunk_id) == ("none", None, None)
            continue
        at = int(hunk[1:]) if hunk and int(hunk[1:]) < len(files[path]) else 0
        line, method = found_line(message, fix or "", title or "", files[path][at])
        assert (got[k].hunk_id, got[k].line_in_hunk, got[k].method) == (f"h{at}", line, method), findings[k]
    assert anchor.anchoring_counts(spark.createDataFrame([], "method string")).first().total == 0


def test_extraction_by_all_strategies(spark):
    body = '{"findings": [], "summary": "fine"}'
    rows = [("direct", body), ("fenced", f"Here:\n```json\n{body}\n```\nbye"), ("fenced", f"```\nsee {body} there\n```"), ("braces", f"Well, {body} is it"), ("literal", "x {'a': True, 'b': None} y"), ("literal", '{"a": 1,}'), ("repaired", '{"a": true,}'), ("repaired", "{'a': true}"), ("failed", "{broken"), ("failed", "nothing"), ("empty", "  "), ("empty", None), ("no_context", "There are No Code Changes here")]
    got = response.extracted(spark.createDataFrame([(i, r) for i, (_, r) in enumerate(rows)], "i int, raw string")).orderBy("i").collect()
    assert [r.strategy for r in got] == [s for s, _ in rows]
    parsed = [json.loads(r.body) if r.body else None for r in got]
    assert parsed[0] == parsed[1] == parsed[2] == parsed[3] == json.loads(body) and parsed[4] == {"a": True, "b": None} and parsed[5] == {"a": 1} and parsed[6] == parsed[7] == {"a": True}
    assert parsed[8] is parsed[9] is parsed[10] is None and parsed[12] == {"findings": [], "summary": "There are No Code Changes here"}


def test_findings_take_one_form(spark):
    raw = {"findings": [{"description": "d", "severity": " Error ", "category": "Logging", "confidence": "7", "line": "12", "evidence": {"quote": "q" * 600}, "related_symbols": [str(i) for i in range(20)], "code_examples": list("abcd")}, {"message": "m", "line_in_hunk": 0, "line": 5, "confidence": "much"}, {"title": "T", "line_hint": "x"}]}
    a, b, c = response.findings_of(spark.createDataFrame([(1, json.dumps(raw))], "k int, body string"), ["k"]).orderBy("place").collect()
    assert (a.title, a.message, a.severity, a.category, a.confidence, a.line_hint) == ("Untitled Finding", "d", "high", "observability", 1.0, 12)
    assert len(a.evidence.quote) == 500 and a.evidence.quote.endswith("...") and len(a.related_symbols) == 10 and a.code_examples == ["a", "b", "c"]
    assert (b.message, b.line_hint, b.confidence, b.severity, b.category) == ("m", 0, 0.5, "medium", "style") and (c.title, c.line_hint) == ("T", None)


def test_detectors_on_code(spark):
    code = 'from fastapi import Depends\nimport pytest\n@app.get("/x")\nasync def f(a: int):\n    try:\n        await g()\n    except ValueError:\n        raise KeyError\n    logger.info([x for x in y])\n'
    files = spark.createDataFrame([("g", "api/main.py", code), ("g", "tests/test_login.py", "import pytest\ndef test_x():\n    assert 1\n"), ("h", "a.c", "int x;")], "k string, path string, code string")
    got = {(r.k, r.name): r.confidence for r in detect.frameworks(files, ["k"]).collect()}
    # main.py and api/ in paths, an import, code, and the rest; tests the same.
    assert got["g", "FastAPI"] == 1.0 and got["g", "pytest"] == 1.0 and ("h", "FastAPI") not in got
    hits = {(r.k, r.name): (r.hits, r.confidence) for r in detect.patterns(files, ["k"]).collect()}
    assert hits["g", "async_await"] == (2, 0.6) and hits["g", "exception_handling"] == (3, 0.6) and hits["g", "logging"] == (1, 0.4) and hits["g", "comprehensions"][0] == 1 and not [k for k in hits if k[0] == "h"]
    areas = [(r.k, r.area, r.files) for r in detect.focus_areas(files, detect.patterns(files, ["k"]), ["k"]).orderBy("k", "rank").collect()]
    assert areas == [("g", "Security", 1), ("g", "API Changes", 1), ("g", "Concurrency", 0), ("g", "Test Coverage", 1), ("h", "Missing Tests", 1), ("h", "Error Handling", 0)]


def test_relevance_against_brute_force(spark):
    seeds = [("src/a/x.py", "loadFile"), ("src/b/y.py", "parse")]
    cands = [(str(k), random.choice(["src/a/x.py", "src/a/z.js", "tests/test_q.py", "docs/r.md", "k.zip", "src/b/c/d.tsx"]), random.choice(["loadFile", "load_files", "main", "_hid", "Other"]), random.choice(["function", "class", "variable"]), random.choice(["CALLS", "IMPORTS", "odd"]), random.randint(0, 6), random.choice(["", "def f():\n    if x:\n        pass", "if a \nfor b \nwhile c "])) for k in range(60)]
    df = spark.createDataFrame(cands, "item_id string, file_path string, symbol_name string, symbol_type string, relationship_type string, calls long, code_snippet string")
    seed_df = spark.createDataFrame(seeds, "path string, name string")
    similar = names.best_name_similarity(df.select(F.lower("symbol_name").alias("name")).distinct(), seed_df.select(F.lower("name").alias("name")))
    score_by = lambda w: rank.scored(rank.with_code_features(df, F.col("code_snippet")), rank.described(df.select("item_id", "file_path", "symbol_name", "symbol_type"), seed_df, similar, w), ["item_id"], w)
    got = {r.item_id: r.score for r in score_by(rank.Weights(threshold=0.0)).collect()}

    def score(path, name, kind, relation, calls, code):
        parts, low = path.split("/"), name.lower()
        distance, similar = 1.0, 0.0
        for s, _ in seeds:
            other, common = s.split("/"), 0
            for a, b in zip(parts[:-1], other[:-1], strict=False):
                if a != b:
                    break
                common += 1
            distance = min(distance, 1 - common / max(len(parts), len(other)))
            similar = max(similar, len(set(parts) & set(other)) / len(set(parts) | set(other)))
        ratio = max(difflib.SequenceMatcher(None, low, n.lower()).ratio() for _, n in seeds)
        total = 0.9 * (low in {n.lower() for _, n in seeds}) + (0.7 if path in {s for s, _ in seeds} else 0.5 * (1 - distance))
        total += 0.6 * ({"CALLS": 0.8, "IMPORTS": 0.5}.get(relation, 0) + (min(0.2, 0.05 * calls) if calls else 0))
        total += 0.1 * path.endswith(".md") + 0.15 * path.startswith("tests/") + 0.1 * (low == "main" or kind == "class" or (kind == "function" and not name.startswith("_") and "def " in code))
        total += (0.2 * ratio if ratio > 0.3 else 0) + (0.15 * similar if similar > 0.3 else 0)
        lines = code.split("\n")
        busy = min(1, sum(any(w in x for w in ("if ", "for ", "while ")) + ("def " in x) for x in lines) / len(lines)) if code else 0
        total -= 0.05 * (busy > 0.7)
        return max(0, min(1, total * {".md": 0.3}.get(path[-3:], 1.0)))

    assert len(got) == 60 and all(abs(got[k] - score(*rest)) < 1e-9 for k, *rest in cands)
    heavy = rank.Weights(threshold=0.5, extensions={".py": 0.0})
    assert all(not r.file_path.endswith(".py") and r.score >= 0.5 for r in score_by(heavy).collect())


def test_name_index_gives_what_all_pairs_give(spark, monkeypatch):
    """The same ratios as of all pairs, from few of them; also with many small indexes and parts."""
    draw = lambda: "".join(random.choice("abcdefgh_AZé") for _ in range(random.randint(1, 14)))
    seeds, symbols = [draw() for _ in range(150)], [draw() for _ in range(300)] + ["", None, "\U0001f600x"]
    symbols += [s[:-1] + "q" for s in seeds[:50]] + seeds[:5]
    want = {s: max(difflib.SequenceMatcher(None, s, t).ratio() for t in seeds) for s in symbols if s}
    df, others = spark.createDataFrame([(s,) for s in symbols], "name string"), spark.createDataFrame([(s,) for s in seeds], "name string")
    found = names.name_similarities(df, others)
    got = found.collect()
    assert {r["_name"]: r.similarity for r in got} == want
    # Of random names of few letters; real ones differ more.
    assert sum(r.compared for r in got) < 0.35 * len(want) * len(set(seeds))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    monkeypatch.setattr(names, "INDEX", 40)
    assert {r["_name"]: r.similarity for r in names.name_similarities(df, others).collect()} == want
    assert {r.name: r.similarity for r in names.best_name_similarity(df, others.limit(0)).collect()} == dict.fromkeys(symbols, 0.0)


def test_ranked_items_stand_in_order(spark):
    rows = [("p", "a", 0.5, False, 2), ("p", "b", 0.5, True, 3), ("p", "c", 0.9, False, 5), ("p", "d", 0.5, True, 1), ("q", "e", 0.1, False, 1), ("p", "f", 0.5, False, 2)]
    placed = rank.in_score_order(spark.createDataFrame(rows, "pack string, item_id string, score double, is_seed boolean, priority int"), "pack").collect()
    assert [r.item_id for r in sorted(placed, key=lambda r: (r.pack, r.place))] == ["c", "d", "b", "a", "f", "e"]


def test_texts_stay_out_of_packs(spark):
    """No exchange of the pack family carries texts: lengths and flags come from where the documents are."""
    for name in ("pack_greedy_budget", "pack_prefix_budget", "prompt_budget", "budget_estimate", "pack_totals", "validate_pack", "pipeline_quality_ratios", "rank_score"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        for line in plan.split("\n"):
            assert not re.search(r"(Exchange|Join|Sort\b).*\b(text|code_snippet)#", line), (name, line)


def test_validation(spark):
    rows = spark.createDataFrame([("a/b.py", "renamed", "old", 1, 0, [("h", 5), ("h", 9)]), (" / ", "odd", "old", 1, -1, [("", 9), ("h", 5)]), ("c", "added", None, 0, 0, [])], "file_path string, change_type string, previous_filename string, additions int, deletions int, hunks array<struct<hunk_id:string,new_start:int>>")
    found = [r.p for r in rows.select(validate.patch_problems(rows).alias("p")).collect()]
    assert found[0] == found[2] == [] and found[1] == ["empty path", "unknown change type", "previous name of a file that isn't renamed", "hunks out of order", "hunk without an id", "negative count"]
    assert validate.checked(rows, validate.patch_problems(rows)).count() == 2
    with pytest.raises(Exception, match="invalid row"):
        validate.checked(rows, validate.patch_problems(rows), strict=True).collect()
    spans = spark.createDataFrame([("p", "n", 5, 4), ("p", " ", 1, 1), ("p", "n", 1, 1)], "p string, n string, a int, b int")
    assert [r.x for r in spans.select(validate.span_problems(F.col("p"), F.col("n"), F.col("a"), F.col("b")).alias("x")).collect()] == [["ends before it starts"], ["empty name"], []]
    lines = spark.createDataFrame([([3, 1, 3],)], "l array<int>").select(validate.changed_line_list(F.col("l")).alias("l")).first().l
    assert lines == [1, 3]
    findings = spark.createDataFrame([(1, 0, "finding_1", 0.9), (1, 1, "finding_2", 0.1), (2, 0, "finding_2", 0.1), (2, 1, "finding_2", 0.1)], "k int, place int, finding_id string, confidence double")
    reviews = spark.createDataFrame([(1, "a summary that is long enough", 2, 1), (2, "short", 3, 1), (3, "no findings at all, but a summary", 0, 0)], "k int, summary string, total_findings int, high_confidence_findings int")
    assert {r.k: r.problems for r in validate.review_problems(findings, reviews, "k").collect()} == {1: [], 2: ["ids repeat", "ids out of sequence", "short summary", "total", "high confidence total"], 3: []}


def test_recorded_sources(spark, tmp_path):
    (tmp_path / "details").mkdir()
    (tmp_path / "details/1.json").write_text(json.dumps({"id": 7, "number": 3, "title": "t", "user": {"login": "u", "id": 1, "type": "User"}, "head": {"sha": "a" * 40, "repo": {"full_name": "o/r"}}}))
    (tmp_path / "details/2.json").write_text("not json")
    row = recorded.pull_requests(spark, str(tmp_path / "details")).first()
    assert (row.number, row.head.repo.full_name, recorded.pull_requests(spark, str(tmp_path / "details")).count()) == (3, "o/r", 1)
    (tmp_path / "files").mkdir()
    one = {"sha": "1", "filename": "a.py", "status": "added", "additions": 1, "patch": "@@ -0,0 +1 @@\n+x"}
    (tmp_path / "files/page1.json").write_text(json.dumps([one, {"sha": "2", "filename": "b.png", "binary": True}]))
    (tmp_path / "files/page2.json").write_text(json.dumps([one, {"sha": "3", "filename": "c.py", "status": "renamed", "previous_filename": "d.py"}]))
    files = {r.filename: r for r in recorded.pull_request_files(spark, str(tmp_path / "files")).collect()}
    assert set(files) == {"a.py", "b.png", "c.py"} and files["a.py"].page == "page1.json" and files["b.png"].binary and files["c.py"].previous_filename == "d.py"
    (tmp_path / "x.diff").write_text("diff --git a/p.py b/p.py\nindex 1..2\n--- a/p.py\n+++ b/p.py\n@@ -1 +1 @@\n-a\n+b\ndiff --git a/q.py b/q.py\ndeleted file mode 100644\n--- a/q.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\ndiff --git a/r.png b/r.png\nBinary files a/r.png and b/r.png differ\n")
    diffs = {r.path: r.patch for r in recorded.raw_diffs(spark, str(tmp_path / "x.diff")).collect()}
    assert set(diffs) == {"p.py", "q.py", "r.png"} and diffs["p.py"].startswith("@@ -1 +1 @@\n-a\n+b") and diffs["r.png"] is None


def test_snippets(spark):
    files = spark.createDataFrame([("a/b.py", 20, bytearray("".join(f"line {i}\n" for i in range(1, 101)).encode())), ("c.png", 3, bytearray(b"abc")), ("d.py", 4, bytearray(b"a\x00b\n")), ("e.py", 99, bytearray(b"x\n")), ("l.py", 4, bytearray("é\n".encode("latin-1"))), ("w.py", 4, bytearray(b"w" * 20_000 + b"\nz"))], "path string, length long, content binary")
    asked = [(1, "./a/b.py", 3, 5, None), (2, "/a/b.py", None, None, None), (3, "a/../a/b.py", 98, None, 10), (4, "../a/b.py", 1, 2, None), (5, "c.png", 1, 1, None), (6, "d.py", 1, 1, None), (7, "e.py", 1, 1, None), (8, "a/b.py", 500, None, None), (9, "gone.py", 1, 1, None), (10, "l.py", 1, 1, None), (11, "w.py", 1, 2, None), (12, "a/b.py", 100, 200, None)]
    got = {r.ord: r for r in snippets.snippets(spark.createDataFrame(asked, "ord int, file_path string, start_line int, end_line int, max_lines int"), files, most_bytes=50).collect()}
    assert got[1].content == "line 3\nline 4\nline 5\n" and (got[2].first_line, got[2].last_line) == (1, 51) and got[3].content == "line 98\nline 99\nline 100\n" and (got[12].first_line, got[12].last_line) == (100, 100)
    assert [got[k].error for k in (4, 5, 6, 7, 8, 9)] == ["not found", "binary file type", "binary file", "file too large", "starts behind the end", "not found"] and len(got) == 12
    assert got[10].content == "é\n" and got[11].content.startswith("w" * 9980 + "... [line truncated]\n") and got[11].content.endswith("z")


def test_upserts_keep_what_isnt_updated(spark):
    schema = "repository_id int, pr_number int, title string, head_sha string, base_sha string, state string, updated_at int"
    stored = spark.createDataFrame([(1, 1, "kept", "a", "b", "closed", 1), (1, 2, "other", "a", "b", "open", 1)], schema)
    reviews = spark.createDataFrame([(1, 1, "c", "d", 5), (1, 1, "e", "f", 4), (2, 1, "g", "h", 3)], "repository_id int, pr_number int, head_sha string, base_sha string, at int")
    got = {(r.repository_id, r.pr_number): tuple(r)[2:] for r in persist.pull_requests(stored, reviews).collect()}
    assert got == {(1, 1): ("kept", "c", "d", "closed", 5), (1, 2): ("other", "a", "b", "open", 1), (2, 1): ("PR #1", "g", "h", "open", 3)}
    lines = spark.createDataFrame([([" a", "-b", "+c", " d"], 10, i) for i in (0, 1, 2, 3, 9)], "l array<string>, s int, i int")
    assert [r.n for r in lines.select(persist.line_number(F.col("l"), F.col("s"), F.col("i")).alias("n")).collect()] == [10, 11, 11, 12, 13]


def test_calls_resolve_by_name_module_class_and_type(spark):
    symbols = spark.createDataFrame([("1", "lib.py", "help", None, 1, 2), ("2", "lib.py", "help", None, 5, 6), ("3", "lib.py", "add", "Calc.add", 8, 9), ("9", "a.py", "f", None, 1, 9)], "node_id string, path string, name string, qualified_name string, start_line long, end_line long")
    imports = spark.createDataFrame([("a.py", "h", "lib.py", "help"), ("a.py", "lib", "lib.py", None), ("a.py", "Calc", "lib.py", "Calc")], "path string, local string, target string, original string")
    types = spark.createDataFrame([("a.py", "obj", "Calc")], "path string, variable string, class_name string")
    calls = [(1, "a.py", 2, "h", None), (2, "a.py", 3, "help", "lib"), (3, "a.py", 4, "add", "Calc"), (4, "a.py", 5, "add", "obj"), (5, "a.py", 6, "help", None), (6, "a.py", 7, "add", "gone")]
    found = graph.resolve_calls(spark.createDataFrame(calls, "call_id long, path string, line long, callee string, receiver string"), imports, types, symbols)
    assert {r.call_id: r.callee_id for r in found.collect()} == {1: "1", 2: "1", 3: "3", 4: "3"}
    assert {(r.caller, r.callee) for r in graph.call_edges(None, symbols, found).collect()} == {("9", "1"), ("9", "3")}


def test_excluded_paths(spark):
    paths = [(".git/x", True), ("a/.bzr/x", True), ("p.egg-info/x", True), ("Cargo.lock", False), (".hidden", True), (".env", False), ("a/b.py", False), ("Build/x.py", True), ("a/Node_Modules/x.py", True), ("build/x.py", True), ("YARN.lock", True)]
    got = {r.p: r.x for r in spark.createDataFrame([p for p, _ in paths], "string").toDF("p").select("p", tree.excluded(F.col("p")).alias("x")).collect()}
    assert got == dict(paths)


def test_costs_and_alerts(spark):
    usage = spark.createDataFrame([("gemini", "gemini-1.5-pro", 1_000_000, 1_000_000), ("x", "y", 1_000_000, 0)], "provider string, model string, input_tokens long, output_tokens long")
    assert {r.model: r.cost for r in metrics.costs(usage).collect()} == {"gemini-1.5-pro": 6.25, "y": 3.0}
    totals = spark.createDataFrame([("a", 6, 100, 0.25, 31.0), ("b", 5, 100, 0.24, 30.0)], "k string, errors long, requests long, cost double, latency double")
    assert {(r.k, r.alert) for r in metrics.alerts(totals, ["k"]).where("triggered").collect()} == {("a", "high_error_rate"), ("a", "cost_budget_warning"), ("a", "high_latency")}


def test_a_tail_goes_on_where_it_ended(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    def add(name, rows):
        ids, seconds, users, kinds = zip(*rows, strict=True)
        pq.write_table(pa.table({"event_id": pa.array(ids, pa.int64()), "ts": pa.array([s * 1_000_000 for s in seconds], pa.timestamp("us")), "user_id": pa.array(users, pa.int64()), "event_type": kinds, "value": pa.array([0.0] * len(rows)), "props": ["{}"] * len(rows)}), str(tmp_path / "in" / name))

    (tmp_path / "in").mkdir()
    run = lambda: {(r.workflow_id, r.event_id): r.sequence for r in streams.written(streams.appended(streams.event_stream(spark, str(tmp_path / "in")), until_end=True), str(tmp_path / "rows"), str(tmp_path / "check")).collect()}
    add("events1.parquet", [(1, 1, 1, "click"), (2, 2, 2, "click"), (3, 3, 2, "purchase")])
    assert run() == {("wf-1", 1): 1, ("wf-2", 2): 1, ("wf-2", 3): 2}
    add("events2.parquet", [(4, 4, 1, "view"), (5, 5, 2, "click")])
    # Nothing comes again, numbers go on, and nothing follows the end of a workflow.
    assert run() == {("wf-1", 1): 1, ("wf-2", 2): 1, ("wf-2", 3): 2, ("wf-1", 4): 2}
    log = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:10"), ("a", "2024-01-01 00:01:40")], "workflow_id string, ts string").select("workflow_id", F.col("ts").cast("timestamp").alias("ts"))
    assert [(r.beats) for r in streams.heartbeats(log).collect()] == [2]
    assert streams.connected("wf-1", 3).startswith("event: connected\ndata: {")


def test_signatures(spark):
    import hashlib
    import hmac

    from lathe.sources import webhook

    for secret in (b"k", b"x" * 64, b"y" * 100):
        rows = [(p, "sha256=" + hmac.new(secret, p.encode(), hashlib.sha256).hexdigest()) for p in ("", "{}", "é" * 200)]
        df = spark.createDataFrame([*rows, ("{}", None), ("{}", "sha256=12"), ("{} ", rows[1][1])], "p string, s string")
        assert [r.ok for r in df.select(webhook.signed(F.col("p"), F.col("s"), secret).alias("ok")).collect()] == [True] * 3 + [False] * 3


def test_declared_counts(spark):
    df = spark.createDataFrame([(["@@ -1 +1 @@", "+++ b", "+a", "-b", " c"], 1, 1), (["+a"], 5, 2)], "l array<string>, a int, d int")
    assert [r.ok for r in df.select(diff.declared_matches(F.col("a"), F.col("d"), F.col("l")).alias("ok")).collect()] == [True, False]
