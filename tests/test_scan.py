"""The tree as a data source: what is left out, errors as rows, contents by size; and files that come as a whole or not."""

import os

from lathe.sources import scan, tree


def test_scan_of_a_tree(spark, tmp_path, monkeypatch):
    for path, data in {"a/x.py": b"x = 1\n", "a/b/__init__.py": b"", "a/b/_y.js": b"y", "node_modules/z.js": b"z", "a/Dist/w.py": b"w", "top.sql": b"select", ".env": b"k", ".hidden": b"h", "a/odd.zzz": b"o", "q.egg-info/f": b"f"}.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_bytes(data)
    (tmp_path / "a/huge.py").write_bytes(b"")
    os.truncate(tmp_path / "a/huge.py", tree.TOO_LARGE + 1)
    os.symlink(tmp_path / "gone", tmp_path / "a/broken.py")
    os.symlink(tmp_path / "a", tmp_path / "a/b/loop")
    scan.register(spark)
    rows = {r.path: (r.kind, r.length, r.route, None if r.content is None else bytes(r.content), r.error) for r in spark.read.format("tree").option("root", f"file://{tmp_path}").load().collect()}
    assert rows["a/x.py"] == ("file", 6, "normal", b"x = 1\n", None) and rows["a/b/__init__.py"] == ("file", 0, "normal", b"", None)
    assert rows["a/odd.zzz"][2:4] == ("unsupported", None) and rows["a/huge.py"] == ("file", tree.TOO_LARGE + 1, "skip", None, None)
    assert rows["a/broken.py"] == ("file", None, None, None, "FileNotFoundError") and rows["a/b/loop"][3:] == (None, "IsADirectoryError") or rows["a/b/loop"][2] == "unsupported"
    assert set(rows) == {"a", "a/b", "a/x.py", "a/b/__init__.py", "a/b/_y.js", "a/odd.zzz", "a/huge.py", "a/broken.py", "a/b/loop", "top.sql", ".env"}
    assert [list(scan.rows_of(str(tmp_path), scan.Folder("gone", True), True))] == [[("gone", "dir", None, None, None, None, "FileNotFoundError")]]
    reader = scan.TreeReader({"root": str(tmp_path)})
    assert [(p.path, p.deep) for p in reader.partitions()] == [("", False), ("a", True)]


def test_a_file_with_a_failed_batch_is_withdrawn(spark):
    batches = spark.createDataFrame([("a", 0, None), ("a", 1, "late"), ("a", 2, "later"), ("b", 0, None), ("c", 0, "no")], "path string, batch long, error string")
    rows = spark.createDataFrame([("a", 0, "1"), ("a", 2, "2"), ("b", 0, "3"), ("b", 0, "4")], "path string, batch long, node_id string")
    kept, failures = tree.whole_files(batches, rows)
    assert sorted(r.node_id for r in kept.collect()) == ["3", "4"]
    assert sorted(tuple(r) for r in failures.select("path", "failed", "batches", "error").collect()) == [("a", 2, 3, "late"), ("c", 1, 1, "no")]
