"""What the findings of round 4 name, on small tables that failed before."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from compare import duck_rows, spark_rows  # noqa: E402

from lathe.plans import registry  # noqa: E402


def _shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in Path(d).rglob("shuffle_*.data")}


def _left(spark, before):
    """Shuffle files that weren't there before; they are deleted in the background."""
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    return left


def test_a_merge_in_rounds_leaves_no_shuffles_and_works_fresh_out_once(spark, tmp_path):
    from lathe.operators import graph
    from lathe.sources.store import Store

    edges = Store(spark, f"{tmp_path}/edges", ["src", "edge_type", "dst"], 8)
    worked_out = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            worked_out.add(batch.num_rows)
            yield batch

    columns = ["CAST(id AS STRING) AS src", "CAST(id % 50 AS STRING) AS dst", "'CALLS' AS edge_type"]
    first, second = spark.range(0, 600).selectExpr(*columns), spark.range(300, 900).selectExpr(*columns)
    before = _shuffle_files(spark)
    edges.change(first.union(first), graph.merge_edges, "first", 4)
    for _ in range(2):
        edges.change(second.mapInArrow(counted, second.schema), graph.merge_edges, "second", 4)
    assert worked_out.value == 600 and edges.versions() == [1, 2]
    assert not _left(spark, before)
    assert sorted(int(r.src) for r in edges.read().collect()) == list(range(900)) and edges.read(1).count() == 600
    # A bucket that a change doesn't touch stays, and an empty change publishes a version of the same rows.
    edges.change(spark.range(2000, 2001).selectExpr(*columns), graph.merge_edges, "third", 4)
    edges.change(first.where("src < 0"), graph.merge_edges, "none", 4)
    assert edges.read().count() == 901 and edges.vacuum(4) == 0


def _odd_calls(spark, folder):
    """Files that share a name, orders and parts that are there twice or not at all, nulls, and call sites that share an id, without ties that the SQL leaves open."""
    nations = [(n, f"N{n}", 0) for n in range(2)]
    customers = [(k, None if k == 19 else f"C{k % 15}", k % 2) for k in range(20)]
    orders = [(o, o % 21, "1-URGENT", "O") for o in range(60)] + [(3, 3, "2-HIGH", "F")]
    brands, names = [None, "", "Brand#1", "Brand#22", "x.py"], [None, "ring", "bolt", "nut", "cap", "pin", "cog"]
    parts = [(p, names[p % 7], brands[p % 5], "T") for p in [*range(45), *range(100_000, 100_045)]] + [(8, "ring", "Brand#1", "T")]
    items = [(o if o % 17 else None, (o * 7 + k * k) % 50 + (100_000 if k % 3 == 0 else 0)) for o in range(64) for k in range(12)] + [(5, None)]
    tables = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"), "nation": (nations, "n_nationkey int, n_name string, n_regionkey int"),
        "customer": (customers, "c_custkey long, c_name string, c_nationkey int"), "part": (parts, "p_partkey long, p_name string, p_brand string, p_type string"),
        "orders": ([(*o, None) for o in orders], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate timestamp"),
        "lineitem": (items + items[:9], "l_orderkey long, l_partkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def _duck(folder):
    import duckdb

    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')")
    return con


def test_call_sites_by_keys_are_those_of_the_view(spark, tmp_path):
    registry.queries()
    from lathe.plans import dialect, graph_queries

    _odd_calls(spark, tmp_path)
    sites = graph_queries._call_sites(spark, str(tmp_path))
    columns, rows = spark_rows(sites)
    assert len(rows) > 300 and (columns, rows) == spark_rows(dialect.table(spark, str(tmp_path), "call_sites"))
    imports = [tuple(r) for r in graph_queries._import_map(sites).distinct().collect() if r.local is not None]
    assert set(imports) == {tuple(r) for r in dialect.table(spark, str(tmp_path), "import_map").collect() if r.local is not None}


def test_resolved_calls_leave_no_shuffles_and_are_those_of_the_sql(spark, tmp_path):
    _odd_calls(spark, tmp_path)
    con = _duck(tmp_path)
    for name in ("call_resolution", "call_edges"):
        before = _shuffle_files(spark)
        found = registry.queries()[name](spark, str(tmp_path))
        found.write.format("noop").mode("overwrite").save()
        assert not _left(spark, before)
        columns, rows = spark_rows(found)
        assert len(rows) > 50 and (columns, rows) == duck_rows(con, registry.oracle_sql()[name])
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
