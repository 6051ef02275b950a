"""The versioned store: what is written is read back, as a whole, once, and by touched buckets only."""

import pytest
from pyspark.sql import functions as F

from lathe.operators import graph
from lathe.sources import layout
from lathe.sources.store import ConcurrentChange, Store


def above(plan, what):
    """The nodes above the first one of a plan that holds a text, from the top down."""
    stack = []
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-*"))
        stack = [x for x in stack if x[0] < depth] + [(depth, line.strip())]
        if what in line:
            return [x[1] for x in stack]
    raise AssertionError(f"{what} isn't in the plan")


def test_lookups_dont_shuffle_a_table_that_is_laid_out_for_them(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(2000).select(F.concat(F.lit("n"), (F.col("id") % 300).cast("string")).alias("src"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("dst"), F.lit("CALLS").alias("edge_type"))
        start = spark.range(40).select(F.concat(F.lit("n"), (F.col("id") * 5).cast("string")).alias("node_id"))
        laid = layout.laid_out(edges, "src", 8, ("dst",))
        plain, found = graph.expand(start, edges, ["CALLS"], 3), graph.expand(start, laid, ["CALLS"], 3)
        assert rows_of(found) == rows_of(plain) and found.count() == 120
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange" in x for x in above(plan(found), "FileScan parquet")) and any("Exchange" in x for x in above(plan(plain), "Range (0, 2000"))
        # Buckets are skipped for a plain filter as well, but told only for a bucketed scan.
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        assert "SelectedBucketsCount: 1 out of 8" in plan(laid.where("src = 'n7'"))
        assert rows_of(laid.where("src = 'n7' AND dst = 'm307'")) == [("n7", "m307", "CALLS")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s", ["k"], 8)


def upsert(old, new):
    return graph.merge_latest(old, new, ["k"], "v")


def test_two_upserts_and_an_interrupted_third(spark, store):
    first = spark.createDataFrame([(i, "a", 1) for i in range(100)], "k long, x string, v long")
    second = spark.createDataFrame([(3, "b", 2), (200, "b", 2), (4, "old", 0)], "k long, x string, v long")
    assert store.change(first, upsert) == 1 and store.change(second, upsert) == 2
    want = rows_of(first.where("k != 3").union(spark.createDataFrame([(3, "b", 2), (200, "b", 2)], first.schema)))
    assert rows_of(store.read()) == want
    # Only the buckets of the three keys were rewritten.
    one, two = store.manifest(1)["buckets"], store.manifest(2)["buckets"]
    touched = {str(r.b) for r in second.select(store._bucket().alias("b")).collect()}
    assert {b for b in two if two[b] != one.get(b)} == touched and 0 < len(touched) < 8
    # A writer dies while it writes, and one before it publishes.
    broken = second.withColumn("x", F.expr("if(k = 3, cast(raise_error('stop') as string), x)"))
    with pytest.raises(Exception, match="stop"):
        store.change(broken, upsert)
    publish, store._publish = store._publish, lambda manifest: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        store.change(second.withColumn("v", F.lit(9).cast("long")), upsert)
    store._publish = publish
    assert rows_of(store.read()) == want and store.versions() == [1, 2]
    assert store.vacuum() >= 1 and rows_of(store.read()) == want and store.versions() == [2]


def test_a_token_is_applied_once(spark, store):
    rows = spark.createDataFrame([(1, "a", 1)], "k long, x string, v long")
    assert store.append(rows, "batch-0") == 1
    assert store.append(rows, "batch-0") == 1 and store.read().count() == 1
    assert store.append(rows, "batch-1") == 2 and store.read().count() == 2
    assert store.delete(rows, "batch-2") == 3 and store.read().count() == 0 and store.read(2).count() == 2
    assert store.append(rows) == 4 and rows_of(store.lookup(rows)) == [(1, "a", 1)]


def test_of_two_writers_one_fails(spark, store):
    rows = spark.createDataFrame([(1, "a", 1)], "k long, x string, v long")
    store.append(rows)
    held = store.manifest()
    other = Store(spark, store.folder, ["k"], 8)
    other.append(rows)
    store.manifest = lambda version=None: held
    with pytest.raises(ConcurrentChange):
        store.append(rows)
    assert other.read().count() == 2


def test_readers_keep_their_version(spark, store):
    rows = spark.createDataFrame([(i, "a", 1) for i in range(50)], "k long, x string, v long")
    store.append(rows)
    before = store.read()
    store.replace(rows.limit(1))
    assert before.count() == 50 and store.read().count() == 1
