"""Helpers shared by the text operators: saved intermediate tables, connected components, bucketed ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of all word and normalisation rules.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where that is unset: a temporary one in local mode, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lathe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows that a Python worker gets at once while a table is saved, as rows may be whole texts; and their bytes, but for the row that exceeds them.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1000, 8 << 20


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors, keeps column pruning.

    Python workers get small batches meanwhile; the session's settings are as before afterwards.
    """
    spark, small = df.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": ROWS_AT_ONCE, "spark.sql.execution.arrow.maxBytesPerBatch": BYTES_AT_ONCE}
    path = f"{shared_folder(spark)}/lathe-{name}-{uuid.uuid4().hex}"
    before = {setting: spark.conf.get(setting) for setting in small}
    for setting, value in small.items():
        spark.conf.set(setting, value)
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in slices of so many rows and, but for single rows, about so many bytes. Spark bounds a batch by spark.sql.execution.arrow.maxBytesPerBatch. Gives memory back at the end, as workers live on."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
    pa.default_memory_pool().release_unused()


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, made from name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def discard(df: DataFrame) -> None:
    """Delete a table made by saved() once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Components of an undirected graph given as columns src, dst (longs); returns node, component (its smallest node).

    Alternates large-star and small-star steps until nothing changes, which
    takes a number of rounds logarithmic in the longest path. Every round is
    saved, so a lost executor costs one round at most. Self-loops and repeated
    edges are ignored; isolated nodes aren't returned. rounds is a bound at
    which it gives up with an error.
    """
    now = edges.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, mark = saved(now, "edges"), None
    for _ in range(rounds):
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark or not found[0]:
            break
        mark = tuple(found)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        before, now = now, saved(small, "edges")
        discard(before)
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    tops = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(tops)


def bucket_count(rows: int, per_bucket: int = 20_000) -> int:
    """Buckets so that each has about per_bucket rows, whatever the table's size."""
    return max(16, -(-rows // per_bucket))


def running_total(df: DataFrame, groups: list[str], bucket: str, order: list[str], amount: str, out: str) -> DataFrame:
    """Adds out: the sum of amount over all earlier rows of the group, by (bucket, order).

    Sums the buckets first, so that no task holds more than a bucket's rows of
    a group, however many rows the group has.
    """
    sums = df.groupBy(*groups, bucket).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*groups, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*groups, bucket]
    right = sums.select(*[F.col(k).alias(f"_{k}_k") for k in keys], "_before")
    match = [F.col(k).eqNullSafe(F.col(f"_{k}_k")) for k in keys]
    return (
        df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(right, match)
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_inside", "_before", *[f"_{k}_k" for k in keys])
    )
