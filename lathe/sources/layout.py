"""The graph laid out for lookups: tables in buckets by the column that they are looked up by, sorted by it, with Bloom filters on others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from .store import scratch, settings, shuffles_dropped

#: Rows of a bucket, as it is sorted in one task when it is written and again when it is joined.
ROWS = 500_000


def buckets_for(rows: int, least: int) -> int:
    """So many buckets for a table of up to rows rows that one has ROWS on average at most."""
    return max(least, -(-rows // ROWS))


def laid_out(rows: DataFrame, by: str, buckets: int, filters: tuple[str, ...] = (), lookups: bool = True) -> DataFrame:
    """Writes rows into a table of the catalog, in buckets of by and sorted by it, one file each, and reads it back.

    A join or a window on by needs no shuffle of the table any more, and a
    lookup of given values reads their buckets only, and of these only the row
    groups whose range and whose Bloom filters (of the columns in filters, and
    by) may hold them. Rows with one value of by meet in a bucket, as they do
    in a shuffle; by should have many more values than there are buckets, and
    buckets should grow with the table (buckets_for). For joins alone, without
    lookups, there are no Bloom filters, which take up to 1 MB each.
    """
    spark, name = rows.sparkSession, f"lathe_{uuid.uuid4().hex}"
    writer = rows.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", scratch(spark, "layout"))
    for column in (by, *filters) if lookups else ():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    with shuffles_dropped(spark):
        writer.format("parquet").saveAsTable(name)
    return spark.table(name)


def aside(rows: DataFrame) -> DataFrame:
    """Writes rows to the shared folder and reads them back, so that their shuffles are gone and their size is known.

    Tables laid out by one of a join's keys are joined as they lie. As their
    files are sorted they are much smaller than their rows, which counts where
    a side may be broadcast.
    """
    spark, folder = rows.sparkSession, scratch(rows.sparkSession, "aside")
    with shuffles_dropped(spark), settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.fileCompressionFactor": "10"}):
        rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)
