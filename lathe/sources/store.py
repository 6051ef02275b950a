"""Versioned tables in a shared folder: upserts, deletes and appends that readers see as a whole or not at all.

A table's rows are dealt into buckets by a hash of its keys. A change reads and
rewrites only the buckets that its rows fall into, in a folder of its own, and
then publishes a new version: a small file that names each bucket's folder. A
version's file appears under its final name at once and is never changed, so
readers see one version, a writer that dies leaves nothing but a folder that no
version names, and of two writers of the same version one fails. Changes carry a
token; one that has been applied is not applied again, so a rerun is harmless.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


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


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings for what is written herein."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shuffles_dropped(spark: SparkSession):
    """What is written herein leaves no shuffle files behind, which otherwise stay on disk until the driver collects garbage."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


class ConcurrentChange(RuntimeError):
    """Another writer has published the version that this one was about to."""


class Store:
    """A table with keys in folder. Columns are those of the first rows written."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets

    # --- files of versions, all on the driver and bounded by the number of buckets -------------------------------------
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path, fs = self._path(name), self._fs()
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """What a version consists of; of the latest without one."""
        known = self.versions()
        if not known:
            return None
        path = self._path(f"versions/{known[-1] if version is None else version:012d}.json")
        stream = self._fs().open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        final, draft = self._path(f"versions/{manifest['version']:012d}.json"), self._path(f"versions/_{uuid.uuid4().hex}")
        fs = self._fs()
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, keep)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise ConcurrentChange(f"version {manifest['version']} of {self.folder} was published meanwhile") from e
            raise

    # --- reading -------------------------------------------------------------------------------------------------------
    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = self.spark.createDataFrame([], manifest["schema"]).schema
        wanted = manifest["buckets"] if buckets is None else {b: p for b, p in manifest["buckets"].items() if int(b) in buckets}
        paths = [f"{self.folder}/{p}" for p in wanted.values()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest without one. What is read stays the same while others write."""
        manifest = self.manifest(version)
        if manifest is None:
            raise ValueError(f"nothing has been written to {self.folder}")
        return self._rows(manifest)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys, of a bounded number of them: reads only the buckets that they fall into."""
        wanted = [r["b"] for r in keys.select(self._bucket().alias("b")).distinct().collect()]
        rows = self._rows(self.manifest(), wanted)
        return rows.join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    # --- changing ------------------------------------------------------------------------------------------------------
    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def change(self, fresh: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], token: str | None = None, rounds: int = 1) -> int:
        """Replaces the rows of every bucket that fresh touches by merge(these rows, fresh); returns the version that holds it.

        merge must treat keys by themselves, as it only sees those of some
        buckets. token names the change: if a version already has it, that
        version is returned and nothing is written. With several rounds fresh is
        written out by bucket first, so that it is worked out only once, and each
        round merges a share of the buckets and drops its shuffles: what lies on
        disk at a time is that share of them.
        """
        manifest = self.manifest()
        if manifest and token is not None and token in manifest["tokens"]:
            return manifest["tokens"][token]
        if rounds > 1:
            return self._in_rounds(fresh, merge, manifest, token, rounds)
        if manifest is None:
            old = self.spark.createDataFrame([], fresh.schema)
        else:
            # As many numbers as there are buckets.
            touched = [r["b"] for r in fresh.select(self._bucket().alias("b")).distinct().collect()]
            old = self._rows(manifest, touched)
        rows = merge(old, fresh)
        if manifest:
            rows = rows.select(*self.spark.createDataFrame([], manifest["schema"]).columns)
        kept = {b: p for b, p in (manifest["buckets"] if manifest else {}).items() if int(b) not in touched}
        return self._written(rows, manifest, kept, token, manifest["schema"] if manifest else None)

    def _in_rounds(self, fresh: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], manifest: dict | None, token: str | None, rounds: int) -> int:
        aside, staged = f"data/{uuid.uuid4().hex}", f"data/{uuid.uuid4().hex}"
        held = manifest["buckets"] if manifest else {}
        with shuffles_dropped(self.spark):
            fresh.withColumn("_bucket", self._bucket()).write.partitionBy("_bucket").parquet(f"{self.folder}/{aside}")
            touched = sorted(int(n.removeprefix("_bucket=")) for n in self._names(aside) if n.startswith("_bucket="))
            for k in range(rounds):
                if own := touched[k::rounds]:
                    new = self.spark.read.schema(fresh.schema).parquet(*(f"{self.folder}/{aside}/_bucket={b}" for b in own))
                    rows = merge(self._rows(manifest, own) if manifest else self.spark.createDataFrame([], fresh.schema), new)
                    self._write(rows.select(*self.spark.createDataFrame([], manifest["schema"]).columns) if manifest else rows, staged)
        self._fs().delete(self._path(aside), True)
        kept = {b: p for b, p in held.items() if int(b) not in touched}
        return self._published(rows.schema if touched else fresh.schema, staged, manifest, kept, token, manifest["schema"] if manifest else None)

    def _written(self, rows: DataFrame, manifest: dict | None, kept: dict[str, str], token: str | None, schema: str | None) -> int:
        """Publishes a version of the buckets kept and of rows, which are written to a folder of their own first."""
        staged = f"data/{uuid.uuid4().hex}"
        self._write(rows, staged)
        return self._published(rows.schema, staged, manifest, kept, token, schema)

    def _write(self, rows: DataFrame, staged: str) -> None:
        # A bucket's rows are dealt over several tasks, as many as there are partitions without adaptive execution and by size with it, so
        # that a large table needs no large tasks. In a file they are sorted by key, so that parts of it can be skipped by their range of keys.
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        part = F.pmod(F.shiftrightunsigned(F.xxhash64(*self.keys), 32), F.lit(parts))
        rows = rows.withColumn("_bucket", self._bucket())
        dealt = rows.withColumn("_part", part).hint("rebalance", F.col("_bucket"), F.col("_part")).drop("_part")
        dealt.sortWithinPartitions("_bucket", *self.keys).write.mode("append").partitionBy("_bucket").parquet(f"{self.folder}/{staged}")

    def _published(self, columns: StructType, staged: str, manifest: dict | None, kept: dict[str, str], token: str | None, schema: str | None) -> int:
        written = {n.removeprefix("_bucket="): f"{staged}/{n}" for n in self._names(staged) if n.startswith("_bucket=")}
        version = manifest["version"] + 1 if manifest else 1
        tokens = (manifest["tokens"] if manifest else {}) | ({token: version} if token is not None else {})
        schema = schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
        self._publish({"version": version, "schema": schema, "buckets": kept | written, "tokens": tokens})
        return version

    def append(self, rows: DataFrame, token: str | None = None) -> int:
        """Adds rows, whatever their keys."""
        return self.change(rows, lambda old, new: old.unionByName(new), token)

    def delete(self, keys: DataFrame, token: str | None = None) -> int:
        """Removes the rows of these keys."""
        return self.change(keys.select(*self.keys).distinct(), lambda old, gone: old.join(gone, self.keys, "left_anti"), token)

    def replace(self, rows: DataFrame, token: str | None = None) -> int:
        """Only these rows from now on. Older versions stay readable."""
        manifest = self.manifest()
        if manifest and token is not None and token in manifest["tokens"]:
            return manifest["tokens"][token]
        return self._written(rows, manifest, {}, token, None)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what only older versions than the last keep name, and what no version names; returns how many folders went. Nobody may write meanwhile."""
        known = self.versions()
        held = {p.split("/")[1] for v in known[-keep:] for p in self.manifest(v)["buckets"].values()}
        gone = [n for n in self._names("data") if n not in held]
        for v in known[:-keep]:
            self._fs().delete(self._path(f"versions/{v:012d}.json"), False)
        for n in gone:
            self._fs().delete(self._path(f"data/{n}"), True)
        return len(gone)
