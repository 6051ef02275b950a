"""A folder tree as a data source: `spark.read.format("tree").option("root", folder)`.

Each folder below the root is a partition that its task lists and reads, so the
driver sees the names right below the root only. What can't be read is a row with its
error. A file's content is read after its size and type have said that it is
taken in. The root must be a folder that all executors mount.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tree import EXCLUDED_DIR_SUFFIX, EXCLUDED_DIRS, EXCLUDED_FILES, FILE_TYPES, HIDDEN_KEPT, LARGE, TOO_LARGE

SCHEMA = "path string, kind string, length long, type string, route string, content binary, error string"
_SCHEMA = pa.schema([("path", pa.string()), ("kind", pa.string()), ("length", pa.int64()), ("type", pa.string()), ("route", pa.string()), ("content", pa.binary()), ("error", pa.string())])
#: Rows and bytes of content that a batch holds, but for the file that exceeds them.
ROWS, BYTES = 1000, 8 << 20


@dataclass
class Folder(InputPartition):
    """A folder below the root, and whether those below it belong to it."""

    path: str
    deep: bool


def left_out(name: str, folder: bool) -> bool:
    name = name.lower()
    if folder:
        return name in EXCLUDED_DIRS or name.endswith(EXCLUDED_DIR_SUFFIX)
    return name in EXCLUDED_FILES or (name.startswith(".") and name not in HIDDEN_KEPT)


def taken_in(name: str, length: int) -> tuple[str, str]:
    """Type and route of a file, by its name and length."""
    kind = "dockerfile" if name.lower() == "dockerfile" else FILE_TYPES.get(os.path.splitext(name)[1], "UNKNOWN")
    return kind, "skip" if length > TOO_LARGE else "unsupported" if kind == "UNKNOWN" else "large" if length > LARGE else "normal"


def rows_of(root: str, folder: Folder, content: bool) -> Iterator[tuple]:
    """Rows of a folder: itself (but the root), its files, and if deep all below. Links aren't followed into folders."""
    waiting = [folder.path]
    while waiting:
        path = waiting.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, path)), key=lambda e: e.name)
        except OSError as e:
            yield path, "dir", None, None, None, None, type(e).__name__
            continue
        if path:
            yield path, "dir", None, None, None, None, None
        for entry in entries:
            name = os.path.join(path, entry.name)
            if entry.is_dir(follow_symlinks=False):
                if folder.deep and not left_out(entry.name, True):
                    waiting.append(name)
                continue
            if left_out(entry.name, False):
                continue
            length = kind = route = None
            try:
                length = entry.stat().st_size
                kind, route = taken_in(entry.name, length)
                data = None
                if content and route in ("normal", "large"):
                    with open(os.path.join(root, name), "rb") as file:
                        data = file.read()
                yield name, "file", length, kind, route, data, None
            except OSError as e:
                yield name, "file", length, kind, route, None, type(e).__name__


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = re.sub(r"^file:/*(?=/)", "", options["root"]).rstrip("/")
        self.content = options.get("content", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        below = sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and not left_out(e.name, True))
        return [Folder("", False), *(Folder(name, True) for name in below)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in rows_of(self.root, partition, self.content):
            rows.append(row)
            size += len(row[5] or b"")
            if len(rows) >= ROWS or size >= BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


class TreeSource(DataSource):
    """Options: root, and content (true) to read files."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def written(root: str):
    """For mapInPandas: writes rows (path, text) as files below root, which executors share, and returns their paths. A repeated task writes the same."""
    local = re.sub(r"^file:/*(?=/)", "", root).rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                full = os.path.join(local, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as file:
                    file.write(text.encode())
            yield batch[["path"]]

    return run


def register(spark: SparkSession) -> None:
    """Makes the format "tree" known to a session."""
    spark.dataSource.register(TreeSource)
