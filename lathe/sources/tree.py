"""Source trees: scan, exclusion, size routing and file types, from the files' paths and lengths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import base_name, chosen, parent_of, suffix

#: Folders and files that a scan leaves out, file types by suffix, and size limits in bytes.
EXCLUDED_DIRS = (
    ".git", ".svn", ".hg", ".bzr", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", ".nox", ".venv", "venv", "env", ".env", "node_modules", "bower_components", ".next", ".nuxt",
    "dist", "build", "out", "target", ".gradle", ".idea", ".vscode", ".DS_Store", "coverage", ".coverage", "htmlcov", ".eggs", "__snapshots__",
)
EXCLUDED_DIR_SUFFIX = ".egg-info"
EXCLUDED_FILES = (
    ".gitignore", ".gitattributes", ".editorconfig", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock", "Gemfile.lock", "Cargo.lock", "composer.lock", "go.sum",
)
HIDDEN_KEPT = (".env", ".envrc")
FILE_TYPES = {
    ".sh": "bash", ".bash": "bash", ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".c": "c", ".cpp": "cpp", ".cs": "csharp", ".go": "go", ".rb": "ruby", ".rs": "rust", ".sql": "sql",
    ".kt": "kotlin", ".php": "php", ".html": "html", ".properties": "properties", ".yaml": "yaml", ".yml": "yaml", ".xml": "xml",
}
TEXT_SUFFIXES = (".md", ".txt", ".rst", ".markdown")
LARGE, TOO_LARGE = 1 << 20, 10 << 20


def _hidden_files(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """Paths and lengths of the files that Spark's own listing leaves out: a part of their path below root begins with '_' or '.'."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base, found, files = fs.resolvePath(top).toUri().getPath().rstrip("/") + "/", [], fs.listFiles(top, True)
    while files.hasNext():
        f = files.next()
        path = f.getPath().toUri().getPath().removeprefix(base)
        if any(x[:1] in "_." for x in path.split("/")):
            found.append((path, f.getLen()))
    return found


def _opened(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents = []
            for path in batch["path"]:
                with open(f"{root}/{path}", "rb") as file:
                    contents.append(file.read())
            yield batch.assign(content=contents)

    return run


def scan_tree(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """Files under a folder: path (relative), length, content.

    Spark's readers skip names that begin with '_' or '.', such as
    __init__.py; these are listed on the driver, which holds their names only,
    and opened by the executors, for which root must be a shared mount. In a
    store that only Spark reads they are listed without content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    local = re.sub(r"^file:/*(?=/)", "", root).rstrip("/")
    base = re.sub(r"^[a-z0-9]+:/*(?=/)", "", local)
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", ""), "^" + re.escape(base) + "/", "")
    seen = files.select(path.alias("path"), "length", *(["content"] if with_content else []))
    hidden = _hidden_files(spark, root)
    if not hidden:
        return seen
    rest = spark.createDataFrame(hidden, "path string, length long")
    if with_content and local.startswith("/"):
        rest = rest.mapInPandas(_opened(local), "path string, length long, content binary")
    elif with_content:
        rest = rest.withColumn("content", F.lit(None).cast("binary"))
    return seen.unionByName(rest)


def excluded(path: Column) -> Column:
    """Whether a path lies in an excluded folder, is an excluded file, or is hidden. Names are compared in lower case, so entries with capitals match none."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    above = F.slice(parts, 1, F.size(parts) - 1)
    return F.exists(above, lambda x: x.isin(*EXCLUDED_DIRS) | x.endswith(EXCLUDED_DIR_SUFFIX)) | name.isin(*EXCLUDED_FILES) | (name.startswith(".") & ~name.isin(*HIDDEN_KEPT))


def file_type(path: Column) -> Column:
    """The type by name or, in its own case, by suffix; UNKNOWN else."""
    return F.when(F.lower(base_name(path)) == "dockerfile", "dockerfile").otherwise(chosen(suffix(path), FILE_TYPES, F.lit("UNKNOWN")))


def route(length: Column, path: Column) -> Column:
    """How a file is taken in: skip beyond TOO_LARGE, unsupported without a type, large beyond LARGE (in batches), else normal."""
    return F.when(length > TOO_LARGE, "skip").when(file_type(path) == "UNKNOWN", "unsupported").when(length > LARGE, "large").otherwise("normal")


def batches_of(symbols: DataFrame, size: int = 50) -> DataFrame:
    """Symbols of large files in batches: path, batch, rows. Numbers within a file only, so a file's rows are all that a task holds."""
    order = F.row_number().over(Window.partitionBy("path").orderBy("start_line", F.col("end_line").desc(), "node_id")) - 1
    return symbols.withColumn("batch", F.floor(order / size).cast("long")).groupBy("path", "batch").agg(F.count(F.lit(1)).alias("rows"))


def whole_files(batches: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is published of files that were taken in batch by batch, and why the others aren't.

    batches: path, batch, error (null: it went well). rows: path, batch and
    what a batch has staged. A file with a failed batch is withdrawn as a
    whole, by an anti-join on the few paths that failed. Returns the rows that
    stay and path, failed (batches), batches, error (of the first that failed).
    """
    by = batches.groupBy("path").agg(F.count("error").alias("failed"), F.count(F.lit(1)).alias("batches"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("batch"))).alias("error"))
    failures = by.where("failed > 0")
    return rows.join(failures.select("path"), "path", "left_anti"), failures


def folders(files: DataFrame) -> DataFrame:
    """All folders above the files, the root included: path, parent."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = files.where(F.size(parts) > 1).select(F.explode(above).alias("path")).distinct()
    return found.select("path", F.when(parent_of(F.col("path")) == "", ".").otherwise(parent_of(F.col("path"))).alias("parent")).union(files.sparkSession.createDataFrame([(".", None)], "path string, parent string"))


def nodes(files: DataFrame) -> DataFrame:
    """Folder and file nodes of a scan, without what is excluded: path, kind, parent, type, route, length."""
    kept = files.where(~excluded(F.col("path")))
    parent = F.when(parent_of(F.col("path")) == "", ".").otherwise(parent_of(F.col("path")))
    dirs = folders(kept).select("path", F.lit("dir").alias("kind"), "parent", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("route"), F.lit(None).cast("long").alias("length"))
    return dirs.union(kept.select("path", F.lit("file"), parent, file_type(F.col("path")), route(F.col("length"), F.col("path")), "length"))


def incremental(files: DataFrame, changed: DataFrame) -> DataFrame:
    """The changed paths, each found among the files or failed, as one that isn't there can't be read."""
    own = files.select(F.col("path").alias("_path"))
    rows = changed.select("path").distinct().join(own, F.col("path") == F.col("_path"), "left")
    return rows.select("path", F.when(F.col("_path").isNull(), "failed").otherwise("found").alias("outcome"))


def text_files(files: DataFrame) -> DataFrame:
    return files.where(suffix(F.col("path")).isin(*TEXT_SUFFIXES))
