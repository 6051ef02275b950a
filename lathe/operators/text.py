"""Text operators that Spark's functions can't express: chunks, boundaries, repairs, spreading."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_spans(text: str, size: int = 1000, overlap: int = 200) -> list[tuple[int, int]]:
    """Spans of size characters at most, cut after the last newline of their last fifth or else after the last blank there.

    Each begins overlap characters before the cut of the one ahead, which at
    the end of a text leaves a sliver that lies in the one ahead as a whole.
    """
    if len(text) <= size:
        return [(0, len(text))]
    spans, begin = [], 0
    while not spans or 0 < begin < len(text):
        reach = begin + size
        if reach < len(text):
            at = text.rfind("\n", reach - size // 5, reach)
            at = at if at > begin else text.rfind(" ", reach - size // 5, reach)
            reach = at + 1 if at > begin else reach
        spans.append((begin, min(reach, len(text))))
        begin = reach - overlap
    return spans


CHUNKS = "doc_id long, chunk long, begin long, end long, lines long"


def text_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of every text: doc_id, chunk (from 0 on), begin, end, lines (newlines inside)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, i, a, b, text.count("\n", a, b)) for doc, text in zip(batch["doc_id"], batch["text"], strict=True) if text is not None for i, (a, b) in enumerate(chunk_spans(text, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "begin", "end", "lines"])

    return docs.select("doc_id", "text").mapInPandas(run, CHUNKS)


def linked_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with the next one's number and the first line, by newlines of the chunks before."""
    w = Window.partitionBy("doc_id").orderBy("chunk")
    first = F.coalesce(F.sum("lines").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    return chunks.withColumn("next_chunk", F.lead("chunk").over(w)).withColumn("first_line", first.cast("long"))


_BOUNDARY = re.compile(r"^(?:def |async def |function |class |\s*#|\s*//|\s*$)", re.MULTILINE)


def cut_at_boundary(text: str, n: int, mark: str = "\n... [truncated] ...\n") -> str:
    """At most n characters that end before a definition, comment or blank line of the second half, else at a line's end."""
    if len(text) <= n:
        return text
    room = max(0, n - len(mark))
    ends = [m.start() for m in _BOUNDARY.finditer(text, 0, room) if m.start() > room // 2]
    cut = ends[-1] if ends else text.rfind("\n", 0, room)
    return text[: cut if cut > 0 else room] + mark


def _boundary(text: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else cut_at_boundary(t, int(k)) for t, k in zip(text, n, strict=True)])


def repaired(raw: str | None) -> str | None:
    """A JSON object out of a response: as it is, fenced, between its outer braces, without trailing commas, or a Python literal."""
    if not raw:
        return None
    tries = [raw, *re.findall(r"```(?:json)?\s*(.*?)```", raw, re.DOTALL)]
    if "{" in raw and "}" in raw:
        tries.append(raw[raw.index("{") : raw.rindex("}") + 1])
    for text in [*tries, *(re.sub(r",\s*([}\]])", r"\1", t) for t in tries)]:
        for load in (json.loads, ast.literal_eval):
            try:
                found = load(text.strip())
            except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
                continue
            if isinstance(found, dict):
                return json.dumps(found, sort_keys=True)
    return None


def _repair(raw: pd.Series) -> pd.Series:
    return raw.map(repaired)


# The functions are made when a plan asks for them: workers import this module, and can't make any.
def boundary_truncated(text: Column | str, n: Column | str) -> Column:
    return F.pandas_udf(_boundary, "string")(text, n)


def json_repaired(raw: Column | str) -> Column:
    return F.pandas_udf(_repair, "string")(raw)


def _free(links: dict[int, int], line: int) -> int:
    """The first line from this one on that isn't taken; links lead from taken lines on and are shortened."""
    passed = []
    while line in links:
        passed.append(line)
        line = links[line]
    links.update(dict.fromkeys(passed, line))
    return line


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of file, hunk and ord, however they are cut into batches; holds the taken lines of one hunk."""
    hunk, later, earlier = None, {}, {}
    for batch in batches:
        out = []
        for file, number, line, n in zip(*(batch.column(name).to_pylist() for name in ("file", "hunk", "line", "n_lines")), strict=True):
            if hunk != (file, number):
                hunk, later, earlier = (file, number), {}, {}
            if line is None:
                out.append(None)
                continue
            n = n or 0
            up, down = _free(later, max(line, 0)), _free(earlier, min(line, n - 1))
            near = [(abs(x - line), x < line, x) for x in (up, down) if 0 <= x < n and abs(x - line) <= n]
            out.append(min(near)[2] if near else line)
            later.setdefault(out[-1], out[-1] + 1)
            earlier.setdefault(out[-1], out[-1] - 1)
        columns = ("file", "hunk", "ord", "line")
        yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in columns), pa.array(out, pa.int64())], names=[*columns, "assigned"])


def spread(findings: DataFrame) -> DataFrame:
    """Gives findings of one hunk lines of their own: file, hunk, ord, line, n_lines -> assigned. A taken line yields to the nearest free one, later first."""
    rows = findings.select("file", *(F.col(name).cast("long").alias(name) for name in ("hunk", "ord", "line", "n_lines")))
    return rows.repartition("file", "hunk").sortWithinPartitions("file", "hunk", "ord").mapInArrow(_spread, "file string, hunk long, ord long, line long, assigned long")
