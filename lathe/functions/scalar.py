"""Scalar functions as Column builders: identities, paths, normalisation, truncation and scores."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from responses, severities for storage, categories, and their orders.
SEVERITY_FROM_RESPONSE = {"critical": "blocker", "blocker": "blocker", "error": "high", "high": "high", "warning": "medium", "medium": "medium", "info": "low", "low": "low", "suggestion": "nit", "minor": "nit", "nit": "nit"}
SEVERITY_TO_STORE = {"blocker": "CRITICAL", "critical": "CRITICAL", "high": "HIGH", "medium": "MEDIUM", "low": "LOW", "nit": "NIT", "nitpick": "NIT"}
SEVERITY_RANK = {"blocker": 0, "high": 1, "medium": 2, "low": 3, "nit": 4}
CATEGORY_FROM_RESPONSE = {"error": "bug", "vulnerability": "security", "efficiency": "performance", "formatting": "style", "architecture": "design", "documentation": "docs", "logging": "observability", "readability": "maintainability", "code_quality": "maintainability"}
CATEGORIES = ("bug", "security", "performance", "style", "design", "docs", "observability", "maintainability")
#: The truncation marks.
LINE_MARK, CHAR_MARK, TOO_LARGE = "... [truncated] ...", "\n... [truncated] ...\n", "[content too large]"
#: Weights of the relevance score.
EXTENSION_WEIGHTS = {".py": 1.0, ".js": 1.0, ".ts": 1.0, ".tsx": 1.0, ".java": 1.0, ".cpp": 1.0, ".jsx": 0.9, ".h": 0.8, ".json": 0.4, ".yml": 0.4, ".yaml": 0.4, ".md": 0.3, ".txt": 0.2}


def chosen(key: Column, values: dict, default: Column | None = None) -> Column:
    """A value by key, from a fixed table."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default)


def symbol_version_id(commit: Column, path: Column, kind: Column, name: Column, qualified: Column, start: Column, end: Column) -> Column:
    label = F.coalesce(F.nullif(qualified, F.lit("")), name)
    return F.sha2(F.concat(F.coalesce(commit, F.lit("")), F.lit("::"), path, F.lit("::"), kind, F.lit("::"), label, F.lit("::"), start.cast("string"), F.lit(":"), end.cast("string")), 256)


def stable_symbol_id(repo: Column, kind: Column, fingerprint: Column, qualified: Column, name: Column) -> Column:
    label = F.coalesce(F.nullif(fingerprint, F.lit("")), F.nullif(qualified, F.lit("")), name)
    return F.sha2(F.concat(repo, F.lit("::"), kind, F.lit("::"), label), 256)


def hunk_id(path: Column, header: Column) -> Column:
    return F.concat(F.lit("hunk_"), F.substring(F.sha2(F.concat(path, F.lit("::"), header), 256), 1, 12))


def normal_path(path: Column) -> Column:
    """Trimmed, with forward slashes, none at either end."""
    return F.regexp_replace(F.translate(F.regexp_replace(path, r"^\s+|\s+$", ""), "\\", "/"), r"^/+|/+$", "")


def parent_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def walked_up(path: Column, dots: Column) -> Column:
    """The folder that so many leading dots of a relative import lead to from a file: one for its own, one more for each level; the root's is empty."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0))), "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4.0).cast("long")


def limit_lines(text: Column, n: int) -> Column:
    """At most n lines: the first half, a mark, and the last lines; with n up to 3 the first n."""
    lines = F.split(text, "\n")
    if n <= 3:
        short = F.slice(lines, 1, n)
    else:
        tail = n - n // 2 - 1
        short = F.concat(F.slice(lines, 1, n // 2), F.array(F.lit(LINE_MARK)), F.slice(lines, -tail, tail))
    return F.when(F.size(lines) > n, F.array_join(short, "\n")).otherwise(text)


def keep_head(text: Column, n: int) -> Column:
    """At most n characters of the beginning with the mark behind."""
    room = n - len(CHAR_MARK)
    if room <= 0:
        return F.when(F.length(text) > n, TOO_LARGE).otherwise(text)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, room), F.lit(CHAR_MARK))).otherwise(text)


def keep_ends(text: Column, n: int) -> Column:
    """At most n characters, half from either end around the mark."""
    room = n - len(CHAR_MARK)
    if room <= 0:
        return F.when(F.length(text) > n, TOO_LARGE).otherwise(text)
    head = room // 2
    tail = room - head
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, head), F.lit(CHAR_MARK), F.substring(text, -tail, tail))).otherwise(text)


def path_jaccard(a: Column, b: Column) -> Column:
    x, y = F.split(a, "/"), F.split(b, "/")
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def file_distance(a: Column, b: Column) -> Column:
    """1 less the share of leading directories that two paths have in common."""
    x, y = F.split(a, "/"), F.split(b, "/")
    longest = F.greatest(F.size(x), F.size(y))
    depth = F.least(F.size(x), F.size(y)) - 1
    places = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    same = F.aggregate(places, F.lit(0), lambda n, i: F.when((n == i - 1) & (F.element_at(x, i) == F.element_at(y, i)), i).otherwise(n))
    return F.when(a == b, 0.0).otherwise(1 - same / longest)


#: Words that make a line control flow or a definition.
CONTROL, DEFINITION = ("if ", "elif ", "else:", "for ", "while ", "try:", "except:", "with "), ("def ", "function ", "class ")


def complexity(text: Column) -> Column:
    """Lines with control flow and lines with a definition, as a share of all lines; 1 at most."""
    lines = F.split(text, "\n")

    def holding(words: tuple[str, ...]) -> Column:
        """How many lines hold any of the words, which are plain text."""
        return F.size(F.filter(lines, lambda x: reduce(or_, (F.contains(x, F.lit(w)) for w in words))))

    return F.least(F.lit(1.0), (holding(CONTROL) + holding(DEFINITION)) / F.size(lines))


def severity_from_response(x: Column) -> Column:
    return chosen(F.lower(F.trim(x)), SEVERITY_FROM_RESPONSE, F.lit("medium"))


def category_from_response(x: Column) -> Column:
    key = F.lower(F.trim(x))
    return F.when(key.isin(*CATEGORIES), key).otherwise(chosen(key, CATEGORY_FROM_RESPONSE, F.lit("style")))


def clamped(x: Column, default: float = 0.5) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x, F.lit(default))))


def severity_to_store(x: Column) -> Column:
    return chosen(F.lower(x), SEVERITY_TO_STORE, F.upper(x))
