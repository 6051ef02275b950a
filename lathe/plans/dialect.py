"""Two dialects of one SQL text: Spark, reading a folder's Parquet files, and the ANSI-style SQL of the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .registry import register


class Dialect:
    """What differs between the engines; text is written once, with these as its parts."""

    def __init__(self, sf_dir: str | None):
        self.sf_dir, self.spark = sf_dir, sf_dir is not None

    def t(self, table: str) -> str:
        return f"parquet.`{self.sf_dir}/{table}.parquet`" if self.spark else table

    def lit(self, text: str) -> str:
        return "r'" + text.replace("'", "\\'") + "'" if self.spark else "'" + text.replace("'", "''") + "'"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.lit(pattern)})" if self.spark else f"regexp_matches({x}, {self.lit(pattern)})"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)}" + (")" if self.spark else ", 'g')")

    def count_matches(self, x: str, pattern: str) -> str:
        return f"CAST(regexp_count({x}, {self.lit(pattern)}) AS BIGINT)" if self.spark else f"CAST(len(regexp_extract_all({x}, {self.lit(pattern)})) AS BIGINT)"

    def split(self, x: str, sep: str) -> str:
        """By a plain string."""
        quoted = "".join("\\" + c if c in r".|*+?()[]{}^$\\" else c for c in sep)
        return f"split({x}, {self.lit(quoted)})" if self.spark else f"string_split({x}, '{sep}')"

    def size(self, x: str) -> str:
        return f"CAST(size({x}) AS BIGINT)" if self.spark else f"CAST(len({x}) AS BIGINT)"

    def at(self, x: str, i: str) -> str:
        """Element i from 1 on, null beyond the end."""
        return f"try_element_at({x}, CAST({i} AS INT))" if self.spark else f"({x})[CAST({i} AS INT)]"

    def rows_of(self, source: str, array: str, keep: str, value: str = "item", pos: str = "pos") -> str:
        """keep plus a row per element of array with its position from 1 on."""
        if self.spark:
            return f"SELECT {keep}, CAST(_p + 1 AS BIGINT) AS {pos}, _v AS {value} FROM {source} LATERAL VIEW posexplode({array}) _e AS _p, _v"
        return f"SELECT {keep}, CAST(unnest(range(1, len({array}) + 1)) AS BIGINT) AS {pos}, unnest({array}) AS {value} FROM {source}"

    def joined(self, x: str, sep: str, order: str) -> str:
        """String aggregate in order of a column."""
        if self.spark:
            return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {x} AS v))), s -> s.v), '{sep}')"
        return f"coalesce(string_agg({x}, '{sep}' ORDER BY {order}), '')"

    def joined_set(self, x: str, sep: str = ",") -> str:
        """Distinct values in order, as one string."""
        if self.spark:
            return f"array_join(array_sort(collect_set({x})), '{sep}')"
        return f"coalesce(array_to_string(list_sort(list_distinct(list({x}) FILTER ({x} IS NOT NULL))), '{sep}'), '')"

    def nth_sorted(self, x: str, index: str) -> str:
        """Element index (from 0 on) of the sorted values of a group."""
        if self.spark:
            return f"element_at(array_sort(collect_list({x})), CAST({index} AS INT) + 1)"
        return f"list_sort(list({x}))[CAST({index} AS INT) + 1]"

    def arg_max(self, x: str, by: str) -> str:
        return f"max_by({x}, {by})" if self.spark else f"arg_max({x}, {by})"

    def seconds_before(self, ts: str, seconds: int) -> str:
        return f"(CAST({ts} AS TIMESTAMP_NTZ) - INTERVAL '{seconds}' SECOND)" if self.spark else f"(CAST({ts} AS TIMESTAMP) - INTERVAL '{seconds}' SECOND)"

    def instr(self, x: str, y: str) -> str:
        return f"CAST(instr({x}, {y}) AS BIGINT)"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')" if self.spark else f"json_extract_string({x}, '$.{key}')"

    def text(self, x: str) -> str:
        return f"CAST({x} AS STRING)"


View = Callable[[Dialect], str]
VIEWS: dict[str, tuple[View, tuple[str, ...]]] = {}


def view(name: str, *needs: str):
    """Registers a derived view by the views that it reads."""

    def add(text: View) -> View:
        VIEWS[name] = text, needs
        return text

    return add


def _closure(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for n in names:
        if n not in seen:
            _closure(VIEWS[n][1], seen)
            if n not in seen:
                seen.append(n)
    return seen


def sql(d: Dialect, text: str, needs: tuple[str, ...] = ()) -> str:
    """The text behind the definitions of the views that it needs."""
    parts = [f"{n} AS ({VIEWS[n][0](d)})" for n in _closure(needs, [])]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or else one of the folder's tables."""
    d = Dialect(sf_dir)
    if name in VIEWS:
        return spark.sql(sql(d, f"SELECT * FROM {name}", (name,)))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(text: View, *needs: str) -> str:
    d = Dialect(None)
    return sql(d, text(d), needs)


def frame(name: str, text: View | None = None, *needs: str):
    """Registers a query built from DataFrame operators, with the SQL that must give the same."""
    return register(name, None if text is None else oracle(text, *needs))
