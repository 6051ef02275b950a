"""Circuit breakers of any number of calls: stretches of calls are summarised as functions of the state before them, and these are applied in order.

A breaker is closed with so many failures, half open with so many successes, or
open since some time. What a stretch of calls makes of a closed or half-open
breaker is worked out for each of these few states. What it makes of an open one
depends on which call is the first trial only; that is worked out for every call,
from the last one backwards, and kept as runs of equal results. So the stretches
of a key are summarised by many tasks, each in memory for one stretch, and a hot
key's calls never meet: only its summaries do, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOSED, HALF_OPEN, OPEN = 0, 1, 2
NAMES = ("closed", "half_open", "open")
#: Calls of a stretch, and seconds of the spans whose stretches different tasks may summarise.
STRETCH, SPAN = 20_000, 86_400
#: In place of the time of opening, where a stretch doesn't open the breaker.
UNCHANGED = -(1 << 62)


def summarised(failed: np.ndarray, at: np.ndarray, threshold: int, wait: int, successes: int, decay: bool) -> tuple[np.ndarray, np.ndarray]:
    """What calls in order of time make of a breaker, as rows (kind, count, opened, trips, absolute, failures).

    The first array has a row for closed with 0 to threshold - 1 failures and
    half open with 1 to successes - 1 successes. The second has rows for open
    ones, with the time in front up to which a trial may be due for the row to
    hold. failures is a number if absolute, else what is added to the one before.
    """
    n, late = len(failed), np.maximum(np.searchsorted(at, at + wait), np.arange(1, len(at) + 1))
    closed = [(CLOSED, f, UNCHANGED, 0, 1, f) for f in range(threshold)]
    # Half open with g successes at place g; at 0 the call is the first trial.
    half = [(HALF_OPEN, g, UNCHANGED, 0, 0, 0) for g in range(successes)]
    tried: list[tuple] = [()] * n
    for i in range(n - 1, -1, -1):
        if failed[i]:
            j = late[i]
            if j < n:
                kind, count, opened, trips, absolute, failures = tried[j]
                opened = int(at[i]) if opened == UNCHANGED else opened
                from_closed = (kind, count, opened, trips + 1, 1, failures if absolute else threshold + failures)
                from_trial = (kind, count, opened, trips + 1, absolute, failures if absolute else 1 + failures)
            else:
                from_closed, from_trial = ((OPEN, 0, int(at[i]), 1, a, f) for a, f in ((1, threshold), (0, 1)))
            closed = [*closed[1:], from_closed]
            half = [from_trial] * successes
        else:
            half = [*half[1:], closed[0]]
            closed = [closed[0], *closed[:-1]] if decay else [closed[0]] * threshold
        tried[i] = half[0]
    runs = []
    for i, row in enumerate(tried):
        if runs and runs[-1][1:] == row:
            runs[-1] = (int(at[i]), *row)
        else:
            runs.append((int(at[i]), *row))
    return np.array(closed + half[1:], np.int64).reshape(-1, 6), np.array(runs, np.int64).reshape(-1, 7)


def applied(state: tuple[int, int, int, int, int], entries: np.ndarray, runs: np.ndarray, threshold: int, wait: int) -> tuple[int, int, int, int, int]:
    """The state (kind, count, opened, trips, failures) after a stretch."""
    kind, count, opened, trips, failures = state
    if kind == OPEN:
        k = int(np.searchsorted(runs[:, 0], opened + wait))
        if k == len(runs):
            return state
        row = runs[k, 1:]
    else:
        row = entries[count if kind == CLOSED else threshold + count - 1]
    kind, count, since, more, absolute, change = row.tolist()
    return kind, count, opened if since == UNCHANGED else since, trips + more, change if absolute else failures + change


def _summaries(key_type: pa.DataType, threshold: int, wait: int, successes: int, decay: bool, stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, number, calls = None, 0, []

        def row() -> pa.RecordBatch:
            failed, at = zip(*calls, strict=True)
            entries, runs = summarised(np.array(failed, bool), np.array(at, np.int64), threshold, wait, successes, decay)
            return pa.RecordBatch.from_arrays([pa.array([where[0]], key_type), pa.array([where[1]], pa.int64()), pa.array([number], pa.int64()), pa.array([entries.tobytes()]), pa.array([runs.tobytes()])], names=["key", "span", "stretch", "entries", "runs"])

        for batch in batches:
            for key, span, failed, at in zip(*(batch.column(c).to_pylist() for c in ("key", "span", "failed", "at")), strict=True):
                if (key, span) != where or len(calls) == stretch:
                    if calls:
                        yield row()
                    number = number + 1 if (key, span) == where else 0
                    where, calls = (key, span), []
                calls.append((bool(failed), at))
        if calls:
            yield row()

    return run


def _folded(key_type: pa.DataType, threshold: int, wait: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, state, any_ = [], None, None, False

        def out() -> pa.RecordBatch:
            keys, states = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array([NAMES[s[0]] for s in states]), pa.array([s[4] for s in states], pa.int64()), pa.array([s[3] for s in states], pa.int64())], names=["key", "state", "failures", "trips"])

        for batch in batches:
            for k, entries, runs in zip(*(batch.column(c).to_pylist() for c in ("key", "entries", "runs")), strict=True):
                if not any_ or k != key:
                    if any_:
                        done.append((key, state))
                    any_, key, state = True, k, (CLOSED, 0, 0, 0, 0)
                state = applied(state, np.frombuffer(entries, np.int64).reshape(-1, 6), np.frombuffer(runs, np.int64).reshape(-1, 7), threshold, wait)
            if done:
                yield out()
                done = []
        if any_:
            done.append((key, state))
            yield out()

    return run


def breaker(df: DataFrame, key: str, order: list[str], failed: str, seconds: str, threshold: int = 5, wait: int = 60, successes: int = 3, decay: bool = False, stretch: int = STRETCH, span: int = SPAN) -> DataFrame:
    """State, failures and trips of each key's circuit breaker after all its calls, in order of time.

    Closed opens after threshold failures: in a row, or, with decay, net of
    successes. Open turns half open at the first call wait seconds after it
    opened; successes in half-open close it, a failure opens it again. seconds
    isn't null and doesn't fall in the order given. A null in failed is no failure.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    width, kind = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.schema[key].dataType
    told = kind.simpleString()
    rows = df.select(F.col(key).alias("key"), F.floor(F.col(seconds) / span).cast("long").alias("span"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.coalesce(F.col(failed), F.lit(False)).alias("failed"), F.col(seconds).cast("long").alias("at"))
    rows = rows.repartition(width, "key", "span").sortWithinPartitions("key", "span", *[f"_o{i}" for i in range(len(order))]).select("key", "span", "failed", "at")
    parts = rows.mapInArrow(_summaries(to_arrow_type(kind), threshold, wait, successes, decay, stretch), f"key {told}, span long, stretch long, entries binary, runs binary")
    parts = parts.repartition(width, "key").sortWithinPartitions("key", "span", "stretch")
    return parts.mapInArrow(_folded(to_arrow_type(kind), threshold, wait), f"key {told}, state string, failures long, trips long").withColumnRenamed("key", key)
