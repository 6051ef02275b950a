"""Sinks that write once: a stream's batches go into a store with their number, so a batch that is repeated is found there already."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .store import Store


def _run(stream: DataFrame, checkpoint: str, each, mode: str) -> None:
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def _once(write, name: str):
    def each(rows: DataFrame, batch: int) -> None:
        # Evaluated once, and in any case: a stateful stream's batch must be, for its state, also if its rows are there already.
        rows = rows.persist()
        try:
            rows.write.format("noop").mode("overwrite").save()
            write(rows, f"{name}-{batch}")
        finally:
            rows.unpersist()

    return each


def append_batch(store: Store, name: str):
    """What a stream does with each batch: appends its rows under the batch's number, unless they are there."""

    return _once(lambda rows, token: store.append(rows, token), name)


def upsert_batch(store: Store, name: str):
    """Replaces the rows of the keys that a batch holds. Repeating it changes nothing, with or without its number."""

    merge = lambda old, new: old.join(new.select(*store.keys), store.keys, "left_anti").unionByName(new)
    return _once(lambda rows, token: store.change(rows, merge, token), name)


def appended_to(stream: DataFrame, store: Store, checkpoint: str, name: str = "batch") -> DataFrame:
    """Runs a stream over what is there, appends its rows to the store and returns all of these. A later call with the same checkpoint goes on where this one ended."""
    _run(stream, checkpoint, append_batch(store, name), "append")
    return store.read()


def upserted_to(stream: DataFrame, store: Store, checkpoint: str, name: str = "batch") -> DataFrame:
    """Runs an aggregating stream over what is there; each batch replaces the groups that it has changed, so neither the driver nor a batch holds all groups."""
    _run(stream, checkpoint, upsert_batch(store, name), "update")
    return store.read()
