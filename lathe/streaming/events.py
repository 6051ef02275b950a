"""Structured Streaming over the event log: sequences, windows, tails up to the terminal event, heartbeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import TERMINAL

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files of a folder as a stream: reads only what is named like events, as it arrives."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def next_sequences(events: DataFrame) -> DataFrame:
    """Last sequence number of every workflow."""
    return events.groupBy(F.concat(F.lit("wf-"), F.col("user_id").cast("string")).alias("workflow_id")).agg(F.count(F.lit(1)).alias("last_sequence"))


def windowed(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start_at"), "event_type", "n", "total")


def _numbered(until_end: bool):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Numbers a workflow's events of a batch in order of time, however many frames they come in; ends its stream after the first terminal one if asked to."""
        sequence, ended = state.get if state.exists else (0, False)
        parts = list(frames)
        ts, ids, kinds = (np.concatenate([f[name].to_numpy() for f in parts]) for name in ("ts", "event_id", "event_type"))
        order = np.lexsort((ids, ts))
        ids, kinds = ids[order], kinds[order]
        ends = np.flatnonzero(np.isin(kinds.astype(str), TERMINAL))
        kept = len(ids)
        if until_end:
            kept = 0 if ended else ends[0] + 1 if len(ends) else kept
        if kept:
            yield pd.DataFrame({"workflow_id": key[0], "event_id": ids[:kept], "sequence": np.arange(sequence + 1, sequence + kept + 1), "event_type": kinds[:kept]})
        state.update((sequence + int(kept), bool(ended or len(ends))))

    return run


def appended(events: DataFrame, until_end: bool = False) -> DataFrame:
    """Events as the log takes them in: each with its workflow's next sequence number, in order of arrival; with until_end none after a terminal one."""
    named = events.select(F.concat(F.lit("wf-"), F.col("user_id").cast("string")).alias("workflow_id"), "ts", "event_id", F.when(F.col("event_type") == "purchase", TERMINAL[0]).otherwise(F.col("event_type")).alias("event_type"))
    return named.groupBy("workflow_id").applyInPandasWithState(_numbered(until_end), "workflow_id string, event_id long, sequence long, event_type string", "sequence long, ended boolean", "append", GroupStateTimeout.NoTimeout)


def heartbeats(events: DataFrame, every: int = 30) -> DataFrame:
    """Beats of the idle stretches of a workflow's log (workflow_id, ts): one every so many seconds after an event while nothing comes, up to the next event."""
    order = Window.partitionBy("workflow_id").orderBy("ts")
    gaps = events.withColumn("next", F.lead("ts").over(order)).withColumn("idle", F.unix_timestamp(F.col("next").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp")))
    beats = F.floor((F.col("idle") - 1) / every)
    return gaps.where(beats >= 1).select("workflow_id", F.col("ts").alias("after"), beats.cast("long").alias("beats"))


def frames(page: DataFrame) -> DataFrame:
    """Server-sent text of events (workflow_id, sequence, event_type, event_id): an activity frame each, and after a terminal one the closing frame."""
    data = F.to_json(F.struct("workflow_id", F.col("sequence").alias("sequence_number"), "event_type", "event_id"))
    text = F.concat(F.lit("event: activity\nid: "), F.col("sequence").cast("string"), F.lit("\ndata: "), data, F.lit("\n\n"))
    close = F.concat(F.lit("event: close\ndata: "), F.to_json(F.struct(F.col("event_type").alias("reason"))), F.lit("\n\n"))
    return page.select("workflow_id", "sequence", F.concat(text, F.when(F.col("event_type").isin(*TERMINAL), close).otherwise("")).alias("frame"))


def connected(workflow: str, cursor: int) -> str:
    """The first frame of a connection, with the sequence number that the client has already."""
    return f'event: connected\ndata: {{"workflow_id": "{workflow}", "sequence": {cursor}}}\n\n'


def written(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there, appends its rows to a folder and returns all of them. A later call with the same checkpoint goes on where this one ended; files keep what was written, so a lost executor loses nothing."""
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)
