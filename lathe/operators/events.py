"""Event log: sequences, cursors and terminal events over a table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Events after which a workflow's stream ends.
TERMINAL = ("workflow_completed", "workflow_failed")


def sequenced(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def since(events: DataFrame, key: str, after: int, page: int) -> DataFrame:
    """The next page of each key after a sequence number."""
    later = events.where(F.col("sequence") > after)
    return later.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("sequence"))).where(F.col("_r") <= page).drop("_r")


def until_terminal(events: DataFrame, key: str) -> DataFrame:
    """Events up to and including the key's first terminal one."""
    ends = F.min(F.when(F.col("event_type").isin(*TERMINAL), F.col("sequence"))).over(Window.partitionBy(key))
    return events.withColumn("_end", ends).where(F.col("_end").isNull() | (F.col("sequence") <= F.col("_end"))).drop("_end")
