"""The live tail of workflows: pages behind a client's cursor, heartbeats while nothing comes, and an end.

Each workflow with a client is a key with state: the sequence number delivered
last, events that wait for their page, and whether it has ended. Timers of the
processing time poll for the next page and beat when a workflow is idle, so beats
come without any event. Needs the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import TERMINAL

#: Events of a page, milliseconds between polls and between beats.
PAGE, POLL, BEAT = 50, 500, 30_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAMES = "workflow_id string, sequence long, kind string, frame string"


class Tail(StatefulProcessor):
    """Rows in (workflow_id, sequence, event_type, event_id) become frames; with an initial state of (workflow_id, last_event_id) a client goes on behind that number."""

    def __init__(self, page: int = PAGE, poll: int = POLL, beat: int = BEAT):
        self.page, self.poll, self.beat = page, poll, beat

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "sequence long, ended boolean")
        self.waiting = handle.getMapState("waiting", "sequence long", "event_type string, event_id long")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.cursor.update((max((int(x) for x in initialState["last_event_id"]), default=0), False))

    def _page(self, workflow: str, now: int, idle: str | None) -> pd.DataFrame:
        """The next page, or what idle says if none waits; and the timer for what comes next."""
        sequence, ended = self.cursor.get() if self.cursor.exists() else (0, False)
        # Of waiting events only the numbers are held, and the rows of a page.
        due = sorted(k[0] for k in self.waiting.keys())[: self.page] if not ended else []
        out = []
        for n in due:
            kind, event = self.waiting.getValue((n,))
            self.waiting.removeKey((n,))
            if ended:
                continue
            data = json.dumps({"workflow_id": workflow, "sequence_number": n, "event_type": kind, "event_id": event})
            out.append((workflow, n, "activity", f"event: activity\nid: {n}\ndata: {data}\n\n"))
            sequence, ended = n, kind in TERMINAL
            if ended:
                out.append((workflow, n, "close", f"event: close\ndata: {json.dumps({'reason': kind})}\n\n"))
        if not due and not ended and idle:
            out.append((workflow, sequence, "heartbeat", idle))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ended:
            self.waiting.clear()
        else:
            more = next(iter(self.waiting.keys()), None) is not None
            self.handle.registerTimer(now + (self.poll if more else self.beat))
        self.cursor.update((sequence, ended))
        return pd.DataFrame(out, columns=["workflow_id", "sequence", "kind", "frame"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sequence, ended = self.cursor.get() if self.cursor.exists() else (0, False)
        for part in rows:
            for n, kind, event in zip(part["sequence"], part["event_type"], part["event_id"], strict=True):
                if n > sequence and not ended:
                    self.waiting.updateValue((int(n),), (kind, int(event)))
        yield self._page(key[0], timerValues.getCurrentProcessingTimeInMs(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._page(key[0], timerValues.getCurrentProcessingTimeInMs(), ": heartbeat\n\n")

    def close(self) -> None:
        pass


def live_tail(events: DataFrame, cursors: DataFrame | None = None, page: int = PAGE, poll: int = POLL, beat: int = BEAT) -> DataFrame:
    """events (a stream of workflow_id, sequence, event_type, event_id) as frames per workflow: workflow_id, sequence, kind, frame. cursors: workflow_id, last_event_id of clients that come back. The session must use PROVIDER."""
    rows = events.select("workflow_id", "sequence", "event_type", "event_id").groupBy("workflow_id")
    initial = None if cursors is None else cursors.select("workflow_id", "last_event_id").groupBy("workflow_id")
    return rows.transformWithStateInPandas(statefulProcessor=Tail(page, poll, beat), outputStructType=FRAMES, outputMode="Append", timeMode="ProcessingTime", initialState=initial)
