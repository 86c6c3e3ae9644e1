"""The states of service keys over a stream of events, by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.key_state import OUTPUT, State, advance, as_events, events_of, frame_of, row_of

_STATE = "until long, last long, refusals long, ok long, failed long, rejected long"
_EVENT = "micros long, seq long, code int, retry_after double, usual double, control string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Follower(StatefulProcessor):
    """Keeps what has come until the watermark passes it, then takes it in order of time: so a
    stream that comes shuffled, or late by less than the watermark allows, gives what its table would.

    Calls to the state store cost far more than events, so their number goes with the keys of a batch: a list is
    written at once, and a key has one timer a batch, for the first event that came, not one for each."""

    def __init__(self, min_gap: float):
        self.min_gap = min_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)
        self.waiting = handle.getListState("waiting", _EVENT)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803, ANN001
        self.state.update((int(initialState["until"].iloc[0]), 0, 0, 0, 0, 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        came = [(e.micros, e.seq, e.code, e.retry_after, e.usual, e.control) for frame in rows for e in events_of(frame)]
        if came:
            self.waiting.appendList(came)
            self._wake(came)
        yield from ()

    def _wake(self, events: list[tuple]) -> None:
        """A timer for the first of the events: once the watermark is there, no event of the time before can come."""
        self.handle.registerTimer(min(x[0] for x in events) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(x) for x in self.waiting.get()]
        due = [x for x in waiting if x[0] < limit]
        if not due:
            return
        held = self.state.get() if self.state.exists() else None
        state, made = State(*(int(x) for x in held)) if held else State(), []
        frame = pd.DataFrame(due, columns=[c.split(" ")[0] for c in _EVENT.split(", ")]).sort_values(["micros", "seq"])
        for event in events_of(frame):
            state, free = advance(state, event, self.min_gap)
            made.append(row_of(*key, event, state, free))
        self.state.update((state.until, state.last, state.refusals, state.ok, state.failed, state.rejected))
        later = [x for x in waiting if x[0] >= limit]
        if later:
            self.waiting.put(later)
            self._wake(later)
        else:
            self.waiting.clear()
        yield frame_of(made)

    def close(self) -> None:
        pass


def follow(stream: DataFrame, min_gap: float, late: str = "1 hour", restored: DataFrame | None = None) -> DataFrame:
    """The rows of `replay` for a stream of events, as the watermark passes them. Events later than
    `late` are dropped. restored: provider, key, until, as `kept_rests` gives them."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    events = as_events(stream.withWatermark("ts", late))
    first = None if restored is None else restored.selectExpr("CAST(provider AS string) AS provider", "CAST(key AS string) AS key", "CAST(until AS long) AS until").groupBy("provider", "key")
    return events.groupBy("provider", "key").transformWithStateInPandas(_Follower(min_gap), OUTPUT, "Append", "eventTime", first)
