"""A watched directory as a stream with state for each path.

Events say that a file was seen, changed or removed. A path is ready once its length
has not changed for a while; a startup file is so at once. Ready paths are emitted
once, and never again until they are removed; failures wait before they are retried.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..errors import ConfigError
from ..functions.text import is_video
from ..operators.parts import group_of
from ..sources.files import depth_under
from ..sources.tables import shared_folder

STABLE_MS = 3000
TICK_MS = 1000
RETRY_MS = 5000
OUTPUT = "path string, status string, length long, at_ms long"
_KINDS = ("create", "modify", "remove", "startup", "failed", "busy", "done")
_STATE = "length long, changed_ms long, retry_ms long, seen boolean"


def relevant(events: DataFrame, root: str, max_depth: int = -1) -> DataFrame:
    """Events (path, kind, length, at_ms) of video files under the root: created, modified, removed, startup, failed, busy (locked when it was due) or done."""
    deep = depth_under(F.col("path"), root)
    fits = (deep >= 0) if max_depth < 0 else (deep >= 0) & (deep <= max_depth)
    return events.where(F.col("kind").isin(*_KINDS) & fits & is_video(F.col("path")))


def step(state: tuple | None, kind: str, length: int | None, at: int) -> tuple[tuple | None, str | None]:
    """The state (length, changed, retry, seen) after an event, and a status to emit."""
    if kind == "remove":
        return None, "removed" if state else None
    if kind == "done":
        return (state and (state[0], state[1], 0, True)), None
    if kind == "busy":
        return (state and (state[0], state[1], at + TICK_MS, False)), None
    if kind == "failed":
        return (state[0] if state else length or 0, state[1] if state else at, at + RETRY_MS, False), "retry"
    if state and state[3]:
        return state, None
    if kind == "startup":
        return (length or 0, at - STABLE_MS, state[2] if state else 0, False), None if state else "pending"
    if state is None:
        return (length or 0, at, 0, False), "pending"
    if state[0] != (length or 0):
        return (length or 0, at, state[2], False), None
    return state, None


def due(state: tuple) -> int:
    """When a state is ready, if nothing happens."""
    return max(state[1] + STABLE_MS, state[2])


class _Watch(StatefulProcessor):
    def __init__(self, tick_by_events: bool):
        self.tick_by_events = tick_by_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        path, out = key[0], []
        # Of a path's events in a batch only three short numbers each are held, as they come in any order.
        at_ms, kinds, lengths = array("q"), array("b"), array("q")
        for row in rows:
            at_ms.append(row["at_ms"])
            kinds.append(_KINDS.index(row["kind"]))
            lengths.append(-1 if row["length"] is None else row["length"])
        had = self.file.get()  # None without one; each question to the state is a message, so it is asked once
        state = tuple(had) if had is not None else None
        for k in sorted(range(len(at_ms)), key=at_ms.__getitem__):
            at, kind, length = at_ms[k], _KINDS[kinds[k]], None if lengths[k] < 0 else lengths[k]
            if self.tick_by_events and state and not state[3] and due(state) <= at:
                out.append((path, "ready", state[0], due(state)))
                state = (*state[:3], True)
            state, told = step(state, kind, length, at)
            if told:
                out.append((path, told, state[0] if state else 0, at))
        if state is None:
            if had is not None:
                self.file.clear()
        else:
            if had is None or state != tuple(had):
                self.file.update(state)
            if not self.tick_by_events and not state[3]:
                now = int(timerValues.getCurrentProcessingTimeInMs())
                self.handle.registerTimer(max(now + 1, due(state)))
        yield from (Row(path=p, status=s, length=n, at_ms=at) for p, s, n, at in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.file.exists():
            state = tuple(self.file.get())
            now = int(expiredTimerInfo.getExpiryTimeInMs())
            if not state[3] and due(state) <= now:
                self.file.update((*state[:3], True))
                yield Row(path=key[0], status="ready", length=state[0], at_ms=now)

    def close(self) -> None:
        pass


def watch(events: DataFrame, tick_by_events: bool = False) -> DataFrame:
    """Statuses of paths from a stream of relevant events: OUTPUT, with pending, ready, retry and removed.

    State is kept for each path alone, partitioned by path, and cleared when the file is
    removed. tick_by_events replays by the events' own clock: a path is ready at the
    first later event of its own, so a replay gives the same rows each time. Otherwise a
    processing-time timer fires. Needs the RocksDB state store.
    """
    return events.groupBy("path").transformWithState(
        statefulProcessor=_Watch(tick_by_events), outputStructType=OUTPUT, outputMode="Append", timeMode="None" if tick_by_events else "ProcessingTime"
    )


def ready_groups(ready: DataFrame, files: DataFrame) -> DataFrame:
    """The groups of split parts that ready paths belong to, from a listing of the files."""
    return group_of(files, ready.where("status = 'ready'"))


def start(statuses: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], **trigger):
    """Runs the query; each micro-batch goes to handle(frame, id). A restart goes on from the checkpoint."""
    return statuses.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": f"{TICK_MS} milliseconds"})).start()


def settled(gap_ms: Column) -> Column:
    """Whether a gap to the next event is long enough for a file to count as stable."""
    return F.coalesce(gap_ms >= STABLE_MS, F.lit(False))
