"""Streams with several states and timers a key: raw detector logs to segments and samples, watched paths to ready files.

Both need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``) and the RocksDB checkpoint that goes with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources import logs
from tidemark.sources.readers import _us

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Snapshot = tuple[int, int, bool]


class _Timed(StatefulProcessor):
    """A processor with one timer a key, which each ``arm`` sets anew."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long")
        self.states(handle)

    def arm(self, now: int, wait: int) -> None:
        self.disarm()
        self.handle.registerTimer(now + wait)
        self.due.update((now + wait,))

    def disarm(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def close(self) -> None:
        pass


class _Detector(_Timed):
    """Open starts of silence and of frozen pictures, and the time that waits for its level."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.open = {kind: handle.getValueState(kind, "t long") for kind in ("silence", "freeze", "volume")}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was = {kind: state.get()[0] if state.exists() else None for kind, state in self.open.items()}
        now = dict(was)
        for row in sorted(rows, key=lambda r: r.seq):
            for kind in ("silence", "freeze"):
                start, end, lasted = row[f"{kind}_start"], row[f"{kind}_end"], row[f"{kind}_duration"]
                if start is not None:
                    now[kind] = start
                elif end is not None and lasted is not None:
                    yield Row(media=key[0], kind=kind, s=max(end - lasted if now[kind] is None else now[kind], 0), e=end, level=None)
                    now[kind] = None
            if row.time is not None:
                now["volume"] = row.time
            elif row.level is not None and now["volume"] is not None:
                yield Row(media=key[0], kind="volume", s=now["volume"], e=None, level=row.level)
                now["volume"] = None
        for kind, state in self.open.items():
            if now[kind] is None and was[kind] is not None:
                state.clear()
            elif now[kind] != was[kind]:
                state.update((now[kind],))
        self.arm(timerValues.getCurrentProcessingTimeInMs(), self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for state in self.open.values():
            state.clear()
        self.due.clear()
        return iter([])


def detected(lines: DataFrame, idle_ms: int = 600_000) -> DataFrame:
    """Segments and samples (media, kind, s, e, level) from a stream of raw log lines (media, seq, value) of all detectors.

    Kinds: silence and freeze, with start and end in microseconds, and volume, with its time in s and its level. The rules are those of
    the batch readers in ``sources.logs``. What is open between batches is three numbers a medium; a medium that has been
    silent for ``idle_ms`` is forgotten, so state ends with the logs. A medium's lines come in order from batch to batch;
    within one they are sorted by seq. Lines that tell nothing of these kinds, and null ones, are dropped before.
    """
    number = lambda name: logs._number("value", rf"{name}:\s*{logs.NUMBER}")
    level = F.regexp_extract("value", r"RMS_level=(-?\d+(?:\.\d+)?|-inf)", 1)
    columns = {f"{kind}_{x}": _us(number(f"{kind}_{x}")) for kind in ("silence", "freeze") for x in ("start", "end", "duration")}
    columns["time"] = _us(logs._number("value", "pts_time:" + logs.NUMBER))
    columns["level"] = F.when(level != "", F.coalesce(level.try_cast("double"), F.lit(float("-inf"))))
    rows = lines.where("media is not null and value is not null").select("media", "seq", *(c.alias(n) for n, c in columns.items()))
    told: Column = F.coalesce(*(F.col(n).cast("double") for n in columns)).isNotNull()
    return rows.where(told).groupBy("media").transformWithState(_Detector(idle_ms), "media string, kind string, s long, e long, level double", "append", "ProcessingTime")


def file_snapshot(path: str) -> Snapshot | None:
    """Size, time of the last change in nanoseconds and whether it can be read, of a file in any store that Arrow knows; None if it isn't there."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    info = store.get_file_info(name)
    if info.type != fs.FileType.File:
        return None
    try:
        store.open_input_file(name).close()
    except OSError:
        return info.size, info.mtime_ns or 0, False
    return info.size, info.mtime_ns or 0, True


class _Watcher(_Timed):
    """A path's last snapshot and how often it was looked at since its last event."""

    def __init__(self, probe: Callable[[str], Snapshot | None], wait_ms: int, poll_ms: int, attempts: int):
        self.probe, self.wait, self.poll, self.attempts = probe, wait_ms, poll_ms, attempts

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "size long, mtime long, tries int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for _ in rows:  # each event begins anew, whatever it tells
            pass
        self.seen.update((-1, -1, 0))
        self.arm(timerValues.getCurrentProcessingTimeInMs(), self.wait)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        size, mtime, tries = self.seen.get()
        self.due.clear()
        found = self.probe(key[0])
        if found is not None and tuple(found[:2]) == (size, mtime) and found[2]:
            self.seen.clear()
            yield Row(path=key[0], state="ready", size=size, tries=tries + 1)
        elif tries + 1 >= self.attempts:
            self.seen.clear()
            yield Row(path=key[0], state="given-up", size=None if found is None else found[0], tries=tries + 1)
        else:
            self.seen.update((*(found[:2] if found is not None else (size, mtime)), tries + 1))
            self.arm(timerValues.getCurrentProcessingTimeInMs(), self.poll)


def ready_files(events: DataFrame, wait_ms: int = 20_000, poll_ms: int = 2_000, attempts: int = 6, probe: Callable[[str], Snapshot | None] = file_snapshot) -> DataFrame:
    """Paths of a stream of events (path) that have come to rest: path, state ('ready' or 'given-up'), size, tries.

    An event sets the path's timer to ``wait_ms``. When it runs out the path is looked at, and again every ``poll_ms``,
    until two looks in a row find the same size and time and the file can be read; after ``attempts`` looks it is given up. A
    further event begins anew. State is one small tuple a path and goes once the path is told. Null paths are left out.
    ``probe`` runs where the state is, so it must see the files' store.
    """
    return events.where("path is not null").select("path").groupBy("path").transformWithState(_Watcher(probe, wait_ms, poll_ms, attempts), "path string, state string, size long, tries int", "append", "ProcessingTime")
