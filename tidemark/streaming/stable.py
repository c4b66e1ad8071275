"""Stateful streams over keyed snapshots. A key's rows of one micro-batch are put in order together."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stable_files(events: DataFrame, attempts: int = 6) -> DataFrame:
    """Paths whose size and time were the same in two snapshots in a row (path, size, mtime, seen), each told once.

    After ``attempts`` snapshots without rest, a path is given up. State is one small tuple a path.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, mtime, tries, done = state.get if state.exists else (-1, -1, 0, False)
        out = []
        for row in pd.concat(list(frames)).sort_values("seen", kind="stable").itertuples():
            if done or tries >= attempts:
                continue
            if (row.size, row.mtime) == (size, mtime):
                done = True
                out.append((key[0], int(row.size), int(row.seen)))
            size, mtime, tries = int(row.size), int(row.mtime), tries + 1
        state.update((size, mtime, tries, done))
        yield pd.DataFrame(out, columns=["path", "size", "stable_at"])

    return events.groupBy("path").applyInPandasWithState(run, "path string, size long, stable_at long", "size long, mtime long, tries int, done boolean", "append", GroupStateTimeout.NoTimeout)


def paired_intervals(log: DataFrame) -> DataFrame:
    """Intervals from start and end lines (media, seq, kind, t, dur) as they come, the open start kept between batches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
            if row.kind == "start":
                started = int(row.t)
            else:
                out.append((key[0], max(started if started is not None else int(row.t - row.dur), 0), int(row.t)))
                started = None
        state.update((started,))
        yield pd.DataFrame(out, columns=["media", "s", "e"])

    return log.groupBy("media").applyInPandasWithState(run, "media string, s long, e long", "started long", "append", GroupStateTimeout.NoTimeout)
