"""Streams of a watched folder and of recognised frames, and work that goes on where an earlier run stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import text as T
from tidemark.operators import cleaning


def arrivals(spark: SparkSession, folder: str, pattern: str = "*.[mM][kK][vV]") -> DataFrame:
    """A stream of the files that appear in ``folder`` (path, size, mtime and seen in milliseconds); their content isn't read.

    Spark's file source tells each path once and passes over empty files; changes of a file that it has told come from
    a listing of one's own.
    """
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), F.unix_millis(F.current_timestamp()).alias("seen"))


def settled(events: DataFrame, wait_ms: int = 20_000) -> DataFrame:
    """Paths (path, size, mtime, seen) without a further event for ``wait_ms`` of processing time, as last seen.

    Each event sets the path's timer anew. When it runs out the path is told and its state dropped, so state holds only
    paths that are still changing; a later event begins again. Rows without a path are left out.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            size, mtime, seen = state.get
            state.remove()
            yield pd.DataFrame([(key[0], size, mtime, seen)], columns=["path", "size", "mtime", "seen"])
            return
        last = state.get if state.exists else None
        for pdf in frames:
            row = tuple(pdf.sort_values(["seen", "mtime"], kind="stable")[["size", "mtime", "seen"]].iloc[-1].tolist())
            last = row if last is None or row[2] >= last[2] else last
        state.update(tuple(int(x) for x in last))
        state.setTimeoutDuration(wait_ms)

    kept = events.where("path is not null").fillna(0, ["size", "mtime", "seen"])
    return kept.groupBy("path").applyInPandasWithState(run, "path string, size long, mtime long, seen long", "size long, mtime long, seen long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def frame_cues(frames: DataFrame, interval: int, similarity: float, max_gap: int, min_duration: int, idle_ms: int = 60_000) -> DataFrame:
    """Cues (media, s, e, text, conf) from a stream of frames (media, t, text, conf), told when they end.

    The rules are those of ``folds.merge_frames`` without its last step, which joins finished neighbours. A cue ends at
    a text that isn't similar, after more than ``max_gap`` blank frames, or when its medium has been silent for
    ``idle_ms``. State is the open cue of each medium. A medium's frames must come in order from batch to batch; within
    one they are sorted. Null texts are blank, null confidences 0.
    """

    def told(media, cue: tuple) -> tuple:
        start, last, text, total, n, _ = cue
        return media, start, max(start + min_duration, last + interval), text, total / n

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cue = state.get if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append(told(key[0], cue))
            cue = None
        else:
            rows = pd.concat(list(batches)).sort_values("t", kind="stable")
            for t, text, conf in zip(rows["t"].tolist(), rows["text"].tolist(), rows["conf"].tolist(), strict=True):
                like = cleaning.similarity(cue[2], text) if cue and text else 0.0
                if not text:
                    cue = cue and (*cue[:5], cue[5] + 1)
                    if cue and cue[5] > max_gap:
                        out.append(told(key[0], cue))
                        cue = None
                elif cue and like >= similarity:
                    longer = len(text) > len(cue[2]) and like >= 0.92
                    cue = (cue[0], t, text if longer else cue[2], cue[3] + conf, cue[4] + 1, 0)
                else:
                    if cue:
                        out.append(told(key[0], cue))
                    cue = (t, t, text, conf, 1, 0)
        if cue:
            state.update(cue)
            state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["media", "s", "e", "text", "conf"])

    tidy = frames.select("media", "t", T.normalize_text(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce(F.col("conf").cast("double"), F.lit(0.0)).alias("conf"))
    return tidy.groupBy("media").applyInPandasWithState(
        run, "media string, s long, e long, text string, conf double", "start long, last long, text string, total double, n long, blanks long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def chunk_signature(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of the parts joined by '|': names the source and the options that a chunk was made with."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)


def resumed(chunks: DataFrame, folder: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work``'s rows of all ``chunks`` (signature, chunk, ...), done only for those that ``folder`` doesn't have yet.

    ``work`` keeps signature and chunk. Its rows replace those of the same chunks, and only then are the chunks noted as
    done, so a run that was lost half-way is repeated without doubling rows. Chunks without rows count as done too.
    """
    spark = chunks.sparkSession

    def table(name: str, like: DataFrame) -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return spark.read.schema(like.schema).parquet(f"{folder}/{name}") if there else spark.createDataFrame([], like.schema)

    keys = ["signature", "chunk"]
    wanted = chunks.select(*keys).distinct()
    open_ = chunks.join(table("done", wanted), keys, "left_anti")
    made = work(open_)
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{folder}/rows")
    open_.select(*keys).distinct().write.mode("append").parquet(f"{folder}/done")
    return table("rows", made).join(wanted, keys, "left_semi")
