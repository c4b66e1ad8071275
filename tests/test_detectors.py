"""Streams with several states: raw logs against the batch readers, and paths that come to rest."""

import os
import time

import pandas as pd
import pytest
from test_streams import until

from tidemark.sources import logs
from tidemark.streaming import detectors


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, detectors.STORE)
    yield spark
    spark.conf.set(name, before)


def lines(media, texts, first=0):
    return pd.DataFrame({"media": [media] * len(texts), "seq": range(first, first + len(texts)), "value": texts})


LOG = [
    "[silencedetect @ 0x1] silence_start: 1.5", "frame:0 pts:0 pts_time:0.5", "lavfi.astats.Overall.RMS_level=-23.5", "noise", "[silencedetect @ 0x1] silence_end: 2.25 | silence_duration: 0.75",
    "frame:1 pts_time:1", "frame:2 pts_time:1.5", "lavfi.astats.Overall.RMS_level=-inf", "lavfi.astats.Overall.RMS_level=-9", "lavfi.freezedetect.freeze_start: 3", None,
    "lavfi.freezedetect.freeze_duration: 1", "lavfi.freezedetect.freeze_end: 4.5 freeze_duration: 1.5", "silence_end: 0.5 | silence_duration: 2", "silence_start: -0.1", "pts_time:9",
]


def test_raw_lines_equal_the_batch_readers(rocks, tmp_path):
    """Two batches, the second begins while a silence is open and a time waits for its level."""
    spark, shape = rocks, "media string, seq long, value string"
    last = ["RMS_level=-3.25", "silence_end: 7 | silence_duration: 7"]
    lines("m", LOG).iloc[::-1].to_parquet(tmp_path / "1.parquet")
    lines("n", ["silence_start: 4"]).to_parquet(tmp_path / "2.parquet")
    os.utime(tmp_path / "1.parquet", (1, 1))
    os.utime(tmp_path / "2.parquet", (2, 2))
    lines("m", last, len(LOG)).to_parquet(tmp_path / "3.parquet")
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = until(spark, detectors.detected(stream), "detected_out", 6, 60)
    table = spark.read.schema(shape).parquet(str(tmp_path)).where("media = 'm'")
    want = [("m", "silence", r.s, r.e, None) for r in logs.silence_segments(table, ["media"], "seq").collect()]
    want += [("m", "freeze", r.s, r.e, None) for r in logs.freeze_segments(table, ["media"], "seq").collect()]
    want += [("m", "volume", r.t, None, r.level) for r in logs.volume_samples(table, ["media"], "seq").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) == 7


def test_silent_media_are_forgotten(rocks, tmp_path):
    spark = rocks
    lines("m", ["silence_start: 1"]).to_parquet(tmp_path / "1.parquet")
    stream = spark.readStream.schema("media string, seq long, value string").parquet(str(tmp_path))
    query = detectors.detected(stream, 500).writeStream.format("memory").queryName("forgotten_out").outputMode("append").start()
    try:
        rows, end = None, time.time() + 60
        while time.time() < end and rows != 0:
            states = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
            rows = states[-1] if states and max(states) > 0 else None
            time.sleep(0.5)
        assert rows == 0
        lines("m", ["silence_end: 9 | silence_duration: 2"], 1).to_parquet(tmp_path / "2.parquet")
        while spark.table("forgotten_out").count() < 1 and time.time() < end and query.exception() is None:
            time.sleep(0.5)
    finally:
        query.stop()
    assert [tuple(r) for r in spark.table("forgotten_out").collect()] == [("m", "silence", 7_000_000, 9_000_000, None)]  # the start at 1 is no longer known


def probing(folder):
    """Sizes of a path look by look, counted in files, since tasks run in other processes."""

    def probe(path):
        import os

        looks = f"{folder}/{path}"
        n = os.path.getsize(looks) if os.path.exists(looks) else 0
        with open(looks, "a") as file:
            file.write("x")
        sizes = {"rest": [5, 7, 7], "grows": range(1, 99), "gone": [None] * 99, "late": [None, 4, 4], "locked": [3] * 99}[path]
        return None if sizes[n] is None else (sizes[n], 1, path != "locked" or n > 3)

    return probe


def test_paths_come_to_rest_or_are_given_up(rocks, tmp_path):
    (tmp_path / "events").mkdir()
    (tmp_path / "looks").mkdir()
    pd.DataFrame({"path": ["rest", "grows", "gone", "late", "locked", "rest", None]}).to_parquet(tmp_path / "events" / "1.parquet")
    stream = rocks.readStream.schema("path string").parquet(str(tmp_path / "events"))
    got = until(rocks, detectors.ready_files(stream, 300, 100, 6, probing(str(tmp_path / "looks"))), "ready_out", 5, 90)
    assert sorted(got) == [("gone", "given-up", None, 6), ("grows", "given-up", 6, 6), ("late", "ready", 4, 3), ("locked", "ready", 3, 5), ("rest", "ready", 7, 3)]


def test_snapshots_of_files(tmp_path):
    (tmp_path / "a.mkv").write_bytes(b"xyz")
    assert detectors.file_snapshot(f"file://{tmp_path}/a.mkv")[0] == 3 and detectors.file_snapshot(f"file://{tmp_path}/none") is None
