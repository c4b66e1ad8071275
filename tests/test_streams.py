"""Streams with timers, and work that goes on where an earlier run stopped."""

import time

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import folds
from tidemark.streaming import stable, watch


def until(spark, stream, name, want, seconds=40):
    """The rows of a stream's memory table once there are ``want``, or after ``seconds``."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        end = time.time() + seconds
        while spark.table(name).count() < want and time.time() < end and query.exception() is None:
            time.sleep(0.5)
    finally:
        query.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_settled_tells_the_last_state_once(spark, tmp_path):
    pd.DataFrame({"path": ["a", "a", "b", None], "size": [1, 3, 2, 9], "mtime": [5, 6, 5, 9], "seen": [1, 2, 1, 9]}).to_parquet(tmp_path / "e.parquet")
    stream = spark.readStream.schema("path string, size long, mtime long, seen long").parquet(str(tmp_path))
    assert sorted(until(spark, watch.settled(stream, 1000), "settled_out", 2)) == [("a", 3, 6, 2), ("b", 2, 5, 1)]


def test_frame_cues_equal_the_batch_rules(spark, tmp_path):
    texts = ["hello there", "hello there", "", "hello there", "", "", "hello there", "quite another", None, "quite another!"]
    frames = pd.DataFrame({"media": ["m"] * 10 + ["n"], "frame": [*range(10), 0], "t": [i * 100_000 for i in range(10)] + [0], "text": [*texts, "only"], "conf": [0.5] * 10 + [None]})
    frames.to_parquet(tmp_path / "f.parquet")
    shape = "media string, frame long, t long, text string, conf double"
    got = until(spark, watch.frame_cues(spark.readStream.schema(shape).parquet(str(tmp_path)), 100_000, 0.86, 1, 50_000, 1000), "cues_out", 4)
    want = folds.merge_frames(spark.read.schema(shape).parquet(str(tmp_path)).fillna(0.0, ["conf"]), ["media"], 100_000, 0.86, 1, 50_000)
    assert sorted(got) == sorted(tuple(r) for r in want.select("media", "s", "e", "text", "conf").collect())
    assert [c[1:4] for c in sorted(got)] == [(0, 400_000, "hello there"), (600_000, 700_000, "hello there"), (700_000, 1_000_000, "quite another!"), (0, 100_000, "only")]


def test_arrivals_by_pattern(spark, tmp_path):
    for name, size in (("a.mkv", 3), ("b.MKV", 2), ("c.txt", 1), ("d.mkv", 0)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = until(spark, watch.arrivals(spark, str(tmp_path)), "arrivals_out", 2)
    assert sorted((r[0].rsplit("/", 1)[1], r[1]) for r in got) == [("a.mkv", 3), ("b.MKV", 2)]


def test_resumed_does_only_what_is_open(spark, tmp_path):
    made = []

    def work(rows):
        made.append(sorted(r["chunk"] for r in rows.select("chunk").collect()))
        return rows.where("chunk <> 2").select("signature", "chunk", (F.col("x") * 10).alias("y"))

    chunks = spark.createDataFrame([("s", 1, 1), ("s", 2, 2), ("s", 3, 3)], "signature string, chunk int, x int")
    first = watch.resumed(chunks.where("chunk < 3"), str(tmp_path / "r"), work).collect()
    again = watch.resumed(chunks, str(tmp_path / "r"), work).collect()
    other = watch.resumed(chunks.withColumn("signature", F.lit("t")), str(tmp_path / "r"), work).collect()
    assert made == [[1, 2], [3], [1, 2, 3]]
    assert [sorted(r["y"] for r in got) for got in (first, again, other)] == [[10], [10, 30], [10, 30]]


def test_signatures_tell_options_apart(spark):
    one = spark.range(1).select(watch.chunk_signature(F.lit("a"), F.lit(1)), watch.chunk_signature(F.lit("a"), F.lit(2)), watch.chunk_signature(F.lit("a"), F.lit(None))).first()
    assert len(set(one)) == 3 and all(len(x) == 16 for x in one)


def test_log_lines_are_paired_in_order_over_arrow_batches(spark, tmp_path):
    """Two lines an Arrow batch, the log backwards: order must hold over the whole micro-batch."""
    log = [("m", i, "end" if i % 2 else "start", i * 10, 10) for i in range(20)][::-1]
    pd.DataFrame(log, columns=["media", "seq", "kind", "t", "dur"]).to_parquet(tmp_path / "l.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        stream = spark.readStream.schema("media string, seq long, kind string, t long, dur long").parquet(str(tmp_path))
        got = until(spark, stable.paired_intervals(stream), "paired_out", 10, 40)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got) == [("m", i * 10, i * 10 + 10) for i in range(0, 20, 2)]
