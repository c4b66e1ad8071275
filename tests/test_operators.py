"""Values of known cases, and properties, of the operators outside the text corpus folder."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import align, folds, intervals, maintain, rules, sequences
from tidemark.plans import catalog, keyed, matching, review, shortlist  # noqa: F401  (the others add their queries)
from tidemark.sources import readers, writers

SEC = 1_000_000
SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_exclude_wins_and_last_wins(spark):
    seg = spark.createDataFrame([("g", "seg-1", SEC, 2 * SEC), ("g", "seg-2", 3 * SEC, 4 * SEC)], "grp string, seg_id string, s long, e long")
    act = spark.createDataFrame([(0, "seg-1", "Keep"), (1, "seg-1", "Exclude"), (2, "seg-2", "Keep")], "pos int, seg_id string, action string")
    for policy in ("exclude_wins", "last"):
        assert rows(intervals.keep_intervals(seg, act, ["grp"], "seg_id", policy), "s", "e") == [(3 * SEC, 4 * SEC)]
    with pytest.raises(Exception, match="unknown segment"):
        intervals.keep_intervals(seg, spark.createDataFrame([(0, "nope", "Exclude")], "pos int, seg_id string, action string"), ["grp"], "seg_id").collect()


def test_merge_is_idempotent_and_gaps_fill_the_rest(spark):
    t = catalog.Tables(spark, SF)
    merged = intervals.merge_intervals(t.relative(), ["grp"])
    assert rows(merged, "grp", "s", "e") == rows(intervals.merge_intervals(merged.drop("members"), ["grp"]), "grp", "s", "e")
    gaps = intervals.invert_intervals(merged, t.totals(), ["grp"])
    covered = merged.selectExpr("e - s as d").unionByName(gaps.selectExpr("gap_end - gap_start as d")).agg(F.sum("d")).first()[0]
    assert covered == t.totals().agg(F.sum("total")).first()[0]


def test_overlap_else_nearest(spark):
    a = spark.createDataFrame([("g", "x", 10 * SEC, 12 * SEC), ("g", "y", 14 * SEC, 16 * SEC), ("g", "z", 90 * SEC, 91 * SEC)], "grp string, a_id string, s long, e long")
    b = spark.createDataFrame([("g", "p", 10_300_000, 11_800_000), ("g", "q", 16_400_000, 16_600_000)], "grp string, b_id string, s2 long, e2 long")
    got = {r["a_id"]: (r["b_id"], r["match_type"]) for r in intervals.overlap_or_nearest(a, b, ["grp"], 2 * SEC, 10 * SEC).collect()}
    assert got == {"x": ("p", "overlap"), "y": ("q", "nearest"), "z": (None, "none")}


def test_text_functions(spark):
    one = spark.range(1).select(
        T.srt_time(F.lit(3_723_004_000)).alias("srt"), T.ass_time(F.lit(1_209_999)).alias("ass"), T.ass_colour(F.lit(0xFF8000)).alias("colour"),
        T.char_accuracy(F.lit("笃：蜘蛛。"), F.lit("笃：蜘珠。")).alias("accuracy"), T.sequence_similarity(F.lit("abcd"), F.lit("bcde")).alias("ratio"),
        T.nfkc(F.lit("Ａ１")).alias("nfkc"), T.comment_key(F.lit(1_500_000), F.lit(1), F.lit("hi")).alias("key"),
    ).first()
    assert tuple(one) == ("01:02:03,004", "0:00:01.20", "&H0080FF&", pytest.approx(0.8), 0.75, "A1", "1.500|1|hi")


def test_file_names(spark):
    names = spark.createDataFrame([("[SubsPlease] Sousou no Frieren - 03 (1080p) [A1B2C3D4].mkv",), ("葬送的芙莉莲 第2季 第05话.mkv",)], "p string")
    got = [r["x"] for r in names.select(T.file_name_parts(F.col("p")).alias("x")).collect()]
    assert (got[0]["raw_title"], got[0]["normalized_title"], got[0]["episode"]) == ("Sousou no Frieren", "sousou no frieren", 3)
    assert (got[1]["raw_title"], got[1]["season"], got[1]["episode"]) == ("葬送的芙莉莲", 2, 5)


def test_comment_filter(spark):
    df = spark.createDataFrame([(SEC, 1, "hello", "a"), (2 * SEC, 7, "special", "b"), (3 * SEC, 5, "屏蔽词 test", "c")], "at long, mode int, content string, raw_key string")
    assert rows(rules.filter_comments(df, rules.block_words("屏蔽词"), None, True, 1_500_000), "at", "content") == [(2_500_000, "hello")]


def test_frames_become_one_cue(spark):
    frames = spark.createDataFrame([("m", 0, 0, "你好", 0.95), ("m", 1, SEC // 2, "你好", 0.91), ("m", 2, SEC, "", 0.0), ("m", 3, 3 * SEC // 2, "", 0.0)], "media string, frame long, t long, text string, conf double")
    got = folds.merge_frames(frames, ["media"], SEC // 2, 0.85, 1, 600_000).collect()
    assert [(r["s"], r["e"], r["text"]) for r in got] == [(0, SEC, "你好")]


def test_frame_merge_compares_whole_texts(spark, tmp_path):
    turns = [(1, 0, "Same start here, then a quiet walk by the river"), (1, 1, "Same start here. NOTHING ELSE IS LIKE IT AT ALL!"), (2, 0, "A long line of words that hardly changes"), (2, 1, "A long line of words that hardly changes.")]
    pd.DataFrame(turns, columns=["conv_id", "turn", "text"]).to_parquet(tmp_path / "conversations.parquet")
    got = catalog.QUERIES["frame_merge"](spark, str(tmp_path))
    assert rows(got, "conv_id", "s", "text") == [(1, 0, turns[0][2]), (1, 333_333, turns[1][2]), (2, 0, turns[3][2])]


def slow_alignment(sim, match, output, skip_a, skip_b, band):
    """The alignment cell by cell, as its rule says."""
    import numpy as np

    n, m = sim.shape
    best = {(0, 0): (np.float32(0), 0)}
    for i in range(1, n + 1):
        best[i, 0] = (best[i - 1, 0][0] - np.float32(skip_a), 1)
    for j in range(1, m + 1):
        best[0, j] = (best[0, j - 1][0] - np.float32(skip_b), 2)
    value = lambda i, j: best.get((i, j), (np.float32(-1e9), 0))[0]
    for i in range(1, n + 1):
        centre = int((i - 1) * (m / n))
        for j in range(max(1, centre - band), min(m, centre + band) + 1):
            now = (value(i - 1, j) - np.float32(skip_a), 1)
            for new in ((value(i, j - 1) - np.float32(skip_b), 2), (value(i - 1, j - 1) + (sim[i - 1, j - 1] - np.float32(match)), 3)):
                now = new if new[0] > now[0] else now
            best[i, j] = now
    out, i, j = [], n, m
    while i or j:
        move = best.get((i, j), (0, 0))[1]
        if move == 3 and sim[i - 1, j - 1] >= output:
            out.append((i - 1, j - 1))
        i, j = (i - 1, j - 1) if move == 3 else (i, j - 1) if move == 2 and j else (i - 1, j)
        if i < 0:
            break
    return out[::-1]


def test_alignment_equals_the_rule_cell_by_cell():
    import numpy as np

    rnd = np.random.RandomState(0)
    for n, m, band in [(12, 15, 20), (15, 12, 3), (1, 40, 4), (7, 1, 2), *[(rnd.randint(1, 14), rnd.randint(1, 14), rnd.randint(1, 8)) for _ in range(60)]]:
        sim = rnd.rand(n, m).astype(np.float32)
        got = align.monotonic_path(sim, 0.46, 0.5, 0.015, 0.01, band)
        assert [(i, j) for i, j, _ in got] == slow_alignment(sim, 0.46, np.float32(0.5), 0.015, 0.01, band)
        assert all(x >= 0.5 for *_, x in got)
    assert [x[:2] for x in align.monotonic_path(np.eye(4, dtype=np.float32), 0.5, 0.5, 0.015, 0.01, 20)] == [(i, i) for i in range(4)]


def test_group_alignment_is_the_best_of_all(spark):
    """Against all ways to cut both sides into pairs of groups and skips."""
    import functools

    import numpy as np

    rnd = np.random.RandomState(4)
    for n, m in ((4, 5), (5, 3), (1, 4)):
        scores = {(p, q): np.where(rnd.rand(n - p + 1, m - q + 1) < 0.4, np.nan, rnd.rand(n - p + 1, m - q + 1)) for p in range(1, min(3, n) + 1) for q in range(1, min(3, m) + 1)}

        @functools.cache
        def most(i, j, scores=scores):
            ways = [0.0] if not i and not j else []
            ways += [most(i - 1, j) - 0.08] if i else []
            ways += [most(i, j - 1) - 0.05] if j else []
            ways += [most(i - p, j - q) + x[i - p, j - q] - 0.6 for (p, q), x in scores.items() if i >= p and j >= q and not np.isnan(x[i - p, j - q])]
            return max(ways)

        path = align.group_path(scores, n, m, 0.6, 0.0, 0.08, 0.05)
        total = sum(x - 0.6 for *_, x in path) - 0.08 * (n - sum(p for _, _, p, _, _ in path)) - 0.05 * (m - sum(q for _, _, _, q, _ in path))
        assert total == pytest.approx(most(n, m), abs=1e-5)
        assert all(a + p <= c and b + q <= d for (a, b, p, q, _), (c, d, *_) in zip(path, path[1:], strict=False))
    rows = [("g", side, k, 2.0 * k, 2.0 * k + 1, v) for side in "ab" for k, v in enumerate([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])]
    got = align.group_align(spark.createDataFrame(rows, "g string, side string, pos long, s double, e double, vector array<double>"), ["g"]).collect()
    assert [(r["a_pos"], r["b_pos"], r["alignment"]) for r in got] == [([k], [k], "1:1") for k in range(3)]


def test_partition_covers_all_orders(spark, tmp_path):
    import itertools
    import random

    rnd = random.Random(12)
    orders = [(1 + 97 * i, rnd.choice([1, 2, 3, 4, 5, 5, 5]), rnd.randint(1, 900) / 4) for i in range(40)] + [(9000, 6, 2.0)]
    pd.DataFrame(orders, columns=["o_orderkey", "o_custkey", "o_totalprice"]).to_parquet(tmp_path / "orders.parquet")
    got = {(r["title"], r["pos"]): r["part"] for r in catalog.QUERIES["partition_dp"](spark, str(tmp_path)).collect()}
    assert len(got) == len(orders)
    for title in {c for _, c, _ in orders}:
        clips = sorted((k, d) for k, c, d in orders if c == title)
        n, parts = len(clips), min(4, len(clips))
        want = sum(d for _, d in clips) / parts
        loss = lambda cuts: sum((sum(d for _, d in clips[a:b]) / want - 1) ** 2 for a, b in zip((0, *cuts), (*cuts, n), strict=True))
        found = [got[title, k] for k, _ in clips]
        assert found == sorted(found) and set(found) == set(range(1, parts + 1))
        cuts = tuple(i for i in range(1, n) if found[i] != found[i - 1])
        assert loss(cuts) == pytest.approx(min(map(loss, itertools.combinations(range(1, n), parts - 1))))


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nOne\nline\n\nbroken\n\n2\n00:00:03,000 --> 00:00:03,400\nTwo\n", encoding="utf-8")
    cues = readers.srt(spark, str(tmp_path / "a.srt"))
    assert rows(cues, "index", "s", "e", "text") == [(1, SEC, 2_500_000, "One\nline"), (2, 3 * SEC, 3_400_000, "Two")]
    again = writers.srt(cues.withColumnRenamed("index", "seg_id"), ["file"]).first()["srt"]
    assert again.startswith("1\n00:00:01,000 --> 00:00:02,500\nOne")
    (tmp_path / "c.xml").write_text('<i><d p="1.5,1,25,255,x">hi</d><d p="2,1">no</d><d p="3,4,25,9,z"></d></i>', encoding="utf-8")
    assert rows(readers.comments(spark, str(tmp_path / "c.xml")), "at", "mode", "content") == [(1_500_000, 1, "hi"), (3 * SEC, 4, "")]
    expr = spark.createDataFrame([("select='between(t,1.5,2)+between(t, 3,4.25)'",)], "x string")
    assert rows(readers.between_ranges(expr, "x"), "s", "e") == [(1_500_000, 2 * SEC), (3 * SEC, 4_250_000)]
    log = spark.createDataFrame([("m", 0, "silence_start: 1.5"), ("m", 1, "silence_end: 3.0 | silence_duration: 1.5"), ("m", 2, "silence_end: 9 | silence_duration: 2")], "m string, n int, value string")
    assert rows(intervals.pair_start_end(readers.silence_log(log, ["m"], "n"), ["m"], "n"), "s", "e") == [(1_500_000, 3 * SEC), (7 * SEC, 9 * SEC)]
    reply = spark.createDataFrame([('so: {"decision": "keep", "confidence": 0.5}!',), ("none",)], "x string")
    assert sorted(rows(readers.responses(reply, "x"), "x", "decision", "confidence"), key=str) == [("none", None, None), ('so: {"decision": "keep", "confidence": 0.5}!', "keep", 0.5)]


def test_sampling_rounds_half_to_even(spark):
    df = spark.range(50).selectExpr("0 as g", "id")
    picked = lambda *a: [r["id"] for r in sequences.even_sample(df, ["g"], "id", *a).orderBy("id").collect()]
    assert picked(5) == [0, 12, 24, 37, 49]
    assert picked(1) == [25] and picked(1, "first") == [0] and len(picked(60)) == 50


def test_highlights_rank_by_the_mean_of_their_windows(spark):
    score = {0: 6.0, 1: 10.0, 2: 5.0, 3: 0.0, 4: 0.0, 5: 8.0}
    df = spark.createDataFrame([("m", w, x) for w, x in score.items()], "m string, w long, score double")
    assert rows(folds.highlight_top(df, ["m"], 6, 3), "rank", "first", "last", "score") == [(1, 5, 5, 8.0), (2, 0, 2, 7.0)]
    flat = spark.createDataFrame([("m", w, 5.0 - w / 10) for w in range(8)], "m string, w long, score double")
    assert rows(folds.highlight_top(flat, ["m"], 2, 3, stop_at_used=False), "first", "last") == [(0, 0), (1, 1)]


def test_midpoints_fall_into_the_last_range_at_its_end(spark):
    ranges = spark.createDataFrame([("g", "a", 0, 10), ("g", "b", 10, 20_000)], "g string, range_id string, rs long, re long")
    cues = spark.createDataFrame([("g", i, m, m) for i, m in enumerate([-5, 0, 10, 20_000, 21_000, 21_001])], "g string, k int, s long, e long")
    found = lambda **a: [r["range_id"] for r in intervals.assign_by_midpoint(cues, ranges, ["g"], **a).orderBy("k").collect()]
    assert found() == ["b", "a", "b", "b", "b", "b"]
    assert found(fallback_last=False) == [None, "a", "b", "b", "b", None]


def test_plan_and_delta_names(spark):
    cases = [("keep_current_match", "x", "", "keep-existing"), (" No_Match ", "x", "", "clear-existing"), ("no_match", "", "", "leave-unmatched"), ("reject_current_match", "", "y", "leave-unmatched"), ("suggest_new_match", "x", "y", "replace-with-suggested-text"),
             ("suggest_new_match", None, "y", "fill-with-suggested-text"), ("suggest_new_match", "x", " ", "manual-review"), ("unsure", "x", "y", "manual-review"), ("later", "x", "y", "unrecognized-decision"), (None, None, None, "unrecognized-decision")]
    df = spark.createDataFrame(cases, "d string, c string, g string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", maintain.plan_action(F.col("d"), F.col("c"), F.col("g")).alias("got")).collect())
    base = [(1, "matched", "a", "n"), (2, "unmatched", "", "n"), (3, "matched", "a", "n"), (4, "matched", "a", "n"), (5, "matched", "a", "n"), (6, "matched", "a", "n"), (7, "matched", "a", "n")]
    new = [(1, "unmatched", "", "n"), (2, "matched", "b", "n"), (3, "matched", "b", "n"), (4, "low", "a", "n"), (5, "matched", "a", "m"), (6, "matched", "a", "n"), (8, "matched", "a", "n")]
    made = [spark.createDataFrame(x, "k int, status string, text string, notes string") for x in (base, new)]
    got = {r["k"]: (r["change"], r["changed"]) for r in maintain.delta_report(*made, ["k"], ["notes"]).collect()}
    assert [got[k][0] for k in range(1, 9)] == ["cleared-to-unmatched", "filled-from-unmatched", "replaced-text", "status-only-change", "metadata-change", "unchanged", "missing-in-applied", "missing-in-base"]
    assert got[5][1] == ["notes"] and got[6][1] == []


def test_frames_keep_short_cues_and_merge_neighbours(spark):
    frames = lambda *x: spark.createDataFrame([("m", i, t, text, 0.9) for i, (t, text) in enumerate(x)], "media string, frame long, t long, text string, conf double")
    one = folds.merge_frames(frames((0, "hello there")), ["media"], 333_333, 0.86, 1, 600_000)
    assert rows(one, "s", "e", "text") == [(0, 600_000, "hello there")]
    # two cues that a longer blank run parts are joined again, as the first lasts until the second begins
    again = folds.merge_frames(frames((0, "hello there"), (100_000, ""), (200_000, ""), (300_000, "hello there")), ["media"], 333_333, 0.86, 1, 600_000)
    assert rows(again, "s", "e") == [(0, 900_000)]
    # a longer text that is similar, but not nearly the same, goes on without replacing
    kept = folds.merge_frames(frames((0, "abcdefghij"), (1, "abcdefghijkl")), ["media"], 1, 0.85, 1, 1)
    assert rows(kept, "text") == [("abcdefghij",)]


def test_lanes_by_pools(spark):
    c = [(0, 0, 1), (1, 1, 1), (2, 2, 5), (3, 5, 4), (4, 12_000_000, 1), (5, 12_000_000, 6), (6, 13_000_000, 1)]
    df = spark.createDataFrame([("m", *x) for x in c], "m string, pos long, at long, mode int")
    got = rows(folds.allocate_lanes(df, ["m"], {"scroll": 2, "top": 1, "bottom": 1}), "pos", "pool", "lane")
    assert got == [(0, "scroll", 0), (1, "scroll", 1), (2, "top", 0), (3, "bottom", 0), (4, "scroll", 0), (5, "scroll", 1), (6, "scroll", 0)]
    assert folds.lane_counts(40) == {"scroll": 21, "top": 5, "bottom": 5} and folds.lane_counts(40, upper_half=True)["scroll"] == 10


def test_streams(spark, tmp_path):
    from tidemark.streaming import stable

    pd.DataFrame({"path": ["a", "a", "b", "b"], "size": [1, 1, 1, 2], "mtime": [5, 5, 5, 6], "seen": [1, 2, 1, 2]}).to_parquet(tmp_path / "e.parquet")
    stream = spark.readStream.schema("path string, size long, mtime long, seen long").parquet(str(tmp_path))
    q = stable.stable_files(stream).writeStream.format("memory").queryName("stable_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("stable_out"), "path", "size") == [("a", 1)]


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    want = con.sql(catalog.SQL[name])
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    tidy = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    a = sorted((tidy(r[c] for c in columns) for r in got.collect()), key=repr)
    b = sorted(map(tidy, want.select(*(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert a == b


def test_empty_cues_stay_intervals_as_in_sql(spark, tmp_path):
    import duckdb

    starts = {0: 100, 60: 0, 120: 40, 130: 0, 600: 200, 900: 0}  # seconds: hundredths of the value, so seconds of length
    events = [(100 * u + i, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s), u, "purchase", v / 100, "") for u in range(3) for i, (s, v) in enumerate(starts.items()) if u or v]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(pd.DataFrame(events, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view events as select * replace (ts::timestamp as ts) from '{path}/*.parquet'")
    for name in ("interval_merge_touch", "interval_merge_gap", "interval_complement", "coverage_report", "cut_timeline", "point_to_cut", "cut_to_point", "keep_expression", "range_to_cut"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({catalog.SQL[name]})").fetchall()
        assert sorted(tuple(r) for r in got.collect()) == sorted(want), name


def test_a_point_where_an_empty_interval_begins_too(spark):
    kept = spark.createDataFrame([("g", 0, 100), ("g", 200, 200), ("g", 400, 440)], "g string, s long, e long")
    points = spark.createDataFrame([("g", 120)], "g string, t long")
    at = lambda **how: intervals.cut_to_point(points, intervals.annotate_cut(kept, ["g"]), ["g"], "t", **how).first()["original_at"]
    assert (at(), at(empty_holds=True)) == (420, 200)


def test_nearest_vectors_hold_the_scores_of_few_queries(spark):
    import numpy as np

    assert folds.QUERIES * folds.VECTORS * 8 <= 4 << 20  # a piece's scores
    n = 2 * folds.QUERIES + 7
    x = np.random.RandomState(5).randn(n, 4)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = folds.cosine_topk(df.withColumnRenamed("id", "q_id"), df.withColumnRenamed("id", "c_id"), 3)
    want = [(i, int(c), r + 1) for i, s in enumerate(np.round(x @ x.T, 6)) for r, c in enumerate(np.argsort(-s, kind="stable")[:3])]
    assert rows(got, "q_id", "c_id", "rank") == sorted(want, key=lambda t: (t[0], t[1]))


def test_many_titles_are_dealt_in_one_pass(spark):
    import itertools

    rnd = random.Random(8)
    sizes = {None: 3, **{t: rnd.choice((1, 2, 3, 4, 5, 9, 23)) for t in range(60)}}
    rows = [(t, i, float(rnd.randint(0, 6))) for t, n in sizes.items() for i in range(n)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # titles lie in several batches, batches hold several titles
    try:
        got = folds.partition_clips(spark.createDataFrame(rows, "title long, pos long, dur double"), 3)
        assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()  # no task's call for each title
        found = {(r["title"], r["pos"]): r["part"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(found) == len(rows)
    for t, n in sizes.items():
        dur = [d for x, _, d in rows if x == t]
        k = min(3, n)
        want = sum(dur) / k
        cost = lambda ends: sum(((sum(dur[a:b]) - want) / max(want, 1.0)) ** 2 for a, b in itertools.pairwise((0, *ends, n)))  # noqa: E731, B023
        parts = [found[t, i] for i in range(n)]
        assert sorted(set(parts)) == list(range(1, k + 1)) and parts == sorted(parts)
        least = min(map(cost, itertools.combinations(range(1, n), k - 1)))
        assert abs(cost([i for i in range(1, n) if parts[i] != parts[i - 1]]) - least) < 1e-9


def test_work_in_python_is_dealt_over_all_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        for name in ("file_names", "frame_merge", "clean_cues", "partition_dp"):
            plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "REPARTITION_BY_NUM" in plan, name  # not joined again by bytes
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_both_ways_to_part_names_agree(spark):
    from tidemark.functions import names as N

    paths = ["[SubsPlease] Sousou no Frieren - 03 (1080p) [A1B2C3D4].mkv", "葬送的芙莉莲 第2季 第05话.mkv", "[G][H] Some.Show S02E07.mkv", "Show 2nd Season - 11v2 [x265].mkv", "Ｓｈｏｗ　Ａ [04].mkv", "nothing here.mkv", "", None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    columns = ["raw_title", "search_keyword", "season", "episode"]
    one = {r["i"]: r["x"] and [r["x"][c] for c in columns] for r in rows.select("i", N.file_name_parts(F.col("p")).alias("x")).collect()}
    two = {r["i"]: r["x"] and [r["x"][c] for c in columns] for r in rows.select("i", N.named_parts(F.col("p")).alias("x")).collect()}
    assert one == two and one[3][1] == "Show 2nd Season Season 2"
