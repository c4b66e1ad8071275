"""Rules of tracks, titles, replies, cuts and medians, with values worked out by hand or by the plain rule."""

import json
import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import names as N
from tidemark.operators import folds, records, sequences
from tidemark.sources import logs, writers


def test_track_points(spark):
    schema = "i int, language string, title string, codec string, sample string, is_default boolean, is_text boolean"
    tracks = [
        (0, "chi", "简体中文", "ass", "你好", True, True),  # 40 + 30 + 35 + 20, and 60 for chs, 50 for default
        (1, "CHI", "Traditional (CHT)", "hdmv_pgs", None, False, False),  # 15 + 35, and 60 for cht
        (2, "eng", "Signs & Songs", "subrip", " ", None, True),  # 30 - 30
        (3, None, "English SCreen", None, "text", False, True),  # 30 + 20, and 60 for chs by its 'sc'
        (4, "jpn", "zho karaoke", "ass", "", True, None),  # 40 + 15 + 35 - 30, and 50 for default
    ]
    df = spark.createDataFrame(tracks, schema).select("i", F.struct("language", "title", "codec", "sample", "is_default", "is_text").alias("t"))
    points = lambda preference: [r[0] for r in df.orderBy("i").select(N.track_points(F.col("t"), preference)).collect()]
    assert points("") == [125, 50, 0, 50, 60]
    assert points("chs") == [185, 50, 0, 110, 60] and points("cht") == [125, 110, 0, 50, 60] and points("default") == [175, 50, 0, 50, 110]


def test_local_mapping_equals_the_plain_rule(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 5)))
    entries = [(f"e{i}", i, [rnd.choice(["", " ", word(), word() + " " + word()]) for _ in range(rnd.randint(0, 3))], rnd.choice(["", word(), word() + " " + word()])) for i in range(25)]
    queries = [(i, rnd.choice([word(), word() + " " + word(), "", None])) for i in range(120)]

    def points(title, titles, keyword):
        best = 0
        for t in titles:
            if t.strip():
                best = max(best, 300 if t == title else 180 if t in title or title in t else 0)
        return max(best, 220 if keyword.strip() and keyword == title else 0)

    def want(title):
        if title is None:
            return None
        scored = [(points(title, t, k), -pos, e) for e, pos, t, k in entries]
        best = max(scored)
        return best[2] if best[0] else None

    df = N.local_mapping(spark.createDataFrame(queries, "k int, title_form string"), spark.createDataFrame(entries, "entry string, pos int, titles array<string>, keyword string"), "k")
    assert {r.k: r.entry for r in df.collect()} == {k: want(t) for k, t in queries}


def test_plain_reply_to_several_rows(spark):
    requests = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "c")], "custom_id string, row_id string")
    lines = [{"custom_id": c, "content": '{"decision": "unsure"}'} for c in ("r1", "r2")]
    got = records.ingest(requests, logs.replies(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string"))).collect()
    assert sorted((r.custom_id, r.row_id, r.state) for r in got) == [("r1", "", "request-meta-not-found"), ("r1", "a", "missing-response"), ("r1", "b", "missing-response"), ("r2", "c", "ok")]


def test_keep_expression_in_seconds(spark):
    rows = spark.createDataFrame([("g", 1_250_000, 2_750_400), ("g", 10_000_000, 12_500_600), ("g", 0, 400)], "grp string, s long, e long")
    assert writers.keep_expression(rows, ["grp"]).first().expression == "between(t,0,0)+between(t,1.25,2.75)+between(t,10,12.501)"


def test_weights_are_floored(spark):
    rows = [("a", x, 0) for x in (1, 2, 3, 4)] + [("b", x, w) for x, w in ((1, 0), (2, 5), (3, 0))] + [("c", 7, -3)]
    for kind in ("int", "double"):
        got = sequences.weighted_median(spark.createDataFrame([(k, x, float(w) if kind == "double" else w) for k, x, w in rows], f"k string, x int, w {kind}"), ["k"], "x", "w")
        assert {r.k: r.weighted_median for r in got.collect()} == {"a": 2, "b": 2, "c": 7}


def by_table(durations, parts, targets=None, fits=None, semantic=0.0):
    """Every cut of every layer."""
    n = len(durations)
    d = np.concatenate(([0.0], np.cumsum(durations)))
    k = min(parts, n)
    want = targets[:k] if targets else [d[-1] / k] * k
    s = np.vstack((np.zeros(k), np.cumsum([f[:k] for f in fits], axis=0))) if fits else None
    cost = {(0, 0): (0.0, ())}
    for p in range(1, k + 1):
        for j in range(p, n + 1):
            tried = []
            for i in range(p - 1, j):
                if (p - 1, i) in cost:
                    c, cuts = cost[p - 1, i]
                    mean = (s[j][p - 1] - s[i][p - 1]) / (j - i) if fits else 0.0
                    tried.append((c + ((d[j] - d[i] - want[p - 1]) / max(want[p - 1], 1.0)) ** 2 - semantic * mean, i, cuts))
            best = min(tried, key=lambda x: x[:2])
            cost[p, j] = (best[0], (*best[2], best[1]))
    cuts = [*cost[k, n][1], n]
    return [p + 1 for p in range(k) for _ in range(cuts[p + 1] - cuts[p])]


def test_cuts_equal_the_whole_table(spark):
    rnd = random.Random(8)
    titles = {i: [rnd.choice([0.0, 1.0, 2.0, 5.0, 8.0]) for _ in range(n)] for i, n in enumerate([1, 2, 3, 4, 7, 12, 20, 33])}
    titles[100] = [0.0] * 6
    rows = [(i, k, d) for i, ds in titles.items() for k, d in enumerate(ds)]
    got = {}
    for r in folds.partition_clips(spark.createDataFrame(rows, "title int, pos int, dur double"), 4).orderBy("title", "pos").collect():
        got.setdefault(r.title, []).append(r.part)
    assert got == {i: by_table(ds, 4) for i, ds in titles.items()}
    strict = folds.partition_clips(spark.createDataFrame(rows, "title int, pos int, dur double"), 4, strict=True).collect()
    assert {r.part for r in strict if r.title in (0, 1, 2)} == {None} and all(r.part for r in strict if r.title > 2)
    targets, fits = [9.0, 0.5, 20.0], {(i, k): [rnd.random() for _ in range(3)] for i, k, _ in rows}
    full = spark.createDataFrame([(i, k, d, targets, fits[i, k]) for i, k, d in rows], "title int, pos int, dur double, targets array<double>, fits array<double>")
    for semantic in (0.0, 0.7):
        got = {}
        for r in folds.partition_clips(full, 3, semantic=semantic).orderBy("title", "pos").collect():
            got.setdefault(r.title, []).append(r.part)
        assert got == {i: by_table(ds, 3, targets, [fits[i, k] for k in range(len(ds))], semantic) for i, ds in titles.items()}


def test_a_long_title_is_cut_in_time():
    n = 100_000
    ends = np.concatenate(([0.0], np.cumsum(np.random.default_rng(1).uniform(0.1, 9.0, n))))
    before, began = np.concatenate(([0.0], np.full(n, np.inf))), time.perf_counter()
    for _ in range(12):
        before, cut = folds.cheapest_cuts(before, ends, ends[-1] / 12, ends[-1] / 12, 1.0)
    assert time.perf_counter() - began < 30 and before[-1] < 1e-6 and 0 < cut[-1] < n


def test_cuts_of_a_pandas_frame_keep_other_columns(spark):
    rows = spark.createDataFrame(pd.DataFrame({"title": [1, 1], "pos": [2, 1], "dur": [3.0, 4.0], "name": ["x", "y"]}))
    assert sorted((r.pos, r.name, r.part) for r in folds.partition_clips(rows, 2).collect()) == [(1, "y", 1), (2, "x", 2)]


def test_filters_snapshots_and_seasons(spark):
    from tidemark.operators import maintain
    from tidemark.sources import readers

    both = "[0:a:0]aselect='between(t,9,10)';[0:v:0]select='between(t,1.5,2)+between(t, 3 , 4)',setpts=N"
    texts = spark.createDataFrame([(1, both), (2, "aselect='between(t,9,10)'")], "k int, f string")
    assert [(r.k, r.s, r.e) for r in readers.between_ranges(texts, "f").orderBy("k", "pos").collect()] == [(1, 1_500_000, 2_000_000), (1, 3_000_000, 4_000_000), (2, 9_000_000, 10_000_000)]
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", "z", 3), ("d", "w", 4)], "k string, h string, n int")
    new = spark.createDataFrame([("a", "x", 1), ("b", "y", 9), ("c", "q", 3), ("e", "w", 4)], "k string, h string, n int")
    assert {r.k: r.state for r in maintain.verify_snapshot(old, new, "k", "h", "n").collect()} == {"a": "ok", "b": "mismatch", "c": "mismatch", "d": "missing", "e": "unexpected"}
    assert {r.k: r.state for r in maintain.verify_snapshot(old, new, "k", "h").collect()}["b"] == "ok"
    season = {"code": 0, "result": {"season_id": 5, "title": "T", "episodes": [{"id": 7, "cid": 1, "title": "12 "}, {"ep_id": 8, "title": "SP"}], "section": [{}, {"episodes": [{"id": 9, "cid": 2, "title": None}]}]}}
    docs = spark.createDataFrame([(1, json.dumps(season)), (2, '{"code": -1, "result": {"episodes": [{"id": 1}]}}'), (3, "broken"), (4, '{"code": 0}')], "k int, value string")
    got = [(r.k, r.season_id, r.season_title, r.section, r.episode_id, r.number, r.cid) for r in logs.season_episodes(docs, ["k"]).orderBy("pos").collect()]
    assert got == [(1, 5, "T", 0, 7, 12, 1), (1, 5, "T", 0, 8, None, None), (1, 5, "T", 2, 9, None, 2)]
