"""Trial windows, their alignments and the choice among overlapping results, against plain Python."""

import itertools
import random

import numpy as np

from tidemark.operators import trials


def test_windows_end_to_end(spark):
    rows = [("p", "x", 2, 0, 1.0, 4.0), ("p", "x", 2, 1, 6.0, 9.5), ("p", "y", 1, 0, 2.0, 3.0), ("q", "z", 5, 3, 0.0, 1.0), ("q", "z", 5, 9, 0.5, 0.75)]
    got = trials.end_to_end(spark.createDataFrame(rows, "part string, clip string, ord int, pos int, s double, e double"), ["part"]).collect()
    assert sorted(map(tuple, got)) == [("p", "x", 1.0, 9.5), ("p", "y", 0.0, 1.0), ("q", "z", 0.0, 0.75)]


def test_stretches_are_carried_over(spark):
    cuts = spark.createDataFrame([("p", 10.0, 20.0, 0.0), ("p", 30.0, 50.0, 10.0)], "part string, s double, e double, cut_start double")
    best = spark.createDataFrame([("p", "x", 0.9, 0, 15.0, 35.0), ("p", "x", 0.9, 1, 0.0, 99.0), ("p", "x", 0.2, 2, 0.0, 99.0), ("p", "y", 0.5, 0, 21.0, 29.0)], "part string, clip string, score double, pos int, qs double, qe double")
    assert sorted(map(tuple, trials.carried(best, cuts, ["part"], 7.0).collect())) == [("p", "x", 5.0, 10.0), ("p", "x", 10.0, 15.0)]


def test_windows_around_anchors_and_their_cues(spark):
    pairs = spark.createDataFrame([("p", "x", 5.0, 6.0), ("p", "x", 5.5, 9.0), ("p", "x", 11.0, 12.0), ("p", "x", 20.0, 21.0), ("p", "y", 0.0, 1.0)], "part string, clip string, s double, e double")
    windows = trials.around_anchors(pairs, ["part"], 2.0)
    assert sorted(map(tuple, windows.collect())) == [("p", "x", 5.0, 12.0), ("p", "x", 20.0, 21.0), ("p", "y", 0.0, 1.0)]
    a = spark.createDataFrame([("p", i, float(i), i + 1.0) for i in range(40)] + [("q", 0, 5.0, 6.0)], "part string, pos int, s double, e double")
    got = {}
    for r in trials.in_windows(a, windows, ["part"], 1.0, 4.0).collect():
        got.setdefault(r.clip, []).append(r.pos)
    assert {k: sorted(v) for k, v in got.items()} == {"x": [*range(4, 14), *range(19, 23)], "y": [0, 1, 2]}  # once each, though windows are close


def test_the_heaviest_choice(spark):
    rnd = random.Random(6)
    rows, want = [], {}
    for part in range(12):
        mine = []
        for i in range(rnd.randint(1, 9)):
            s = rnd.randint(0, 14)
            mine.append((part, f"c{i}", float(s), float(s + rnd.randint(1, 6)), round(rnd.random() + 0.01, 3)))
        rows += mine
        apart = lambda xs: all(x[3] <= y[2] or y[3] <= x[2] for x, y in itertools.combinations(xs, 2))
        want[part] = max(sum(x[4] for x in xs) for k in range(len(mine) + 1) for xs in itertools.combinations(mine, k) if apart(xs))
    rows += [(0, "none", 3.0, 3.0, 5.0), (1, "none", 0.0, 99.0, -1.0)]
    got = {}
    for r in trials.reconciled(spark.createDataFrame(rows, "part int, clip string, s double, e double, score double"), ["part"]).collect():
        got.setdefault(r.part, []).append(r)
    assert {k: round(sum(r.score for r in v), 3) for k, v in got.items()} == {k: round(x, 3) for k, x in want.items()}
    assert all(x.e <= y.s or y.e <= x.s for v in got.values() for x, y in itertools.combinations(v, 2))


def test_trial_alignment_of_each_clip(spark):
    gen = np.random.default_rng(2)
    v = [x / np.linalg.norm(x) for x in gen.normal(size=(12, 5))]
    a = spark.createDataFrame([("p", i, 2.0 * i, 2.0 * i + 1, v[i].tolist()) for i in range(12)], "part string, pos int, s double, e double, vector array<double>")
    b = spark.createDataFrame([("p", c, o, 10 * o + k, 2.0 * k, 2.0 * k + 1, v[i].tolist(), 0.9 if i != 7 else 0.1) for o, (c, xs) in enumerate({"x": range(0, 6), "y": range(5, 12)}.items()) for k, i in enumerate(xs)], "part string, clip string, ord int, pos int, s double, e double, vector array<double>, confidence double")
    windows = trials.end_to_end(b, ["part"])
    found = trials.trial_align(a, b, windows, ["part"], flank=3.0, least=0.5).cache()
    got = {(r.clip, tuple(r.a_pos)): [x % 10 for x in r.b_pos] for r in found.collect()}
    assert got[("x", (2,))] == [2] and got[("y", (8,))] == [3] and all(7 not in k[1] for k in got)
    assert {k for k in got if k[1] == (5,)} == {("x", (5,)), ("y", (5,))}  # both windows hold it
    chosen = trials.reconciled(trials.deduped(found, ["part"]), ["part"]).collect()
    assert len([r for r in chosen if r.a_pos == [5]]) == 1
    rows = {r.clip: r for r in trials.summary(windows, trials.in_windows(a, windows, ["part"], 3.0), found, ["part"]).collect()}
    assert rows["x"].cues == 8 and rows["x"].results == sum(k[0] == "x" for k in got) and rows["y"].windows == 1
    assert trials.trial_align(a.limit(0), b, windows, ["part"]).count() == 0


def test_choices_are_dealt_over_all_tasks(spark):
    """Pieces are small in bytes and slow in Python: a task each, not one for all."""
    found = spark.createDataFrame([("p", 10.0 * i + k, 10.0 * i + k + 2, 1.0 + k) for i in range(30) for k in range(2)], "part string, s double, e double, score double")
    got = trials.reconciled(found, ["part"])
    assert sorted(r.s for r in got.collect()) == [10.0 * i + 1 for i in range(30)]
    assert got.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
