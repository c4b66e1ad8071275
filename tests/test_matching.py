"""Stages and forced passes against the same rules written one after the other in plain Python."""

import random

import numpy as np
import pandas as pd
from test_tiles import dense, in_plain_python

from tidemark.operators import align, forced, matching, tiles

A = "part string, pos long, s double, e double, text string, vector array<double>"
B = A + ", clip string, confidence double"
CLIPS = "part string, clip string, ord int, start double, end double"
REVIEWED = "part string, ord int, `group` array<bigint>, b_pos array<bigint>, status string, score double, clip string"


def unit(v):
    return v / np.linalg.norm(v)


def part(name, seed, sizes, noise=0.7):
    """A part of clips: b's cues are a's with noise, some left out, some of their own."""
    rnd, gen = random.Random(seed), np.random.default_rng(seed)
    a, b, clips, t = [], [], [], 0.0
    for c, n in enumerate(sizes):
        start, inner = t, 0.0
        for _ in range(n):
            v = unit(gen.normal(size=6))
            text = rnd.choice(["Ann: we should go now", "they went over the hill", "Bo: wait", "a much longer line about the river"])
            a.append((name, len(a), t, t + 1.5, text, v.tolist()))
            t += 2.0
            for _ in range(rnd.choice([0, 1, 1, 1, 2])):
                w = unit(v + noise * gen.normal(size=6) * rnd.choice([0.2, 1.0]))
                b.append((name, len(b), inner, inner + 1.4, rnd.choice(["安：我们现在该走了", "他们翻过了那座山", "等", "关于那条河的一句很长的话"]), w.tolist(), f"c{c}", rnd.choice([0.6, 0.95])))
                inner += 1.7
        clips.append((name, f"c{c}", c, start, t))
    return a, b, clips


def context(rows, r):
    return [unit(np.sum([x[5] for x in rows[max(0, i - r) : i + r + 1]], axis=0)).tolist() for i in range(len(rows))]


def scope(a, b, blend, path, around, span=None):
    """(a cue, b cue, score) of one scope, by the dense table."""
    if not a or not b:
        return []
    lo, hi = span or (min(x[2] for x in a), max(x[3] for x in a))
    clamp = lambda x: max(0.0, min(1.0, x))
    end = max(max(x[3] for x in b), 1.0)
    han = lambda t: sum("一" <= c <= "鿿" for c in t)
    rows = [("a", 0, x[5], c, clamp(((x[2] + x[3]) / 2 - lo) / max(hi - lo, 1.0)), [], None, ":" in x[4], sum(k.isascii() and k.isalnum() for k in x[4])) for x, c in zip(a, context(a, around[0]), strict=True)]
    rows += [("b", 0, y[5], c, clamp((y[2] + y[3]) / 2 / end), None, None, "：" in y[4], han(y[4])) for y, c in zip(b, context(b, around[1]), strict=True)]
    return [(a[(i - 3) // 10], b[(j - 3) // 10], round(s, 4)) for i, j, s in in_plain_python(dense(rows, blend), path)]


def grouped(a, b, how):
    if not a or not b:
        return []
    frame = lambda rows: pd.DataFrame({"vector": [np.array(x[5]) for x in rows], "s": [x[2] for x in rows], "e": [x[3] for x in rows]})
    x, y = frame(a), frame(b)
    scores = {(p, q): align.group_scores(x, y, p, q, 0.5) for p in range(1, min(how.largest, len(a)) + 1) for q in range(1, min(how.largest, len(b)) + 1)}
    return [(a[i : i + p], b[j : j + q], round(s, 4)) for i, j, p, q, s in align.group_path(scores, len(a), len(b), how.match, how.output, how.skip_a, how.skip_b)]


class Book:
    """The matches so far."""

    def __init__(self, rows=()):
        self.of = {r[0]: r[1:] for r in rows}  # a's position -> (origin, score, positions of b)
        self.used = {j for r in rows for j in r[3]}

    def take(self, xs, ys, score, origin):
        for x in xs:
            self.of[x[1]] = (origin, score, [y[1] for y in ys])
        self.used |= {y[1] for y in ys}

    def open(self, a):
        return [x for x in a if x[1] not in self.of]

    def free(self, b):
        return [y for y in b if y[1] not in self.used]


def estimated(score):
    return "matched-high" if score >= 0.7 else "matched-medium" if score >= 0.42 else "matched-low"


def force_part(a, b, clips, book, P):
    def chunks(own, others, size):
        n, m = len(own), len(others)
        if n <= size or m <= 1:
            return [(own, others)]
        out = []
        for i in range(0, n, size):
            j = min(n, i + size)
            out.append((own[i:j], others[max(0, round(i / n * m) - forced.MARGIN) : min(m, round(j / n * m) + forced.MARGIN)]))
        return [x for x in out if x[1]]

    def run(own, others, how, size):
        gained = 0
        for xs, ys in chunks(own, others, size):
            xs, ys = book.open(xs), book.free(ys)
            if xs and ys:
                for x, y, s in scope(xs, ys, how.blend, how.path, how.around):
                    book.take([x], [y], s, how.origin)
                    gained += 1
        return gained

    for _, clip, _, start, end in clips:
        own = [x for x in a if start <= (x[2] + x[3]) / 2 < end]
        others = [y for y in b if y[6] == clip]
        place = {y[1]: k for k, y in enumerate(others)}
        if not own:
            continue

        def windows(own=own, others=others, place=place):
            out, i0, j0 = [], 0, 0
            for i, x in enumerate(own):
                hits = [place[j] for j in book.of.get(x[1], ("", 0, []))[2] if j in place]
                if hits:
                    if i0 < i and j0 < min(hits):
                        out.append((own[i0:i], others[j0 : min(hits)]))
                    i0, j0 = max(i0, i + 1), max(j0, max(hits) + 1)
            return out + ([(own[i0:], others[j0:])] if i0 < len(own) and j0 < len(others) else [])

        for k in range(P.reruns + 1):
            how, size = (P.rerun, max(24, P.chunk // 2)) if k else (P.window, P.chunk)
            if not sum(run(book.open(xs), book.free(ys), how, size) for xs, ys in windows()) and k:
                break

        def runs(own=own):
            i = 0
            while i < len(own):
                j = i
                while j < len(own) and own[j][1] not in book.of:
                    j += 1
                if j > i:
                    yield i, j - 1
                i = j + 1

        def stretch(i, j, pad, own=own, others=others, place=place):
            n, m = len(own), len(others)
            before = [book.of[x[1]][2] for x in own[:i] if book.of.get(x[1], ("", 0, []))[2]]
            after = [book.of[x[1]][2] for x in own[j + 1 :] if book.of.get(x[1], ("", 0, []))[2]]
            low = [place[k] for k in before[-1] if k in place] if before else []
            high = [place[k] for k in after[0] if k in place] if after else []
            lo = max(low) + 1 if low else max(0, round(i / n * m) - pad)
            hi = min(high) - 1 if high else min(m - 1, round((j + 1) / n * m) + pad)
            return lo, hi, bool(low) and bool(high)

        if others:
            for i, j in runs():
                if j - i + 1 >= P.gap_least:
                    lo, hi, _ = stretch(i, j, P.gap_pad)
                    if lo > hi:
                        lo = max(0, min(lo, len(others) - 1))
                        hi = min(len(others) - 1, max(lo, hi))
                    run(own[i : j + 1], book.free(others[lo : hi + 1]), P.gap, max(12, P.chunk // 2))
            for i, j in runs():
                if j - i + 1 >= P.group_least:
                    lo, hi, _ = stretch(i, j, P.group_pad)
                    for xs, ys, s in grouped(own[i : j + 1], book.free(others[lo : hi + 1]) if lo <= hi else [], P.group):
                        book.take(xs, ys, s, P.group.origin)
            for i, j in runs():
                lo, hi, bounded = stretch(i, j, 0)
                if j - i < P.micro_most[0] and bounded and 1 <= hi - lo + 1 <= P.micro_most[1]:
                    for x, y in zip(own[i : j + 1], book.free(others[lo : hi + 1]), strict=False):
                        book.take([x], [y], P.micro_score, "forced-micro-gap-v1")
        tail(book, own, others, P.tail, "forced-tail-fill-v1")
    tail(book, a, b, P.part_tail, "forced-part-tail-fill-v1")


def tail(book, a, b, limits, origin):
    xs, ys = book.open(a), book.free(b)
    if len(xs) >= limits[0] and ys and len(ys) / len(xs) >= limits[1]:
        k = min(len(xs), len(ys))
        spaced = lambda rows: rows if len(rows) == k else [rows[0 if k == 1 else round(i * (len(rows) - 1) / (k - 1))] for i in range(k)]
        for x, y in zip(spaced(xs), spaced(ys), strict=True):
            book.take([x], [y], limits[2], origin)


def frames(spark, parts):
    flat = lambda k: [r for p in parts for r in p[k]]
    return spark.createDataFrame(flat(0), A).repartition(3), spark.createDataFrame(flat(1), B).repartition(3), spark.createDataFrame(flat(2), CLIPS)


def test_forced_passes_equal_one_run_after_the_other(spark):
    parts = [part("p1", 1, [16, 9]), part("p2", 2, [7, 14, 3]), part("p3", 3, [5])]
    P = forced.Passes(
        window=forced._scope("w", 0.28, 0.30, 1.05, 0.004, 0.002, (2, 1)), rerun=forced._scope("r", 0.32, 0.28, 1.0, 0.003, 0.0015, (1, 1)), gap=forced._scope("g", 0.36, 0.25, 0.7, 0.002, 0.001, (1, 1)), group=matching.Groups("gg", "gg-", 2, 0.40, 0.5, 0.015, 0.01, True),
        chunk=6, gap_least=2, tail=(3, 0.5, 0.18), part_tail=(1, 0.1, 0.14),
    )
    a, b, clips = frames(spark, parts)
    seeds = {"p1": [(3, "auto", 0.9, [4]), (4, "auto", 0.9, []), (12, "auto", 0.9, [9, 10]), (20, "auto", 0.9, [0])], "p2": [(10, "auto", 0.8, [8])], "p3": []}
    clip_of = {(r[0], r[1]): r[6] for p in parts for r in p[1]}
    rows = [(p, i, "matched-high", o, s, 1.0, clip_of[p, j[0]] if j else None, j, [i], "") for p, xs in seeds.items() for i, o, s, j in xs]
    found = spark.createDataFrame(rows, "part string, " + matching.MATCH)
    got = forced.forced(a, b, clips, found, ["part"], P).collect()
    want, origins = [], set()
    for p in parts:
        book = Book(seeds[p[0][0][0]])
        force_part(*p, book, P)
        want += [(p[0][0][0], i, *x) for i, x in book.of.items()]
        origins |= {x[0] for x in book.of.values()}
    key = lambda r: (r[0], r[1])
    assert sorted(((r.part, r.a_pos, r.origin, r.score, r.b_pos) for r in got), key=key) == sorted(want, key=key)
    assert {"auto", "w", "g", "gg", "forced-tail-fill-v1"} <= origins, origins
    single = [r for r in got if r.origin in ("w", "r", "g")]
    assert all(r.status == estimated(r.score) and r.group == [r.a_pos] and r.clip == clip_of[r.part, r.b_pos[0]] for r in single)
    taken = [(r.part, j) for r in got for j in set(r.b_pos) if len(r.group) == 1]
    assert len(taken) == len(set(taken))


def rebuild_part(a, b, clips, reviewed, stages):
    book = Book()
    for r in sorted(reviewed, key=lambda r: r[1]):
        for i in r[2]:
            if i < len(a):
                book.of[i] = ("reviewed-master", r[5], r[3])
    locked = {j for r in reviewed if r[6] for j in r[3]}
    b = [y for y in b if y[1] not in locked]

    def stage(xs, ys, how, groups):
        for x, y, s in scope(book.open(xs), book.free(ys), how.blend, how.path, how.around):
            if s * (0.8 + 0.2 * y[7]) >= 0.58:
                book.take([x], [y], s, how.origin)
        for gx, gy, s in grouped(book.open(xs), book.free(ys), groups):
            book.take(gx, gy, s, groups.origin)

    for _, clip, _, start, end in clips:
        stage([x for x in a if start <= (x[2] + x[3]) / 2 < end], [y for y in b if y[6] == clip], *stages.clip)
    stage(a, b, *stages.window)
    how = stages.fallback
    for x, y, s in scope(book.open(a), book.free(b), how.blend, how.path, how.around, (0.0, max(x[3] for x in a))):
        book.take([x], [y], s, how.origin)
    return book


def test_stages_equal_one_after_the_other(spark):
    parts = [part("p1", 11, [12, 10], 0.4), part("p2", 12, [6, 9], 0.9)]
    reviewed = [("p1", 0, [2, 3], [2], "merged-n1", 0.9, "c0"), ("p1", 1, [3], [5], "matched-high", 0.8, "c0"), ("p1", 2, [99], [7], "matched-high", 0.8, "c0"), ("p2", 0, [4], [3], "matched-high", None, "")]
    stages = matching.Stages(
        clip=(matching.Scope("auto-clip-local-v1", matching.LOCAL, tiles.Path(0.42, 0.50, 0.025, 0.018, 0.28, 120)), matching.Groups("group-clip-local-v1", "g-")), gate=False,
    )
    a, b, clips = frames(spark, parts)
    got = matching.rebuilt(a, b, clips, spark.createDataFrame(reviewed, REVIEWED), ["part"], stages).collect()
    want = []
    for p in parts:
        book = rebuild_part(*p, [r for r in reviewed if r[0] == p[0][0][0]], stages)
        want += [(x[0], x[1], *book.of.get(x[1], ("none", None, []))) for x in p[0]]
    have = sorted((r.part, r.pos, r.match_origin, r.match_score, [int(x) for x in r.chinese_cue_ids]) for r in got)
    assert have == sorted(want)
    assert {x[2] for x in want} >= {"reviewed-master", "auto-clip-local-v1", "progress-fallback-v1"}
    statuses = {r.match_origin: set() for r in got}
    for r in got:
        statuses[r.match_origin].add(r.status)
    assert statuses.get("none", {"unmatched"}) == {"unmatched"} and statuses["progress-fallback-v1"] == {"matched-low"}
    # the gate takes back short readings and says why
    gated = matching.rebuilt(a, b, clips, spark.createDataFrame(reviewed, REVIEWED), ["part"]).where("match_origin = 'quality-gated-qc1-inline'").collect()
    assert gated and all(r.status == "unmatched" and r.chinese_text == "" and r.notes.startswith("qc1-inline-rejected: ") for r in gated)


def test_windows_between_anchors(spark):
    rows = spark.createDataFrame([(k, s, i) for k in "xyz" for s, n in (("a", 10), ("b", 8)) for i in range(n)], "k string, side string, pos long")
    anchors = spark.createDataFrame([("x", 2, 3, 1, 2), ("x", 5, 5, 2, 6), ("x", 7, 7, 4, 4), ("y", 0, 9, 3, 3)], "k string, a_first long, a_last long, b_first long, b_last long")
    got = {}
    for r in matching.between(anchors, rows, ["k"]).collect():
        got.setdefault((r.k, r.window), {"a": [], "b": []})[r.side].append(r.pos)
    # the room of b between the first two anchors is none, the third one starts before the second one's end
    want = [("x", [0, 1], [0]), ("x", [8, 9], [7]), ("z", list(range(10)), list(range(8)))]
    assert sorted((k, sorted(v["a"]), sorted(v["b"])) for (k, _), v in got.items()) == want


def test_nothing_to_match(spark):
    a, b, clips = (spark.createDataFrame([], x) for x in (A, B, CLIPS))
    none = spark.createDataFrame([], REVIEWED)
    assert matching.rebuilt(a, b, clips, none, ["part"]).count() == 0
    one = spark.createDataFrame([("p", 0, 0.0, 1.0, None, [1.0])], A)
    assert [r.status for r in matching.rebuilt(one, b, clips, none, ["part"]).collect()] == ["unmatched"]
    found = spark.createDataFrame([], "part string, " + matching.MATCH)
    assert forced.forced(one, b, clips, found, ["part"]).count() == 0




def test_exclusive_pairs_equal_one_after_the_other(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.randrange(12), rnd.randrange(12), rnd.choice([0.1, 0.2, 0.2, 0.7, rnd.random()])) for k in ("x", "y", None) for _ in range(60)]
    rows += [("chain", i, j, 1.0 - (2 * i + j - i) / 100) for i in range(8) for j in (i, i + 1)] + rows[:3]
    got = align.exclusive(spark.createDataFrame(rows, "k string, a_pos long, b_pos long, score double").where("k is not null"), ["k"]).collect()
    want, used = [], set()
    for k, i, j, s in sorted({r for r in rows if r[0]}, key=lambda r: (-r[3], r[1], r[2])):
        if (k, "a", i) not in used and (k, "b", j) not in used:
            used |= {(k, "a", i), (k, "b", j)}
            want.append((k, i, j, s))
    assert sorted((r.k, r.a_pos, r.b_pos, r.score) for r in got) == sorted(want)
    assert align.exclusive(spark.createDataFrame([], "k string, a_pos long, b_pos long, score double"), ["k"]).count() == 0


def test_tables_that_grow_are_never_broadcast(spark):
    a, b = (spark.createDataFrame([("p", 0, "x", [0])], "part string, pos long, clip string, b_pos array<long>") for _ in range(2))
    found = spark.createDataFrame([("p", 0, "x", [0])], "part string, a_pos long, clip string, b_pos array<long>")
    blocks = spark.createDataFrame([("{}", "a", 0, [1]), ("{}", "b", 0, [2])], "scope string, side string, block int, rows array<int>")
    made = [matching.free_a(a, found, ["part"]), matching.free_b(b, found, ["part"]), tiles._sides(blocks.selectExpr("scope", "block as ti", "block as tj"), blocks)]
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
