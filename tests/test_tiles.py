"""Alignment in tiles and the blended similarity, against plain Python."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import tiles

NAMES = ["Ann", "Anna", "Bo", "Cy"]


def cues(seed, n, m, size=4):
    rnd = random.Random(seed)

    def side(which, k):
        rows = []
        for i in range(k):
            v = np.array([rnd.gauss(0, 1) for _ in range(size)])
            v, c = (x / np.linalg.norm(x) for x in (v, v + 0.1))
            names = rnd.sample(NAMES, rnd.randint(0, 2)) if which == "a" else None
            name = rnd.choice([None, *NAMES]) if which == "b" else None
            rows.append((which, 10 * i + 3, v.tolist(), c.tolist(), i / max(k, 1), names, name, bool(rnd.randint(0, 1)), rnd.randint(0, 12)))
        return rows

    return side("a", n) + side("b", m)


SCHEMA = "side string, pos long, vector array<double>, context array<double>, progress double, names array<string>, name string, named boolean, chars int"
BLEND = tiles.Blend(0.76, 0.24, 0.28, 0.16, 0.06, 0.04, ((1, 6, 0.08), (2, 10, 0.05)))


def dense(rows, blend):
    a, b = ([r for r in rows if r[0] == x] for x in "ab")
    out = np.zeros((len(a), len(b)))
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            s = blend.base * np.dot(x[2], y[2]) + blend.context * np.dot(x[3], y[3]) + blend.progress * max(0, 1 - abs(x[4] - y[4]) / blend.width)
            if x[5] and y[6] and not any(k.startswith(y[6]) or y[6].startswith(k) for k in x[5]):
                s -= blend.incompatible
            if x[7] and not y[7]:
                s -= blend.unnamed
            for most, least, penalty in blend.short:
                if y[8] <= most and x[8] >= least:
                    s -= penalty
                    break
            out[i, j] = round(s, 9)
    return out


def in_plain_python(sim, path):
    """The table cell by cell, as the rule says it."""
    n, m = sim.shape
    band = int(max(min(path.least, m), path.ratio * m))
    f = np.float32
    best = np.full((n + 1, m + 1), f(-1e9), f)
    move = np.zeros((n + 1, m + 1), int)
    best[0, 0] = 0
    for j in range(1, m + 1):
        best[0, j], move[0, j] = best[0, j - 1] - f(path.skip_b), 2
    for i in range(1, n + 1):
        best[i, 0], move[i, 0] = best[i - 1, 0] - f(path.skip_a), 1
        centre = int((i - 1) * (m / n))
        for j in range(max(1, centre - band), min(m, centre + band) + 1):
            best[i, j], move[i, j] = best[i - 1, j] - f(path.skip_a), 1
            if best[i, j - 1] - f(path.skip_b) > best[i, j]:
                best[i, j], move[i, j] = best[i, j - 1] - f(path.skip_b), 2
            pair = best[i - 1, j - 1] + (f(sim[i - 1, j - 1]) - f(path.match))
            if pair > best[i, j]:
                best[i, j], move[i, j] = pair, 3
    out, i, j = [], n, m
    while i > 0 and j > 0:
        if move[i, j] == 3 and f(sim[i - 1, j - 1]) >= f(path.output):
            out.append((10 * (i - 1) + 3, 10 * (j - 1) + 3, float(sim[i - 1, j - 1])))
        i, j = i - (move[i, j] != 2), j - (move[i, j] >= 2)
    return out[::-1]


@pytest.mark.parametrize("tile", [4, 512])
def test_tiles_equal_the_whole_table(spark, tile):
    paths = [tiles.Path(0.2, 0.25, 0.01, 0.01, 0.2, 3), tiles.Path(-0.5, 0.1, 0.0, 0.02, 1.0, 1)]
    groups = {1: cues(1, 10, 13), 2: cues(2, 16, 3), 3: cues(3, 4, 15), 4: cues(4, 1, 1), 5: cues(5, 6, 0), None: cues(6, 9, 9)}
    rows = spark.createDataFrame([(k, *r) for k, rs in groups.items() for r in rs], "k int, " + SCHEMA).repartition(3)
    for path in paths[: 1 if tile == 4 else 2]:
        got = {}
        for r in tiles.aligned(rows, ["k"], BLEND, path, tile).collect():
            got.setdefault(r.k, []).append((r.a_pos, r.b_pos, r.score))
        want = {k: in_plain_python(dense(rs, BLEND), path) for k, rs in groups.items() if rs and k != 5}
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
        assert got


def test_similarity_is_made_inside_the_band_only(spark):
    groups = {1: cues(7, 14, 11), 2: cues(8, 3, 12)}
    rows = spark.createDataFrame([(k, *r) for k, rs in groups.items() for r in rs], "k int, " + SCHEMA)
    path = tiles.Path(ratio=0.1, least=2)
    got = {(r.k, r.a_pos, r.b_pos): r.score for r in tiles.blended(rows, ["k"], BLEND, path, 4).collect()}
    want = {}
    for k, rs in groups.items():
        sim = dense(rs, BLEND)
        n, m = sim.shape
        band = int(max(min(2, m), 0.1 * m))
        want |= {(k, 10 * i + 3, 10 * j + 3): sim[i, j] for i in range(n) for j in range(m) if abs(j + 1 - int(i * (m / n))) <= band}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_long_sequences_spread_and_nothing_comes_of_nothing(spark):
    rows = spark.createDataFrame([(s, i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for s in "ab" for i in range(16)], "side string, pos long, vector array<double>")
    blocks = tiles._packed(rows, [], ["vector"], 4)
    assert blocks.agg(F.max(F.size("rows"))).first()[0] == 4 and blocks.count() == 8
    got = tiles.aligned(rows, [], tiles.Blend(), tiles.Path(ratio=0.1, least=3), 4)
    assert sorted(map(tuple, got.collect())) == [(i, i, 1.0) for i in range(16)]
    assert tiles.aligned(rows.where("side = 'a'"), [], tiles.Blend(), tiles.Path()).count() == 0
    assert tiles.aligned(rows.limit(0), [], tiles.Blend(), tiles.Path()).count() == 0


def group_cues(seed, n, m):
    gen, rnd = np.random.default_rng(seed), random.Random(seed)
    base = [x / np.linalg.norm(x) for x in gen.normal(size=(max(n, m), 5))]
    out = []
    for side, k in (("a", n), ("b", m)):
        for i in range(k):
            v = base[i * max(n, m) // k] + 0.25 * gen.normal(size=5)
            out.append((side, 5 * i, 1.5 * i, 1.5 * i + 1, (v / np.linalg.norm(v)).tolist(), rnd.sample(NAMES, rnd.randint(0, 1)) if side == "a" else None, rnd.choice([None, None, *NAMES]) if side == "b" else None))
    return out


@pytest.mark.parametrize(("largest", "speakers"), [((3, 3), False), ((2, 3), True)])
def test_groups_in_tiles_equal_the_whole_table(spark, largest, speakers):
    import pandas as pd

    from tidemark.operators import align

    groups = {1: group_cues(1, 13, 11), 2: group_cues(2, 4, 12), 3: group_cues(3, 9, 2), 4: group_cues(4, 1, 1), None: group_cues(5, 8, 8), 6: group_cues(6, 3, 0)}
    rows = spark.createDataFrame([(k, *r) for k, rs in groups.items() for r in rs], "k int, side string, pos long, s double, e double, vector array<double>, names array<string>, name string").repartition(3)
    how = tiles.Grouping(largest, 0.45, 0.5, 0.05, 0.04, 0.3, speakers)
    want = {}
    for k, rs in groups.items():
        a, b = (pd.DataFrame([r for r in rs if r[0] == x], columns=["side", "pos", "s", "e", "vector", "names", "name"]) for x in "ab")
        if len(a) and len(b):
            scores = {(p, q): align.group_scores(a, b, p, q, 0.3) for p, q in how.sizes(len(a), len(b))}
            for (p, q), found in scores.items():
                for i, j in np.ndindex(*found.shape):
                    own, other = [x for xs in a.names[i : i + p] for x in xs], b.name[j]
                    if speakers and own and other and not any(x.startswith(other) or other.startswith(x) for x in own):
                        found[i, j] = np.nan
            want[k] = sorted((a.pos[i : i + p].tolist(), b.pos[j : j + q].tolist(), f"{p}:{q}", s) for i, j, p, q, s in align.group_path(scores, len(a), len(b), 0.45, 0.5, 0.05, 0.04))
    for tile in (4, 512):
        got = {}
        for r in tiles.grouped(rows, ["k"], how, tile).collect():
            got.setdefault(r.k, []).append((r.a_pos, r.b_pos, r.alignment, r.score))
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}, tile
    assert speakers or {x[2] for v in want.values() for x in v} > {"1:1"}
    assert tiles.grouped(rows.where("side = 'a'"), ["k"], how).count() == 0


def test_similarities_are_summed_and_rounded_as_in_sql():
    import pyarrow as pa

    block = lambda rows: pa.array([{"vector": list(map(float, r))} for r in rows], pa.struct([("vector", pa.list_(pa.float64()))]))
    half = 0.8498691185
    assert half * 1e9 % 1 == 0.5
    assert tiles.similarity(block([[half], [-half]]), block([[1]]), tiles.Blend()).tolist() == [[0.849869119], [-0.849869119]]  # halves go away from zero
    x, y = np.random.RandomState(3).rand(2, 300, 4)
    want = [[((a[0] * b[0] + a[1] * b[1]) + a[2] * b[2]) + a[3] * b[3] for b in y.tolist()] for a in x.tolist()]
    assert tiles._products(x, y).tolist() == want  # to the last bit


def test_short_sequences_are_filled_together_and_a_way_back_is_one_job_a_diagonal(spark, monkeypatch):
    import pyarrow as pa

    how, filled = tiles.Grouping((2, 2)), []
    cues = [{"at": i, "pos": i, "s": float(i), "e": i + 1.0, "vector": [1.0, float(i)]} for i in range(6)]
    monkeypatch.setattr(tiles, "_fill_groups", lambda gains, sums, *rest, f=tiles._fill_groups: filled.append(sums.shape[2]) or f(gains, sums, *rest))
    batch = pa.RecordBatch.from_pylist([{"scope": str(k), "rows_a": cues[: 3 + k % 4], "rows_b": cues[: 6 - k % 3], "ti": 0, "tj": 0, "a0": 0.0, "a1": 6.0, "b0": 0.0, "b1": 6.0} for k in range(60)])
    assert sum(len(x) for x in tiles._tables(iter([batch]), 8, how)) == sum(filled) == 60 and len(filled) == 1
    written = []
    monkeypatch.setattr(tiles, "stored", lambda df, f=tiles.stored: written.append(1) or f(df))
    rows = spark.createDataFrame([(s, i, float(i), i + 1.0, [1.0, float(i)]) for s in "ab" for i in range(9)], "side string, pos long, s double, e double, vector array<double>")
    tiles.grouped(rows, [], how, 4)
    assert len(written) == 2 + 4 + 5  # blocks and lengths, four diagonals there, five back


def test_rounding_makes_no_whole_copies():
    x = np.random.RandomState(1).randn(700, 900)
    x[0, :4] = [0.5e-9, -0.5e-9, 1.5e-9, -2.5e-9]
    scaled = x * 1e9
    whole = np.trunc(scaled)
    want = np.where(np.abs(scaled - whole) == 0.5, whole + np.sign(scaled), np.rint(scaled)) / 1e9
    tracemalloc.start()
    got = tiles._nine_digits(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, want) and most < x.nbytes / 2
