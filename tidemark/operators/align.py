"""Matching of two ordered sequences of cues with vectors: alignments, retrieval, candidate spans, staged and forced matches.

Monotonic and group alignments run in tiles (``tiles.py``); all ranking, retrieval, bounds and filling are windows and joins. Vectors are given; none are made here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from tidemark.functions.cues import clamp
from tidemark.operators import tiles
from tidemark.operators.folds import ordered_fold
from tidemark.storage import large, spent, stored

By = list[str]


def monotonic_path(sim: np.ndarray, match: float, output: float, skip_a: float, skip_b: float, band: int) -> list[tuple[int, int, float]]:
    """(i, j, similarity) of the best increasing alignment inside a band around the diagonal, the whole table as one tile.

    A pair counts its similarity less ``match``; skipped rows and columns cost their penalties. Pairs below ``output``
    are walked over but not returned. For ties see ``tiles.fill``.
    """
    n, m = sim.shape
    path = tiles.Path(match, output, skip_a, skip_b)
    move = tiles.fill(sim, 0, 0, n, m, band, path, tiles._edge(skip_b, m), tiles._edge(skip_a, n)[1:])[1]
    found, i, j = [], n, m
    while i > 0 and j > 0:
        if move[i, j] == 3 and np.float32(sim[i - 1, j - 1]) >= np.float32(output):
            found.append((i - 1, j - 1, float(np.float32(sim[i - 1, j - 1]))))
        i, j = i - (move[i, j] != 2), j - (move[i, j] >= 2)
    return found[::-1]


def _schema(df: DataFrame, by: By, rest: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", " + rest


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def progress_matrix(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    """1 where two cues lie equally far in their spans, falling to 0 at a difference of ``width``."""
    return np.clip(1 - np.abs(a[:, None] - b[None, :]) / width, 0, 1)


def monotonic_align(rows: DataFrame, by: By, match: float = 0.46, output: float = 0.50, skip_a: float = 0.015, skip_b: float = 0.010, band_ratio: float = 0.22, band_min: int = 180, progress_weight: float = 0.0, width: float = 0.35) -> DataFrame:
    """Aligns both sides of each group, in tiles; rows: side ('a' or 'b'), pos, vector, and s and e if progress has a weight.

    The similarity is the vectors' product, plus the progress in both spans by its weight. Result: a_pos, b_pos, score.
    """
    if progress_weight:
        w = Window.partitionBy(*by, "side")
        start = F.min("s").over(w)
        rows = rows.withColumn("progress", clamp(((F.col("s") + F.col("e")) / 2 - start) / F.greatest(F.max("e").over(w) - start, F.lit(1.0)), 0.0, 1.0))
    return tiles.aligned(rows, by, tiles.Blend(progress=progress_weight, width=width), tiles.Path(match, output, skip_a, skip_b, band_ratio, band_min))


def group_scores(a: pd.DataFrame, b: pd.DataFrame, p: int, q: int, least: float = 0.50) -> np.ndarray:
    """``tiles.group_scores`` of two whole sequences (vector, s, e)."""
    one, two = ((np.stack(x.vector).astype(float), x.s.to_numpy(float), x.e.to_numpy(float)) for x in (a, b))
    return tiles.group_scores(one, two, p, q, least, (one[1][0], one[2][-1], two[1][0], two[2][-1]))


def group_path(scores: dict[tuple[int, int], np.ndarray], n: int, m: int, match: float, output: float, skip_a: float, skip_b: float) -> list[tuple[int, int, int, int, float]]:
    """(i, j, p, q, score) of the best alignment by groups, the whole table as one tile; on equal sums larger groups of a, then of b, then skips last."""
    how = tiles.Grouping(match=match, output=output, skip_a=skip_a, skip_b=skip_b)
    move = tiles.fill_groups(scores, (n, m), (1, 1), tiles.whole_border(n, m, how), how)[1]
    sizes, found = sorted(scores, reverse=True), []
    i, j = n, m
    while i > 0 and j > 0:
        if move[i, j] >= len(sizes):
            i, j = i - (move[i, j] == len(sizes)), j - (move[i, j] > len(sizes))
        else:
            p, q = sizes[move[i, j]]
            i, j = i - p, j - q
            if scores[p, q][i, j] >= output:
                found.append((i, j, p, q, float(scores[p, q][i, j])))
    return found[::-1]


def group_align(rows: DataFrame, by: By, max_a: int = 3, max_b: int = 3, match: float = 0.60, output: float = 0.68, skip_a: float = 0.08, skip_b: float = 0.05, least: float = 0.50, speakers: bool = False) -> DataFrame:
    """Aligns groups of up to ``max_a`` and ``max_b`` neighbours, in tiles; rows: side, pos, s, e (seconds), vector. Result:
    a_pos and b_pos as arrays, alignment ('2:1') and score.

    ``speakers``: groups whose speakers differ don't match. The columns are then ``names``, all that a cue of a names, and
    ``name``, what a cue of b begins with; of a group of b its first cue's counts.
    """
    return tiles.grouped(rows, by, tiles.Grouping((max_a, max_b), match, output, skip_a, skip_b, least, speakers))


@F.pandas_udf(StructType().add("first", LongType()).add("last", LongType()).add("score", DoubleType()))
def _best_span(vector: pd.Series, vectors: pd.Series, starts: pd.Series, ends: pd.Series, span: pd.Series, least: pd.Series) -> pd.DataFrame:
    out = []
    for v, vs, s, e, d, k in zip(vector, vectors, starts, ends, span, least, strict=True):
        best = (-1, -1, -np.inf)
        total = np.cumsum(np.vstack((np.zeros(len(v)), np.stack(vs))), axis=0) if len(vs) else None
        for i in range(len(vs)):
            for j in range(i + k - 1, len(vs)):
                own, other = max(d, 0.25), max(e[j] - s[i], 0.25)
                x = 0.88 * float(_unit(total[j + 1] - total[i]) @ np.asarray(v)) + 0.07 * min(own, other) / max(own, other) - 0.05 * (j - i)
                best = (i, j, x) if x > best[2] else best
        out.append(best)
    return pd.DataFrame(out, columns=["first", "last", "score"])


def best_subset(rows: DataFrame) -> DataFrame:
    """Adds ``best`` (first, last, score): the run of neighbouring cues that suits a row best, the first on ties.

    rows: vector, duration (seconds), least (cues), and as arrays the cues' vectors, starts and ends, in order.
    """
    return rows.withColumn("best", _best_span("vector", "vectors", "starts", "ends", "duration", "least"))


def greedy_pairs(candidates: DataFrame, by: By) -> DataFrame:
    """Per segment in order the best candidate whose cue comes after all cues taken before; others go without.

    candidates: segment, cue, score, context. A group's state is one number, the last cue taken.
    """

    def step(state, segment, cue):
        last, done = state
        free = segment != done and cue > last
        return ((cue, segment) if free else state), free

    rows = candidates.withColumn("_score", -F.col("score")).withColumn("_context", -F.col("context"))
    made = ordered_fold(rows, by, ["segment", "_score", "_context", "cue"], ["segment", "cue"], lambda: (-1, None), step, "_taken", "boolean")
    return made.where("_taken").select(candidates.columns)


def best_per_part(scores: DataFrame, by: By, k: int = 40, top: int = 8, bonus: float = 0.02, cap: float = 0.06, divisor: float = 20_000.0) -> DataFrame:
    """Parts that a clip (by) fits best, from scores (chunk, window, part, start, score).

    Of each chunk's ``k`` best windows the best of each part stays. A part's score is their mean, plus ``bonus`` for each
    chunk, less the spread of their starts over ``divisor``, ``cap`` at most. It is represented by the window whose start
    is nearest to their median, the earliest chunk's on ties. The ``top`` parts of each clip are returned with a rank.
    """
    chunk = Window.partitionBy(*by, "chunk")
    best = scores.withColumn("_r", F.row_number().over(chunk.orderBy(F.col("score").desc(), F.col("window").desc()))).where(F.col("_r") <= k)
    best = best.withColumn("_p", F.row_number().over(Window.partitionBy(*by, "chunk", "part").orderBy("_r"))).where("_p = 1")
    best = best.withColumn("_mid", F.median("start").over(Window.partitionBy(*by, "part")))
    near = F.min(F.struct(F.abs(F.col("start") - F.col("_mid")).alias("d"), F.col("chunk").alias("c"), F.col("window").alias("window"), F.col("start").alias("start"))).alias("near")
    parts = best.groupBy(*by, "part").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("hits"), (F.max("start") - F.min("start")).alias("spread"), near)
    total = F.col("mean") + bonus * F.col("hits") - F.least(F.lit(cap), F.col("spread") / divisor)
    parts = parts.select(*by, "part", F.col("near.window").alias("window"), F.col("near.start").alias("start"), "hits", "spread", F.round(total, 4).alias("score"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "part", "start"))
    return parts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def anchored_bounds(blocks: DataFrame, rows: DataFrame, by: By, pad: int) -> DataFrame:
    """Adds lower and upper to blocks (block, first, last, est_first, est_last, total): where their partners can stand.

    Nearest rows (pos, lo, hi) with partners before and after a block bound it; the estimate widened by ``pad`` bounds it
    too, and alone if nothing is left between them. By as-of windows over blocks and rows together.
    """
    marks = rows.where("lo is not null").select(*by, F.col("pos").alias("_t"), "lo", "hi")
    left = blocks.select(*by, "block", (F.col("first") - 0.5).alias("_t"), F.lit(1).alias("_left"))
    right = blocks.select(*by, "block", (F.col("last") + 0.5).alias("_t"), F.lit(0).alias("_left"))
    every = marks.unionByName(left, allowMissingColumns=True).unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_t")
    every = every.withColumn("_before", F.last("hi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.first("lo", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    ends = every.where("block is not null").groupBy(*by, "block").agg(F.max(F.when(F.col("_left") == 1, F.col("_before"))).alias("_before"), F.max(F.when(F.col("_left") == 0, F.col("_after"))).alias("_after"))
    out = blocks.join(ends, [*by, "block"])
    start, end = F.greatest(F.lit(0), F.col("est_first") - pad), F.least(F.col("total"), F.col("est_last") + pad + 1)
    lower, upper = F.greatest(start, F.coalesce(F.col("_before") + 1, F.lit(0))), F.least(end, F.coalesce("_after", F.col("total")))
    free = lower < upper
    return out.withColumn("lower", F.when(free, lower).otherwise(start)).withColumn("upper", F.when(free, upper).otherwise(end)).drop("_before", "_after")


def span_candidates(blocks: DataFrame, cues: DataFrame, by: By, longest: int, top: int, least: float = 0.36) -> DataFrame:
    """The ``top`` runs of up to ``longest`` unused neighbouring cues for each block, by score.

    blocks: block, lower, upper, est_first, est_last, duration, vector, text-independent ``bonus`` if there is one;
    cues: pos, used, s, e (seconds), vector. Runs are made once for all blocks, by frames; blocks meet them by position.
    """
    w = Window.partitionBy(*by).orderBy("pos")
    runs = None
    for k in range(1, longest + 1):
        frame = w.rowsBetween(0, k - 1)
        total = F.aggregate(F.slice(F.collect_list("vector").over(frame), 2, k), F.col("vector"), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
        made = cues.select(*by, "pos", F.lit(k).alias("n"), F.count(F.lit(1)).over(frame).alias("_n"), F.max("used").over(frame).alias("_used"), "s", F.last("e").over(frame).alias("e"), total.alias("run"))
        made = made.where((F.col("_n") == k) & ~F.col("_used")).drop("_n", "_used")
        runs = made if runs is None else runs.unionByName(made)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    runs = runs.withColumn("_size", F.sqrt(dot("run", "run")))
    spread = blocks.withColumnRenamed("vector", "own").withColumn("pos", F.explode(F.sequence("lower", F.col("upper") - 1)))
    pairs = spread.where("lower < upper").join(runs, [*by, "pos"]).where(F.col("pos") + F.col("n") <= F.col("upper"))
    meaning = dot("own", "run") / F.greatest(F.col("_size"), F.lit(1e-12))
    a, b = F.greatest(F.col("duration"), F.lit(0.25)), F.greatest(F.col("e") - F.col("s"), F.lit(0.25))
    away = F.abs((F.col("est_first") + F.col("est_last")) / 2 - (F.col("pos") + F.col("n") / 2 - 0.5))
    near = F.greatest(F.lit(0.0), 1 - away / F.greatest((F.col("est_last") - F.col("est_first") + 1) * 0.75, F.lit(6.0)))
    bonus = F.col("bonus") if "bonus" in blocks.columns else F.lit(0.0)
    pairs = pairs.withColumn("_m", meaning).where(F.col("_m") >= least).withColumn("score", F.round(0.78 * F.col("_m") + 0.12 * near + 0.07 * F.least(a, b) / F.greatest(a, b) + bonus, 4))
    rank = F.row_number().over(Window.partitionBy(*by, "block").orderBy(F.col("score").desc(), "pos", "n"))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select(*by, "block", "rank", "pos", "n", "score")


def split_blocks(rows: DataFrame, by: By, most: int) -> DataFrame:
    """Blocks of at most ``most`` rows (block, pos): larger ones in pieces with a suffix, ``_sub01`` and on."""
    w = Window.partitionBy(*by, "block")
    n, r = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("pos"))
    piece = F.format_string("%s_sub%02d", F.col("block"), F.floor((r - 1) / most).cast("int") + 1)
    return rows.withColumn("_n", n).withColumn("_piece", piece).withColumn("block", F.when(F.col("_n") > most, F.col("_piece")).otherwise(F.col("block"))).drop("_n", "_piece")


def spaced_indices(total: Column, count: Column) -> Column:
    """``count`` positions of ``total``, evenly spaced from the first to the last, as an array; the first for one."""
    whole = F.sequence(F.lit(0), F.greatest(total, F.lit(1)) - 1)
    step = (total - 1) / F.greatest(count - 1, F.lit(1))
    spaced = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.bround(i * step).cast("int")))
    return F.when((total <= 0) | (count <= 0), F.array().cast("array<int>")).when(count >= total, whole.cast("array<int>")).when(count == 1, F.array(F.lit(0))).otherwise(spaced)


def _gaps(rows: DataFrame, by: By, matched: Column) -> DataFrame:
    """Rows between two matched ones, with the gap's number and their place in it."""
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("gap", F.sum(matched.cast("int")).over(w)).where(~matched)
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*by, "gap").orderBy("pos")))


def fill_gaps(a: DataFrame, b: DataFrame, by: By, most: int | None, score: float, origin: str) -> DataFrame:
    """Pairs (a_pos, b_pos) of what two sequences (pos, matched) have left between the same matched neighbours, in order.

    Matched rows of both sides are partners in order. ``most``: only gaps of at most so many rows on each side.
    """
    x, y = _gaps(a, by, F.col("matched")), _gaps(b, by, F.col("matched"))
    if most is not None:
        n = lambda: F.count(F.lit(1)).over(Window.partitionBy(*by, "gap"))
        x, y = (t.withColumn("_n", n()).where(F.col("_n") <= most).drop("_n") for t in (x, y))
    pairs = x.select(*by, "gap", "k", F.col("pos").alias("a_pos")).join(y.select(*by, "gap", "k", F.col("pos").alias("b_pos")), [*by, "gap", "k"])
    return pairs.select(*by, "a_pos", "b_pos", F.lit(score).alias("score"), F.lit(origin).alias("origin"))


def fill_tail(a: DataFrame, b: DataFrame, by: By, score: float, origin: str) -> DataFrame:
    """All rows of ``a`` that are still unmatched, each with one of the rows of ``b``, evenly spaced over them; rows of
    ``b`` serve several if they are fewer. a, b: pos, matched."""
    free = a.where(~F.col("matched")).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("pos")) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    pool = b.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("pos")) - 1)
    total = pool.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    at = F.when(F.col("_n") == 1, F.lit(0)).otherwise(F.bround(F.col("_k") * (F.col("_m") - 1) / (F.col("_n") - 1)))
    placed = free.join(total, by).withColumn("_r", at.cast("long"))
    pairs = placed.select(*by, F.col("pos").alias("a_pos"), "_r").join(pool.select(*by, F.col("pos").alias("b_pos"), F.col("_r").cast("long").alias("_r")), [*by, "_r"])
    return pairs.select(*by, "a_pos", "b_pos", F.lit(score).alias("score"), F.lit(origin).alias("origin"))


def exclusive(pairs: DataFrame, by: By) -> DataFrame:
    """Of pairs (by, a_pos, b_pos, score) those that share no row: by score, then a_pos, then b_pos, the best first.

    Every free row of both sides proposes to its best partner; pairs that are best for both are taken, all pairs that
    share a row with them go, and the losers propose again. A round takes every pair that no better one touches, so it gives what
    taking one after the other gives, in few rounds; each takes at least the best pair of every group. Rounds work on
    stored tables and on partial aggregates. Repeated pairs count once.
    """
    best = F.max(F.struct("score", (-F.col("a_pos")).alias("x"), (-F.col("b_pos")).alias("y"))).alias("_best")
    waiting, taken = stored(pairs.select(*by, "a_pos", "b_pos", "score").distinct()), None
    while not waiting.isEmpty():
        of = lambda side: waiting.groupBy(*by, side).agg(best).select(*by, (-F.col("_best.x")).alias("a_pos"), (-F.col("_best.y")).alias("b_pos"), F.col("_best.score").alias("score"))  # noqa: B023, E731
        both = stored(of("a_pos").join(large(of("b_pos")), [*by, "a_pos", "b_pos", "score"], "left_semi"))
        rest = waiting.join(large(both.select(*by, "a_pos")), [*by, "a_pos"], "left_anti").join(large(both.select(*by, "b_pos")), [*by, "b_pos"], "left_anti")
        rest = stored(rest.select(waiting.columns))
        spent(waiting)
        waiting, taken = rest, both if taken is None else taken.unionByName(both)
    return waiting if taken is None else taken


Stage = tuple[str, Callable[[DataFrame, DataFrame], DataFrame]]


def staged(a: DataFrame, b: DataFrame, by: By, reserved: DataFrame, stages: list[Stage]) -> DataFrame:
    """Pairs (a_pos, b_pos, score, origin): the reserved ones, then what each stage finds among the rows still free.

    A stage takes the free rows of both sides and gives pairs (by, a_pos, b_pos, score); of these ``exclusive`` ones stay.
    Rows are free until a pair has them, so stages can't take each other's. For the five stages of a part see ``matching``.
    """
    found = stored(reserved.select(*by, "a_pos", "b_pos", "score", F.lit("reserved").alias("origin")))
    for name, stage in stages:
        free_a = a.join(found.select(*by, F.col("a_pos").alias("pos")), [*by, "pos"], "left_anti")
        free_b = b.join(found.select(*by, F.col("b_pos").alias("pos")), [*by, "pos"], "left_anti")
        found = stored(found.unionByName(exclusive(stage(free_a, free_b), by).withColumn("origin", F.lit(name))))
    return found


def proportional_chunks(rows: DataFrame, by: By, size: int, pad: int) -> DataFrame:
    """Chunks of ``size`` rows of side a (pos), with the proportional stretch of side b widened by ``pad``: chunk, a_first,
    a_end, b_first, b_end. rows: side, pos from 0. Groups of at most ``size`` rows, or with one row of b, have none."""
    sums = rows.groupBy(*by).agg(F.count_if(F.col("side") == "a").alias("n"), F.count_if(F.col("side") == "b").alias("m")).where((F.col("n") > size) & (F.col("m") > 1))
    out = sums.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))))
    first, end = F.col("chunk") * size, F.least(F.col("n"), (F.col("chunk") + 1) * size)
    share = lambda x: F.bround(x * F.col("m") / F.col("n")).cast("long")
    out = out.withColumn("a_first", first.cast("long")).withColumn("a_end", end.cast("long"))
    return out.withColumn("b_first", F.greatest(F.lit(0), share(first) - pad)).withColumn("b_end", F.least(F.col("m"), share(end) + pad)).where("b_first < b_end").drop("n", "m")


def sweep(rows: DataFrame, combos: list[dict], run: Callable[..., DataFrame], summary: list[Column], order: list[Column]) -> DataFrame:
    """One summary row for each combination of parameters, best first: ``run(rows, **combo)`` aggregated by ``summary``."""
    out = None
    for i, combo in enumerate(combos):
        one = run(rows, **combo).agg(*summary).withColumn("combo", F.lit(i)).withColumn("params", F.lit(str(sorted(combo.items()))))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(*order, "combo")


def assignment_search(choices: DataFrame, by: By, keep: int = 8) -> DataFrame:
    """The ``keep`` best ways to give every clip (pos) one of its choices (part, score) with parts in ascending order.

    Clip after clip, each group's assignments are extended and all but the best ``keep`` for each last part are dropped:
    what follows depends on the last part only, so none of the best is lost. Result: rank, parts (array), score.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        open_: dict = {None: [(0.0, ())]}
        for _, mine in pdf.sort_values(["pos", "part"], kind="stable").groupby("pos"):
            after: dict = {}
            for last, paths in open_.items():
                for part, score in zip(mine["part"], mine["score"], strict=True):
                    if last is None or part >= last:
                        after.setdefault(part, []).extend((t + score, (*p, part)) for t, p in paths)
            open_ = {part: sorted(paths, key=lambda x: (-round(x[0], 9), x[1]))[:keep] for part, paths in after.items()}
        every = sorted((x for paths in open_.values() for x in paths), key=lambda x: (-round(x[0], 9), x[1]))[:keep]
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in by), i + 1, list(p), t] for i, (t, p) in enumerate(every)], columns=[*by, "rank", "parts", "score"])

    return choices.groupBy(*by).applyInPandas(run, _schema(choices, by, "rank long, parts array<long>, score double"))
