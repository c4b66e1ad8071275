"""Forced filling: what stages left open in each clip is matched by ever looser rules, until nothing is gained.

All clips of all parts go through a pass together. A pass works on open runs of a, each with the stretch of b between the
partners of its neighbours. Runs whose stretches lie apart don't affect each other and are matched at once; a run whose
stretch overlaps that of an open one before it waits for the next wave, so the result is that of one run after the other.
Waves work on stored tables; each takes at least the first open run of every clip. Runs that are long are cut in chunks, one
after the other, since their stretches overlap by a margin.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_text
from tidemark.operators import matching, tiles
from tidemark.operators.matching import By, Groups, Scope, free_a, free_b
from tidemark.storage import large, spent, stored

SHORT = ((1, 6, 0.08), (2, 10, 0.05))
MARGIN = 12


def blend(progress: float) -> tiles.Blend:
    return tiles.Blend(0.76, 0.24, progress, 0.16, 0.06, 0.04, SHORT)


def _scope(origin: str, progress: float, match: float, output: float, skip_a: float, skip_b: float, around: tuple[int, int]) -> Scope:
    return Scope(origin, blend(progress), tiles.Path(match, output, skip_a, skip_b, 1.0, 80), around, False)


@dataclass(frozen=True)
class Passes:
    """The passes' settings, in their order. ``least`` and ``most`` count cues of a run; ``pad`` widens estimated stretches."""

    window: Scope = _scope("forced-clip-window-v1", 0.28, 0.06, 0.12, 0.004, 0.002, (2, 1))
    rerun: Scope = _scope("forced-clip-window-rerun-v1", 0.32, 0.04, 0.10, 0.003, 0.0015, (1, 1))
    reruns: int = 2
    chunk: int = 64
    gap: Scope = _scope("forced-gap-rescue-v1", 0.36, 0.02, 0.06, 0.002, 0.001, (1, 1))
    gap_least: int = 3
    gap_pad: int = 10
    group: Groups = Groups("forced-group-gap-v1", "forced-group-gap-", 2, 0.30, 0.38, 0.015, 0.01, True)
    group_least: int = 2
    group_pad: int = 8
    micro_most: tuple[int, int] = (2, 3)
    micro_score: float = 0.22
    tail: tuple[int, float, float] = (20, 0.8, 0.18)  # open cues of a at least, free ones of b for each at least, score
    part: Scope | None = None
    part_tail: tuple[int, float, float] = (60, 0.45, 0.14)
    names: dict[str, str] = field(default_factory=dict)


PART = _scope("forced-part-global-v1", 0.22, 0.04, 0.09, 0.003, 0.0015, (1, 1))


def indexed(rows: DataFrame, keys: By) -> DataFrame:
    """rows with ``at``, their place in the clip from 0, and ``total``."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("at", F.row_number().over(w.orderBy("pos")) - 1).withColumn("total", F.count(F.lit(1)).over(w))


def placed(a: DataFrame, b: DataFrame, found: DataFrame, by: By, keys: By) -> DataFrame:
    """a with ``matched`` and ``ends``: first and last place of its partners in its clip, null without partners."""
    partners = found.select(*by, F.col("a_pos").alias("pos"), F.explode_outer("b_pos").alias("_b"))
    spots = b.select(*by, F.col("pos").alias("_b"), F.col("clip").alias("_clip"), F.col("at").alias("_at"))
    partners = partners.join(large(spots), [*by, "_b"], "left").join(large(a.select(*keys, "pos")), [*by, "pos"])
    inside = F.when(F.col("_clip") == F.col("clip"), F.col("_at"))
    ends = partners.groupBy(*keys, "pos").agg(F.lit(True).alias("matched"), F.when(F.count("_b") > 0, F.struct(F.min(inside).alias("lo"), F.max(inside).alias("hi"))).alias("ends"))
    return a.join(large(ends), [*keys, "pos"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def open_runs(rows: DataFrame, sizes: DataFrame, keys: By, pad: int) -> DataFrame:
    """Runs of open cues: keys, first, last, before and after (their neighbours' ends), lo, hi (the stretch of b), sure
    (whether the cue before has partners). sizes: keys, m. Without a neighbour's partner an end is estimated by
    proportion and ``pad``."""
    w = Window.partitionBy(*keys).orderBy("at")
    earlier, later = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("_before", F.last("ends", ignorenulls=True).over(earlier)).withColumn("_after", F.first("ends", ignorenulls=True).over(later))
    rows = rows.withColumn("_run", F.sum(F.col("matched").cast("int")).over(w)).withColumn("_near", F.lag("ends").over(w).isNotNull() | (F.col("at") == 0))
    runs = rows.where(~F.col("matched")).groupBy(*keys, "_run").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.first("total").alias("n"), F.min_by("_before", "at").alias("before"), F.min_by("_after", "at").alias("after"), F.min_by("_near", "at").alias("sure")
    )
    runs = runs.drop("_run").join(large(sizes), keys)
    share = lambda x: F.bround(x / F.col("n") * F.col("m")).cast("int")
    lo = F.coalesce(F.col("before.hi") + 1, F.greatest(F.lit(0), share(F.col("first")) - pad))
    hi = F.coalesce(F.col("after.lo") - 1, F.least(F.col("m") - 1, share(F.col("last") + 1) + pad))
    return runs.withColumn("lo", lo).withColumn("hi", hi)


Step = Callable[[DataFrame, DataFrame], DataFrame]


def in_waves(found: DataFrame, a: DataFrame, b: DataFrame, by: By, keys: By, pad: int, wanted: Callable[[DataFrame], DataFrame], step: Step) -> DataFrame:
    """``step`` applied to the runs that are open now, as if clip by clip one run came after the other.

    ``wanted`` chooses and completes runs; ``step(found, runs)`` gives the matches after them. Stretches are taken anew in
    every wave; a run without partners right before it waits for all before it, since those may become its neighbours.
    """
    sizes = b.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("m"))
    runs = lambda: wanted(open_runs(placed(a, b, found, by, keys), sizes, keys, pad))
    waiting = stored(runs().select(*keys, "first", "last"))
    w = Window.partitionBy(*keys).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    while not waiting.isEmpty():
        now = runs().join(large(waiting), [*keys, "first", "last"], "left_semi").withColumn("_far", F.max(F.greatest("hi", "lo")).over(w))
        ready = stored(now.where(F.col("_far").isNull() | (F.col("sure") & (F.col("lo") > F.col("_far")) & (F.col("hi") >= F.col("lo")))).drop("_far"))
        found = step(found, ready)
        # a run that fell out of ``wanted`` meanwhile is over too, so only those that are still there wait on
        rest = stored(now.join(large(ready), [*keys, "first"], "left_anti").select(*keys, "first", "last"))
        spent(waiting, ready)
        waiting = rest
    spent(waiting)
    return found


def members(runs: DataFrame, a: DataFrame, b: DataFrame, found: DataFrame, by: By, keys: By) -> tuple[DataFrame, DataFrame]:
    """The open cues of a and the free cues of b of each run, with ``run`` and their rank in it from 0."""
    mine = runs.select(*keys, F.col("first").alias("run"), F.explode(F.sequence("first", "last")).alias("at")).join(large(a), [*keys, "at"])
    theirs = runs.where("lo <= hi").select(*keys, F.col("first").alias("run"), F.explode(F.sequence("lo", "hi")).alias("at")).join(large(b), [*keys, "at"])
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "run").orderBy("at")) - 1)
    return ranked(free_a(mine, found, by)), ranked(free_b(theirs, found, by))


def in_chunks(mine: DataFrame, theirs: DataFrame, keys: By, size: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of runs with ``chunk``: pieces of ``size`` cues of a, each with the proportional stretch of b and MARGIN
    cues more at both ends; a run of at most ``size``, or with one cue of b, is one piece."""
    counts = mine.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("_n")).join(large(theirs.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("_m"))), [*keys, "run"])
    whole = (F.col("_n") <= size) | (F.col("_m") <= 1)
    mine = mine.join(large(counts), [*keys, "run"]).withColumn("chunk", F.when(whole, 0).otherwise(F.floor(F.col("rank") / size)).cast("int"))
    pieces = counts.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.when(whole, 0).otherwise(F.floor((F.col("_n") - 1) / size)).cast("int"))))
    share = lambda x: F.bround(x / F.col("_n") * F.col("_m")).cast("int")
    lo = F.when(whole, 0).otherwise(F.greatest(F.lit(0), share(F.col("chunk") * size) - MARGIN))
    hi = F.when(whole, F.col("_m")).otherwise(F.least(F.col("_m"), share(F.least(F.col("_n"), (F.col("chunk") + 1) * size)) + MARGIN))
    pieces = pieces.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo < _hi")
    theirs = pieces.select(*keys, "run", "chunk", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)).alias("rank")).join(large(theirs), [*keys, "run", "rank"])
    return mine.drop("_n", "_m"), theirs.select(*keys, "run", "chunk", *(c for c in theirs.columns if c not in (*keys, "run", "chunk")))


def spoken(rows: DataFrame) -> DataFrame:
    return rows.where((normalize_text(F.coalesce("text", F.lit(""))) != "") & F.col("vector").isNotNull())


def by_chunks(found: DataFrame, mine: DataFrame, theirs: DataFrame, by: By, keys: By, scope: Scope, size: int, names: dict[str, str]) -> DataFrame:
    """Matches of runs piece by piece: the first piece of every run at once, then the second, and so on."""
    mine, theirs = (stored(x) for x in in_chunks(mine, theirs, keys, size))
    last = mine.agg(F.max("chunk")).first()[0]
    scoped = [*keys, "run"]
    for chunk in range(-1 if last is None else last + 1):
        own = free_a(mine.where(F.col("chunk") == chunk), found, by)
        w = Window.partitionBy(*scoped)
        own = own.withColumn("from", F.min("s").over(w)).withColumn("to", F.max("e").over(w))
        found = matching.match_scopes(found, spoken(own), spoken(theirs.where(F.col("chunk") == chunk)), by, scoped, scope, None, names, "estimated", ("from", "to"), f"forced-english-first-{scope.origin}")
    spent(mine, theirs)
    return found


def window_pass(found: DataFrame, a: DataFrame, b: DataFrame, by: By, keys: By, scope: Scope, size: int, names: dict[str, str]) -> DataFrame:
    """What lies between the matches of a clip, matched anew; windows share no cue."""
    own = placed(a, b, found, by, keys).join(large(found.select(*by, F.col("a_pos").alias("pos"), F.col("clip").alias("_own"))), [*by, "pos"], "left")
    anchors = own.where((F.col("_own") == F.col("clip")) & F.col("ends.lo").isNotNull()).select(*keys, F.col("at").alias("a_first"), F.col("at").alias("a_last"), F.col("ends.lo").alias("b_first"), F.col("ends.hi").alias("b_last"))
    every = a.select(*keys, F.lit("a").alias("side"), F.col("at").alias("pos")).unionByName(b.select(*keys, F.lit("b").alias("side"), F.col("at").alias("pos")))
    windows = stored(matching.between(anchors, every, keys))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "run").orderBy("at")) - 1)
    inside = lambda rows, side: rows.join(large(windows.where(F.col("side") == side).select(*keys, F.col("pos").alias("at"), F.col("window").alias("run"))), [*keys, "at"])
    found = by_chunks(found, ranked(free_a(inside(a, "a"), found, by)), ranked(free_b(inside(b, "b"), found, by)), by, keys, scope, size, names)
    spent(windows)
    return found


def _forced(pairs: DataFrame, by: By, score: float, origin: str, note: str, clip: Column) -> DataFrame:
    """Matches of ready-made pairs (by, a_pos, b_pos, confidence)."""
    return pairs.select(*by, "a_pos", F.lit("matched-low").alias("status"), F.lit(origin).alias("origin"), F.lit(score).alias("score"), "confidence", clip.alias("clip"), F.array("b_pos").alias("b_pos"), F.array("a_pos").alias("group"), F.lit(note).alias("note"))


def micro_step(found: DataFrame, runs: DataFrame, a: DataFrame, b: DataFrame, by: By, keys: By, score: float) -> DataFrame:
    """The open cues of small runs with the free cues of their stretch, in order."""
    mine, theirs = members(runs, a, b, found, by, keys)
    pairs = mine.select(*keys, "run", "rank", F.col("pos").alias("a_pos")).join(large(theirs.select(*keys, "run", "rank", F.col("pos").alias("b_pos"), "confidence")), [*keys, "run", "rank"])
    return matching._add(found, _forced(pairs, by, score, "forced-micro-gap-v1", "forced-micro-gap-sequential-fill", F.col("clip")))


def tail_fill(found: DataFrame, a: DataFrame, b: DataFrame, by: By, keys: By, limits: tuple[int, float, float], origin: str, note: str) -> DataFrame:
    """Open cues of a and free cues of b of each group, the fewer all, the others evenly spaced over them, in order."""
    least, ratio, score = limits
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1)
    mine, theirs = ranked(free_a(a, found, by)), ranked(free_b(b, found, by))
    counts = mine.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(large(theirs.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))), keys)
    counts = counts.where((F.col("n") >= least) & (F.col("m") / F.col("n") >= ratio)).withColumn("k", F.least("n", "m"))
    spots = counts.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))))
    spaced = lambda total: F.when(F.col(total) == F.col("k"), F.col("i")).when(F.col("k") == 1, 0).otherwise(F.bround(F.col("i") * (F.col(total) - 1) / (F.col("k") - 1))).cast("int")
    pairs = spots.select(*keys, spaced("n").alias("rank"), spaced("m").alias("to")).join(large(mine.select(*keys, "rank", F.col("pos").alias("a_pos"))), [*keys, "rank"])
    pairs = pairs.drop("rank").withColumnRenamed("to", "rank").join(large(theirs.select(*keys, "rank", F.col("pos").alias("b_pos"), "confidence", F.col("clip").alias("_clip"))), [*keys, "rank"])
    return matching._add(found, _forced(pairs, by, score, origin, note, F.col("_clip")))


def forced(a: DataFrame, b: DataFrame, clips: DataFrame, found: DataFrame, by: By, passes: Passes = Passes()) -> DataFrame:
    """``found`` and what the passes add: windows between matches, reruns until none is gained, gaps, gaps by groups, micro
    gaps, tails of clips; then, over whole parts, a pass if it is set, and tails. a, b, clips as in ``matching``; cues of
    a part without clips stay as they are."""
    keys = [*by, "clip"]
    a = stored(indexed(matching.in_clips(a, clips, by), keys))
    b = stored(indexed(b, keys))
    found = stored(found)
    found = window_pass(found, a, b, by, keys, passes.window, passes.chunk, passes.names)
    for _ in range(passes.reruns):
        before = found.count()
        found = window_pass(found, a, b, by, keys, passes.rerun, max(24, passes.chunk // 2), passes.names)
        if found.count() == before:  # nothing was gained, so another round would gain nothing either
            break

    def rescued(runs: DataFrame) -> DataFrame:
        crossed, end = F.col("lo") > F.col("hi"), F.col("m") - 1
        low = F.greatest(F.lit(0), F.least("lo", end))
        runs = runs.where(F.col("last") - F.col("first") + 1 >= passes.gap_least)
        return runs.withColumn("_lo", F.when(crossed, low).otherwise(F.col("lo"))).withColumn("hi", F.when(crossed, F.least(end, F.greatest(low, F.col("hi")))).otherwise(F.col("hi"))).withColumn("lo", F.col("_lo")).drop("_lo")

    def gap_step(found: DataFrame, runs: DataFrame) -> DataFrame:
        return by_chunks(found, *members(runs, a, b, found, by, keys), by, keys, passes.gap, max(12, passes.chunk // 2), passes.names)

    def group_step(found: DataFrame, runs: DataFrame) -> DataFrame:
        mine, theirs = (spoken(x) for x in members(runs, a, b, found, by, keys))
        return matching._add(found, stored(matching._grouped(mine, theirs, [*keys, "run"], passes.group, passes.names)))

    found = in_waves(found, a, b, by, keys, passes.gap_pad, rescued, gap_step)
    found = in_waves(found, a, b, by, keys, passes.group_pad, lambda runs: runs.where(F.col("last") - F.col("first") + 1 >= passes.group_least).where("lo <= hi"), group_step)
    most, free = passes.micro_most
    small = lambda runs: runs.where((F.col("last") - F.col("first") < most) & F.col("before.hi").isNotNull() & F.col("after.lo").isNotNull() & (F.col("hi") - F.col("lo") + 1).between(1, free))
    found = in_waves(found, a, b, by, keys, 0, small, lambda found, runs: micro_step(found, runs, a, b, by, keys, passes.micro_score))
    found = tail_fill(found, a, b, by, keys, passes.tail, "forced-tail-fill-v1", "forced-tail-fill-progressive")
    if passes.part:
        spans = a.groupBy(*by).agg(F.lit(0.0).alias("from"), F.max("e").alias("to"))
        found = matching.match_scopes(found, spoken(a.join(large(spans), by)), spoken(b), by, by, passes.part, None, passes.names, "estimated", ("from", "to"), f"forced-english-first-{passes.part.origin}")
    return tail_fill(found, a, b, by, by, passes.part_tail, "forced-part-tail-fill-v1", "forced-part-tail-fill-progressive")
