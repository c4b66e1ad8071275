"""Trial alignments: clips against the windows of a part in which they may lie, and what to believe where windows overlap.

Three makers give windows (by, clip, ws, we, in seconds of the part; a clip may have several): clips laid end to end, original
stretches carried over to the cut timeline, and stretches around anchors. ``trial_align`` aligns each clip with the
cues of its windows by groups; ``reconciled`` chooses among the results of all windows those that don't overlap and
score most together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import align, intervals
from tidemark.storage import dealt, large

By = list[str]


def end_to_end(b: DataFrame, by: By) -> DataFrame:
    """Windows of clips laid one after the other: each as long as from its first cue's start to its last cue's end.

    b: by, clip, ord (order of clips in the part), pos, s, e. Clips without cues take no room.
    """
    spans = b.groupBy(*by, "clip", "ord").agg((F.max_by("e", "pos") - F.min_by("s", "pos")).alias("length"))
    before = Window.partitionBy(*by).orderBy("ord", "clip").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("ws", F.coalesce(F.sum("length").over(before), F.lit(0.0)))
    return spans.select(*by, "clip", "ws", (F.col("ws") + F.col("length")).alias("we"))


def carried(candidates: DataFrame, cuts: DataFrame, by: By, width: float) -> DataFrame:
    """Windows of each clip's best candidate stretch (by, clip, score, pos, qs, qe; the first by pos on ties) on the cut
    timeline: one for each kept interval (cuts: by, s, e, cut_start) that the stretch touches; none if it touches none.

    ``width``: the slots, in the unit of the times, in which stretches and intervals meet.
    """
    first = Window.partitionBy(*by, "clip").orderBy(F.col("score").desc(), "pos")
    best = candidates.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*by, "clip", "qs", "qe")
    return intervals.range_to_cut(best, cuts, by, width).select(*by, "clip", F.col("part_start").alias("ws"), F.col("part_end").alias("we"))


def around_anchors(pairs: DataFrame, by: By, gap: float) -> DataFrame:
    """Windows around the anchors (by, clip, s, e) of each clip: one for each run of anchors that start at most ``gap``
    after the furthest end before them."""
    order = Window.partitionBy(*by, "clip").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = pairs.withColumn("_new", F.when(before.isNull() | (F.col("s") > before + gap), 1).otherwise(0))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "clip", "_run").agg(F.min("s").alias("ws"), F.max("e").alias("we")).drop("_run")


def in_windows(a: DataFrame, windows: DataFrame, by: By, flank: float, width: float = 600.0) -> DataFrame:
    """The cues of a that start in a window or at most ``flank`` from it, once for each clip: a's columns and clip.

    Windows are dealt to slots of ``width`` and cues meet them in the slot of their start, so a long part is spread over tasks.
    """
    lo, hi = F.col("ws") - flank, F.col("we") + flank
    slots = windows.withColumn("_slot", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    hits = a.select(*by, "pos", "s").withColumn("_slot", F.floor(F.col("s") / width)).join(large(slots.select(*by, "clip", "_slot", lo.alias("_lo"), hi.alias("_hi"))), [*by, "_slot"])
    hits = hits.where((F.col("s") >= F.col("_lo")) & (F.col("s") <= F.col("_hi"))).select(*by, "clip", "pos").distinct()
    return a.join(large(hits), [*by, "pos"])


def trial_align(a: DataFrame, b: DataFrame, windows: DataFrame, by: By, flank: float = 12.0, least: float = 0.0, largest: int = 3, match: float = 0.60, output: float = 0.68, skip_a: float = 0.08, skip_b: float = 0.05, width: float = 600.0) -> DataFrame:
    """Each clip aligned by groups with the cues of its windows: by, clip, a_pos, b_pos (arrays), alignment, score, s, e.

    a: by, pos, s, e, vector; b: the same, clip and confidence, of which ``least`` is asked. A clip without windows, or windows
    without cues, give nothing. Cues lie in the windows of several clips, so results of different clips may overlap.
    """
    near = in_windows(a, windows, by, flank, width)
    side = lambda rows, x: rows.select(*by, "clip", F.lit(x).alias("side"), "pos", "s", "e", "vector")
    found = align.group_align(side(near, "a").unionByName(side(b.where(F.col("confidence") >= least), "b")), [*by, "clip"], largest, largest, match, output, skip_a, skip_b)
    times = found.select(*by, "clip", "a_pos", F.explode("a_pos").alias("pos")).join(large(a.select(*by, "pos", "s", "e")), [*by, "pos"])
    times = times.groupBy(*by, "clip", "a_pos").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return found.join(large(times), [*by, "clip", "a_pos"]).withColumn("score", F.round("score", 4))


def summary(windows: DataFrame, near: DataFrame, found: DataFrame, by: By) -> DataFrame:
    """A row for each clip with windows: their number, first start and last end, cues in them, results, their mean score."""
    key = [*by, "clip"]
    out = windows.groupBy(*key).agg(F.count(F.lit(1)).alias("windows"), F.round(F.min("ws"), 3).alias("window_start"), F.round(F.max("we"), 3).alias("window_end"))
    out = out.join(large(near.groupBy(*key).agg(F.count(F.lit(1)).alias("cues"))), key, "left").join(large(found.groupBy(*key).agg(F.count(F.lit(1)).alias("results"), F.round(F.avg("score"), 4).alias("mean_score"))), key, "left")
    return out.fillna(0, ["cues", "results"])


def deduped(found: DataFrame, by: By) -> DataFrame:
    """Results with the same cues on both sides once: the first by start and end."""
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    w = Window.partitionBy(*by, ids(F.col("a_pos")), ids(F.col("b_pos"))).orderBy("s", "e", "clip")
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def heaviest(start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> list[int]:
    """Indices of the intervals, ordered by end, that don't overlap and weigh most; touching ends don't overlap. On ties
    an interval is left out."""
    before = np.searchsorted(end, start, "right")  # how many end at or before each start
    best = [0.0]
    for i, w in enumerate(weight.tolist()):
        best.append(max(best[i], best[min(before[i], i)] + w))
    out, i = [], len(weight)
    while i:
        if best[i] > best[i - 1]:
            out.append(i - 1)
            i = min(before[i - 1], i - 1)
        else:
            i -= 1
    return out[::-1]


def reconciled(found: DataFrame, by: By, weight: str = "score") -> DataFrame:
    """Of all results (by, s, e, score) of a part those that don't overlap in time and weigh most together.

    Results are cut into pieces where none reaches over, by the running furthest end, so a choice holds a piece in memory and
    not a part. Longer results count by their weight alone. Results without length, and with no positive weight, are left out.
    """
    order = Window.partitionBy(*by).orderBy("s", "e")
    furthest = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.where((F.col("s") < F.col("e")) & (F.col(weight) > 0)).withColumn("_new", F.when(furthest.isNull() | (F.col("s") >= furthest), 1).otherwise(0))
    rows = rows.withColumn("_piece", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    columns, kinds = found.columns, ", ".join(f"`{n}` {t}" for n, t in found.dtypes)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["e", "s", weight], ascending=[True, True, False], kind="stable")
        return pdf.iloc[heaviest(pdf.s.to_numpy(), pdf.e.to_numpy(), pdf[weight].to_numpy(float))][columns]

    single = F.count(F.lit(1)).over(Window.partitionBy(*by, "_piece"))
    rows = rows.withColumn("_size", single)
    alone = rows.where("_size = 1").select(columns)  # most pieces need no choice
    return alone.unionByName(dealt(rows.where("_size > 1"), *by, "_piece").groupBy(*by, "_piece").applyInPandas(choose, kinds))
