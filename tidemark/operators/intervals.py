"""Interval algebra on (by..., start, end) rows; times are integers (microseconds), so that all results are exact.

Each function takes and returns DataFrames. Windows are always partitioned by the group columns; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

By = list[str]

#: Presets of ``merge_intervals`` in microseconds: gap, and whether empty intervals are dropped first.
PRESETS = {"render": (20_000, True), "touch": (0, True), "report": (0, False), "vad": (3_500_100, False)}


def islands(df: DataFrame, by: By, start: str, end: str, gap: int = 0, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``island``: a row starts a new one if it begins more than ``gap`` after all earlier ends of its group."""
    w = Window.partitionBy(*by).orderBy(start, end, *order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    return df.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def merge_intervals(df: DataFrame, by: By, start: str = "s", end: str = "e", gap: int = 0, drop_empty: bool = True) -> DataFrame:
    """Unions of intervals that overlap or lie within ``gap``; one row for each, with the number of members."""
    rows = df.where(F.col(end) > F.col(start)) if drop_empty else df
    return islands(rows, by, start, end, gap).groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("members")).drop("island")


def invert_intervals(merged: DataFrame, totals: DataFrame, by: By, start: str = "s", end: str = "e", total: str = "total", min_gap: int = 0) -> DataFrame:
    """The stretches of [0, total] that merged intervals leave free, of at least ``min_gap``."""
    tail = totals.select(*by, F.col(total).alias(start), F.col(total).alias(end))
    w = Window.partitionBy(*by).orderBy(start, end)
    rows = merged.select(*by, start, end).unionByName(tail).withColumn("_from", F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.where((F.col(start) > F.col("_from")) & (F.col(start) - F.col("_from") >= min_gap)).select(*by, F.col("_from").alias("gap_start"), F.col(start).alias("gap_end"))


def coverage_report(merged: DataFrame, totals: DataFrame, by: By, min_gap: int = 0) -> DataFrame:
    """Per group: covered time, its share in basis points, gaps, and the largest gap (the first on ties)."""
    covered = merged.groupBy(*by).agg(F.sum(F.col("e") - F.col("s")).alias("covered"))
    gaps = invert_intervals(merged, totals, by, min_gap=min_gap)
    best = gaps.groupBy(*by).agg(F.count(F.lit(1)).alias("gap_count"), F.max(F.struct((F.col("gap_end") - F.col("gap_start")).alias("d"), (-F.col("gap_start")).alias("at"))).alias("_g"))
    out = totals.join(covered, by, "left").join(best, by, "left")
    return out.select(*by, "total", F.coalesce("covered", F.lit(0)).alias("covered"), F.expr("coalesce(covered, 0) * 10000 div greatest(total, 1)").alias("covered_bp"), F.coalesce("gap_count", F.lit(0)).alias("gap_count"), F.coalesce((-F.col("_g.at")), F.lit(-1)).alias("largest_gap_start"), F.coalesce(F.col("_g.d"), F.lit(0)).alias("largest_gap"))


def resolve_actions(actions: DataFrame, by: By, policy: str = "exclude_wins", order: str = "pos") -> DataFrame:
    """One action for each key: any Exclude before any Keep before Uncertain, or the last by ``order``."""
    if policy == "exclude_wins":
        any_of = lambda a: F.bool_or(F.col("action") == a)
        return actions.groupBy(*by).agg(F.when(any_of("Exclude"), "Exclude").when(any_of("Keep"), "Keep").otherwise("Uncertain").alias("action"))
    return actions.groupBy(*by).agg(F.max_by("action", order).alias("action"))


def keep_intervals(segments: DataFrame, actions: DataFrame, by: By, key: str, policy: str = "exclude_wins", gap: int = 20_000) -> DataFrame:
    """Merged intervals of the segments whose resolved action is Keep; an action on an unknown segment is an error."""
    known = segments.select(key).distinct().withColumn("_known", F.lit(True))
    resolved = resolve_actions(actions, [key], policy).join(known, key, "left")
    unknown = F.raise_error(F.concat(F.lit("unknown segment "), F.col(key).cast("string")))
    resolved = resolved.withColumn("action", F.when(F.col("_known").isNull(), unknown).otherwise(F.col("action")))  # the filter below needs it
    kept = segments.join(resolved.where("action = 'Keep'").select(key), key, "left_semi")
    return merge_intervals(kept, by, gap=gap)


def annotate_cut(kept: DataFrame, by: By) -> DataFrame:
    """Adds where each kept interval lies on the timeline of kept intervals only: cut_start, cut_end."""
    w = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("e") - F.col("s")).over(w), F.lit(0))
    return kept.withColumn("cut_start", before).withColumn("cut_end", before + F.col("e") - F.col("s"))


def overlap_join(a: DataFrame, b: DataFrame, by: By, width: int, left: tuple[str, str] = ("s", "e"), right: tuple[str, str] = ("s2", "e2")) -> DataFrame:
    """Pairs of overlapping intervals of a group. Both sides are dealt to time slots of ``width`` and meet in the slot
    in which the overlap begins, so that a long group is spread over tasks and each pair is found once."""
    slot = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e) - 1, F.col(s))) / width)))
    x, y = a.withColumn("_slot", slot(*left)), b.withColumn("_slot", slot(*right))
    lo = F.greatest(F.col(left[0]), F.col(right[0]))
    return x.join(y, [*by, "_slot"]).where((lo < F.least(F.col(left[1]), F.col(right[1]))) & (F.floor(lo / width) == F.col("_slot"))).drop("_slot")


def range_to_cut(queries: DataFrame, cuts: DataFrame, by: By, width: int) -> DataFrame:
    """Parts of original ranges (qs, qe) that kept intervals hold, on the cut timeline."""
    pairs = overlap_join(queries, cuts, by, width, ("qs", "qe"), ("s", "e"))
    lo, hi = F.greatest("qs", "s"), F.least("qe", "e")
    return pairs.withColumn("part_start", F.col("cut_start") + lo - F.col("s")).withColumn("part_end", F.col("cut_start") + hi - F.col("s"))


def point_to_cut(points: DataFrame, cuts: DataFrame, by: By, at: str) -> DataFrame:
    """Points on the cut timeline: of the interval that holds them (its end included), else null. By an as-of window."""
    marks = cuts.select(*by, F.col("s").alias("_t"), F.lit(0).alias("_k"), F.struct("s", "e", "cut_start").alias("_c"))
    rows = points.withColumn("_t", F.col(at)).withColumn("_k", F.lit(1))
    w = Window.partitionBy(*by).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.unionByName(marks, allowMissingColumns=True).withColumn("_in", F.last("_c", ignorenulls=True).over(w)).where("_k = 1")
    cut = F.when(F.col(at) <= F.col("_in.e"), F.col("_in.cut_start") + F.col(at) - F.col("_in.s"))
    return rows.withColumn("cut_at", cut).drop("_t", "_k", "_c", "_in")


def assign_by_midpoint(cues: DataFrame, ranges: DataFrame, by: By, tail: int = 1_000, fallback_last: bool = True) -> DataFrame:
    """The range (half-open, ordered, disjoint) in which each cue's midpoint falls, by an as-of window.

    The last range of a group holds its end too, and ``tail`` more. What falls in none gets the last range, or null
    without ``fallback_last``.
    """
    mid = F.expr("(s + e) div 2")
    order = Window.partitionBy(*by).orderBy("rs", "range_id")
    last = F.lead("rs").over(order).isNull().alias("last")
    marks = ranges.select(*by, F.col("rs").alias("_t"), F.lit(0).alias("_k"), F.struct("range_id", "re", last).alias("_r"))
    rows = cues.withColumn("_t", mid).withColumn("_k", F.lit(1))
    w = Window.partitionBy(*by).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    final = F.max(F.when(F.col("_r.last"), F.col("_r.range_id"))).over(whole)
    rows = rows.unionByName(marks, allowMissingColumns=True).withColumn("_in", F.last("_r", ignorenulls=True).over(w)).withColumn("_final", final).where("_k = 1")
    inside = (F.col("_t") < F.col("_in.re")) | (F.col("_in.last") & (F.col("_t") <= F.col("_in.re") + tail))
    found = F.when(inside, F.col("_in.range_id"))
    return rows.withColumn("range_id", F.coalesce(found, "_final") if fallback_last else found).drop("_t", "_k", "_r", "_in", "_final")


def cut_to_point(points: DataFrame, cuts: DataFrame, by: By, at: str, empty_holds: bool = False) -> DataFrame:
    """Points of the cut timeline on the original one: in the kept interval that holds them, or clamped to the nearest end.

    An empty interval begins on the cut timeline where the next one does: of the two the later holds the point, or with
    ``empty_holds`` the earlier."""
    marks = cuts.select(*by, F.col("cut_start").alias("_t"), F.lit(0).alias("_k"), F.struct("s", "e", "cut_start").alias("_c"))
    rows = points.withColumn("_t", F.col(at)).withColumn("_k", F.lit(1))
    w = Window.partitionBy(*by).orderBy("_t", "_k", F.col("_c.s").desc() if empty_holds else F.col("_c.s"))
    rows = rows.unionByName(marks, allowMissingColumns=True).withColumn("_in", F.last("_c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_first", F.min("_c.s").over(w.rowsBetween(0, Window.unboundedFollowing))).where("_k = 1")
    inside = F.least(F.col("_in.s") + F.col(at) - F.col("_in.cut_start"), F.col("_in.e"))
    return rows.withColumn("original_at", F.coalesce(inside, F.col("_first"))).drop("_t", "_k", "_c", "_in", "_first")


def highlight_scores(cuts: DataFrame, volumes: DataFrame, marks: DataFrame, totals: DataFrame, by: By, width: int) -> DataFrame:
    """Scene and volume shares (0 to 1) of every window of each media file that has a cut at all, and whether it is marked.

    cuts: t; volumes: t, level; marks: w; totals: total. Scenes count per second of the window, against the file's most;
    volume is the mean of the window's levels between the file's least and largest, the least where there is none.
    """
    spine = totals.where("total > 0").withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {width}"))))
    n = cuts.groupBy(*by, F.expr(f"t div {width}").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    heard = volumes.where(F.col("level") > float("-inf")).groupBy(*by, F.expr(f"t div {width}").alias("w")).agg(F.avg("level").alias("v"), F.min("level").alias("lo"), F.max("level").alias("hi"))
    rows = spine.join(n, [*by, "w"], "left").join(heard, [*by, "w"], "left").join(marks.select(*by, "w").distinct().withColumn("marked", F.lit(True)), [*by, "w"], "left")
    g = Window.partitionBy(*by)
    length = F.least(F.col("total") - F.col("w") * width, F.lit(width)) / 1_000_000
    rows = rows.withColumn("_d", F.coalesce("n", F.lit(0)) / F.greatest(length, F.lit(0.01))).withColumn("_m", F.max("_d").over(g)).where("_m > 0")
    lo, hi = F.coalesce(F.min("lo").over(g), F.lit(-60.0)), F.coalesce(F.max("hi").over(g), F.lit(0.0))
    rows = rows.withColumn("scene", F.col("_d") / F.col("_m")).withColumn("volume", (F.coalesce("v", lo) - lo) / F.greatest(hi - lo, F.lit(0.01)))
    return rows.select(*by, "w", "scene", "volume", F.coalesce("marked", F.lit(False)).alias("marked"))


def overlap_exists(a: DataFrame, b: DataFrame, by: By, width: int, flank: int = 0) -> DataFrame:
    """Rows of ``a`` (s, e and unique ``a_id``) that overlap any interval of ``b`` (s2, e2) widened by ``flank``."""
    wide = b.select(*by, (F.col("s2") - flank).alias("s2"), (F.col("e2") + flank).alias("e2"))
    return a.join(overlap_join(a, wide, by, width).select("a_id").distinct(), "a_id", "left_semi")


def overlap_or_nearest(a: DataFrame, b: DataFrame, by: By, max_offset: int, width: int) -> DataFrame:
    """For each cue of ``a`` all cues of ``b`` that overlap it, or else the nearest by centre within ``max_offset``.

    Candidates meet in time slots; ``b``: b_id, s2, e2. Rows without a partner have null b_id and match_type none.
    """
    wide = a.withColumn("_ws", F.least(F.col("s"), F.expr("(s + e) div 2") - max_offset)).withColumn("_we", F.greatest(F.col("e"), F.expr("(s + e) div 2") + max_offset + 1))
    reach = b.withColumn("_bs", F.col("s2")).withColumn("_be", F.greatest("e2", F.col("s2") + 1))
    pairs = overlap_join(wide, reach, by, width, ("_ws", "_we"), ("_bs", "_be"))
    over = F.least("e", "e2") - F.greatest("s", "s2")
    away = F.abs(F.expr("(s + e) div 2") - F.expr("(s2 + e2) div 2"))
    pairs = pairs.withColumn("_over", over > 0).withColumn("away", away).where(F.col("_over") | (F.col("away") <= max_offset))
    w = Window.partitionBy("a_id")
    pairs = pairs.withColumn("_any", F.max("_over").over(w)).withColumn("_rank", F.row_number().over(w.orderBy("away", "b_id")))
    found = pairs.where(F.when(F.col("_any"), F.col("_over")).otherwise(F.col("_rank") == 1)).select("a_id", "b_id", F.when(F.col("_over"), "overlap").otherwise("nearest").alias("match_type"), "away")
    return a.join(found, "a_id", "left").withColumn("match_type", F.coalesce("match_type", F.lit("none")))


def k_nearest_band(a: DataFrame, b: DataFrame, by: By, radius: int, seconds: int) -> DataFrame:
    """Cues of ``b`` at most ``radius`` positions from the first that starts at or after the cue of ``a``, and in time.

    Positions are dense per group, so the position band is an equi-join on exploded positions, not a theta join.
    """
    w = Window.partitionBy(*by).orderBy("s2", "b_id")
    placed = b.withColumn("pos", F.row_number().over(w))
    marks = placed.select(*by, F.col("s2").alias("_t"), F.lit(1).alias("_k"), F.col("pos").alias("_p"))
    rows = a.withColumn("_t", F.col("s")).withColumn("_k", F.lit(0))
    after = Window.partitionBy(*by).orderBy(F.col("_t").desc(), F.col("_k").desc(), F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.unionByName(marks, allowMissingColumns=True).withColumn("centre", F.last("_p", ignorenulls=True).over(after)).where("_k = 0").drop("_t", "_k", "_p")
    near = rows.where("centre is not null").withColumn("pos", F.explode(F.sequence(F.col("centre") - radius, F.col("centre") + radius)))
    return near.join(placed, [*by, "pos"]).where(F.abs(F.col("s") - F.col("s2")) <= seconds)


def auto_segments(cuts: DataFrame, totals: DataFrame, by: By, min_dur: int, max_dur: int) -> DataFrame:
    """Segments between cut points: spans under ``min_dur`` are skipped, others split by ``max_dur`` (tail >= min)."""
    points = cuts.select(*by, "t").unionByName(totals.select(*by, F.lit(0).cast("long").alias("t"))).unionByName(totals.select(*by, F.col("total").alias("t"))).distinct()
    spans = points.withColumn("u", F.lead("t").over(Window.partitionBy(*by).orderBy("t"))).where(F.col("u") - F.col("t") >= min_dur)
    pieces = spans.withColumn("k", F.explode(F.sequence(F.lit(0), F.expr(f"cast((u - t - 1) div {max_dur} as int)"))))
    pieces = pieces.withColumn("seg_start", F.col("t") + F.col("k") * max_dur).withColumn("seg_end", F.least(F.col("u"), F.col("seg_start") + max_dur))
    return pieces.where(F.col("seg_end") - F.col("seg_start") >= min_dur).select(*by, "seg_start", "seg_end")


def chunk_plan(totals: DataFrame, by: By, chunk: int, overlap: int) -> DataFrame:
    """Core windows [k * chunk, (k + 1) * chunk) of each total, with the wider windows to extract."""
    rows = totals.where("total > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.expr(f"cast((total - 1) div {chunk} as int)"))))
    core, stop = F.col("k") * chunk, F.least((F.col("k") + 1) * chunk, F.col("total"))
    rows = rows.withColumn("core_start", core).withColumn("core_end", stop)
    return rows.select(*by, F.col("k").cast("long").alias("k"), "core_start", "core_end", F.greatest(F.col("core_start") - overlap, F.lit(0)).alias("extract_start"), F.least(F.col("core_end") + overlap, F.col("total")).alias("extract_end"), (F.col("core_end") == F.col("total")).alias("is_last"))


def tumbling_volume(samples: DataFrame, by: By, at: str, value: Column, width: int) -> DataFrame:
    """Mean and peak of samples in windows of ``width``; windows without samples are there with nulls."""
    last = samples.groupBy(*by).agg(F.max(at).alias("_last"))
    spine = last.where("_last > 0").withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_last - 1) div {width}")))).drop("_last")
    sums = samples.groupBy(*by, F.expr(f"{at} div {width}").alias("w")).agg(F.count(F.lit(1)).alias("samples"), F.sum(value).alias("total"), F.max(value).alias("peak"))
    return spine.join(sums, [*by, "w"], "left").withColumn("samples", F.coalesce("samples", F.lit(0)))


def mark_windows(df: DataFrame, by: By, width: int) -> DataFrame:
    """Windows that intervals touch, both ends included."""
    return df.select(*by, F.explode(F.sequence(F.expr(f"s div {width}"), F.expr(f"e div {width}"))).alias("w")).distinct()


def vad_tighten(df: DataFrame, by: By, gap: int, end_pad: int, start_bias: int, min_dur: int) -> DataFrame:
    """Voice islands with padded ends; short ones go, the others are numbered anew."""
    merged = merge_intervals(df, by, gap=gap, drop_empty=False)
    tight = merged.withColumn("s", F.expr(f"greatest(((s + {start_bias}) div 1000000) * 1000000, 0)")).withColumn("e", F.col("e") + end_pad).where(F.col("e") - F.col("s") >= min_dur)
    return tight.withColumn("seg_id", F.format_string("seg_%05d", F.row_number().over(Window.partitionBy(*by).orderBy("s", "e"))))


def pair_start_end(log: DataFrame, by: By, order: str) -> DataFrame:
    """Start and end lines of a detector log as intervals: an end closes the last start since the end before it."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = log.withColumn("_after", F.coalesce(F.sum(F.when(F.col("kind") == "end", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("started", F.last(F.when(F.col("kind") == "start", F.col("t")), ignorenulls=True).over(Window.partitionBy(*by, "_after").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("kind = 'end'").withColumn("s", F.greatest(F.coalesce("started", F.col("t") - F.col("dur")), F.lit(0))).withColumn("e", F.col("t")).drop("_after", "started")
