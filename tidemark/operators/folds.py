"""Ordered folds that windows can't express: state depends on the last row that was kept, or on a table.

Rows are dealt by key, sorted within tasks and folded as Arrow batches pass, so that a task holds one batch and one small
state, never a group. Keys are cut further where the state starts anew. Only the programs over tables (highlights of one
media file, clips of one title) take a group whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import cleaning
from tidemark.storage import dealt

By = list[str]


def ordered_fold(df: DataFrame, keys: By, order: By, columns: By, start: Callable[[], object], step: Callable, name: str, kind: str = "long") -> DataFrame:
    """Adds ``name``: what ``step(state, *values of columns)`` -> (state, result) gives row after row of each key, in order."""
    arrow = {"long": pa.int64(), "boolean": pa.bool_()}[kind]

    def run(batches):
        key, state = object(), None
        for batch in batches:
            at = batch.schema.names.index
            ks = list(zip(*(batch.column(at(k)).to_pylist() for k in keys), strict=True))
            made = []
            for k, *values in zip(ks, *(batch.column(at(c)).to_pylist() for c in columns), strict=True):
                if k != key:
                    key, state = k, start()
                state, x = step(state, *values)
                made.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], [*batch.schema.names, name])

    return dealt(df, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{_ddl(df)}, {name} {kind}")


def _pieces(df: DataFrame, by: By, order: By, fresh: Column) -> DataFrame:
    """Adds ``_piece``: stretches of a group that begin where ``fresh`` holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("_piece", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def near_duplicate_drop(df: DataFrame, by: By, tolerance: int) -> DataFrame:
    """Drops segments whose start, end and text are those of the last kept one, times within ``tolerance``; ordered by
    start, end and text. A start further than that from the row before begins a piece of its own."""
    order = ["s", "e", "text", "seg_id"]
    rows = _pieces(df, by, order, F.col("s") - F.lag("s").over(Window.partitionBy(*by).orderBy(*order)) > tolerance)

    def step(last, s, e, text):
        same = last is not None and abs(s - last[0]) <= tolerance and abs(e - last[1]) <= tolerance and text == last[2]
        return (last, False) if same else ((s, e, text), True)

    kept = ordered_fold(rows, [*by, "_piece"], order, ["s", "e", "text"], lambda: None, step, "_keep", "boolean")
    return kept.where("_keep").select(df.columns)


def pack_units(df: DataFrame, by: By, gap: int, span: int, chars: int, cut_gap: int | None = None) -> DataFrame:
    """Numbers units: rows join the open unit while the gap, the span and the characters stay in bounds; with ``cut_gap``
    also the gap on the cut timeline (cut_s, cut_e). A gap that is too large begins a piece of its own."""
    order = ["s", "e", "seg_id"]
    w = Window.partitionBy(*by).orderBy(*order)
    apart = F.col("s") - F.lag("e").over(w) > gap
    if cut_gap is not None:
        apart = apart | (F.col("cut_s") - F.lag("cut_e").over(w) > cut_gap)
    rows = _pieces(df, by, order, apart).withColumn("_size", F.coalesce(F.length("text"), F.lit(0)))

    def step(state, s, e, n):
        unit, first, size = state
        if unit < 0 or e - first > span or size + n > chars:
            unit, first, size = unit + 1, s, 0
        return (unit, first, size + n), unit

    made = ordered_fold(rows, [*by, "_piece"], order, ["s", "e", "_size"], lambda: (-1, 0, 0), step, "_unit")
    number = F.dense_rank().over(Window.partitionBy(*by).orderBy("_piece", "_unit")) - 1
    return made.withColumn("unit", number.cast("long")).select(*df.columns, "unit")


def pack_requests(df: DataFrame, by: By, max_rows: int, budget: int, base: int = 0, each: int = 0) -> DataFrame:
    """Numbers requests: rows (pos, size) in order, at most ``max_rows`` and ``budget`` characters each; larger rows stand
    alone. ``base`` and ``each``: what a serialised request and each of its rows add to the sizes."""

    def step(state, n):
        request, rows, size = state
        if request < 0 or rows >= max_rows or size + n + each > budget:
            request, rows, size = request + 1, 0, base
        return (request, rows + 1, size + n + each), request

    return ordered_fold(df, by, ["pos"], ["size"], lambda: (-1, 0, base), step, "request")


#: How long a comment holds its lane, in microseconds, and the pool that its mode takes (fixed values).
SCROLL, FIXED = 12_000_000, 4_200_000
POOL_OF_MODE = {4: "bottom", 5: "top"}


def lane_counts(font_size: int, upper_half: bool = False, embedded: bool = False, height: int = 1080) -> dict[str, int]:
    """Lanes of each pool by the height that is left for comments."""
    line = max(font_size + 6, 18)
    reserved = max(font_size * 2 + 40, 140) if embedded else 48
    bottom = max(36 + line * 4, height // 2 if upper_half else height - reserved)
    scroll = max(8, max(line * 4, bottom - 36) // line)
    fixed = max(4, min(10, scroll // 4))
    return {"scroll": scroll, "top": fixed, "bottom": fixed}


def allocate_lanes(df: DataFrame, by: By, lanes: dict[str, int], scroll: int = SCROLL, fixed: int = FIXED) -> DataFrame:
    """Adds pool and lane: of its mode's pool the first lane that is free at a comment's time, else the one free earliest.

    A comment that starts when all lanes of its pool are free again begins a piece of its own.
    """
    pool = F.coalesce(*(F.when(F.col("mode") == m, F.lit(p)) for m, p in POOL_OF_MODE.items()), F.lit("scroll"))
    rows = df.withColumn("pool", pool).withColumn("_hold", F.when(F.col("pool") == "scroll", F.lit(scroll)).otherwise(F.lit(fixed)))
    rows = rows.withColumn("_lanes", F.coalesce(*(F.when(F.col("pool") == p, F.lit(n)) for p, n in lanes.items())))
    w = Window.partitionBy(*by, "pool").orderBy("at", "pos")
    rows = _pieces(rows, [*by, "pool"], ["at", "pos"], F.col("at") - F.lag("at").over(w) >= F.col("_hold"))

    def step(free, at, hold, n):
        free = free or [at] * n
        lane = next((i for i, t in enumerate(free) if t <= at), None)
        lane = min(range(n), key=free.__getitem__) if lane is None else lane
        free[lane] = at + hold
        return free, lane

    made = ordered_fold(rows, [*by, "pool", "_piece"], ["at", "pos"], ["at", "_hold", "_lanes"], list, step, "lane")
    return made.select(*df.columns, "pool", "lane")


def merge_frames(df: DataFrame, by: By, interval: int, similarity: float, max_gap: int, min_duration: int) -> DataFrame:
    """Cues from recognised frames (frame, t, text, conf): similar texts go on, up to ``max_gap`` blank frames are bridged.

    A longer text replaces the cue's only if it is nearly the same (.92). Cues last ``min_duration`` at least, and
    neighbours within a frame that are similar become one. A longer run of blank frames begins a piece of its own.
    """
    rows = dealt(df, *by).withColumn("text", T.normalize_text(F.coalesce("text", F.lit(""))))
    blank = F.col("text") == ""
    w = Window.partitionBy(*by).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum(F.when(blank, 0).otherwise(1)).over(w)).withColumn("_blank", F.when(blank, F.row_number().over(Window.partitionBy(*by, "_run", blank).orderBy("frame"))).otherwise(0))
    rows = rows.withColumn("_piece", F.sum(F.when(F.col("_blank") == max_gap + 1, 1).otherwise(0)).over(w)).where(~blank)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame", kind="stable")
        cues: list[list] = []  # start, last, text, sum, count
        for t, text, conf in zip(pdf["t"], pdf["text"], pdf["conf"], strict=True):
            if cues and cleaning.reaches(cues[-1][2], text, similarity):
                now = cues[-1]
                now[1], now[3], now[4] = t, now[3] + conf, now[4] + 1
                if len(text) > len(now[2]) and cleaning.reaches(now[2], text, 0.92):
                    now[2] = text
            else:
                cues.append([t, t, text, conf, 1])
        keys = [pdf[k].iloc[0] for k in by]
        return pd.DataFrame([[*keys, s, max(s + min_duration, last + interval), text, total / n] for s, last, text, total, n in cues], columns=[*by, "s", "e", "text", "conf"])

    kinds = dict(df.dtypes)
    cues = rows.groupBy(*by, "_piece").applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", s long, e long, text string, conf double")
    return cleaning.merge_adjacent(cues, by, similarity, interval)


def highlight_top(df: DataFrame, by: By, top_n: int, max_windows: int, neighbour: float = 0.5, stop_at_used: bool = True) -> DataFrame:
    """Greedy highlights from the scores of all windows (w, score): the best windows grow over unused neighbours of at
    least half their score, unless they get longer than ``max_windows``.

    The search ends at the first window that is used already as long as ``stop_at_used``; otherwise such windows are
    passed over. Highlights are ranked by the mean score of their windows, rounded to one digit, then as found.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        score = dict(zip(pdf["w"].tolist(), pdf["score"].tolist(), strict=True))
        used: set[int] = set()
        found: list[tuple[float, int, int]] = []
        for w in sorted(score, key=lambda x: (-score[x], x)):
            if len(found) >= top_n or w in used and stop_at_used:
                break
            if w in used:
                continue
            ends = []
            for by_one in (-1, 1):
                at = w
                while at + by_one in score and at + by_one not in used and score[at + by_one] >= neighbour * score[w]:
                    at += by_one
                ends.append(at)
            lo, hi = ends if ends[1] - ends[0] < max_windows else (w, w)
            used.update(range(lo, hi + 1))
            found.append((round(float(np.mean([score[x] for x in range(lo, hi + 1)])), 1), lo, hi))
        found.sort(key=lambda x: -x[0])
        keys = [pdf[k].iloc[0] for k in by]
        return pd.DataFrame([[*keys, i + 1, lo, hi, s] for i, (s, lo, hi) in enumerate(found)], columns=[*by, "rank", "first", "last", "score"])

    kinds = dict(df.dtypes)
    return df.groupBy(*by).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", rank long, first long, last long, score double")


def cheapest_cuts(before: np.ndarray, ends: np.ndarray, target: float, scale: float, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """For each end j the least ``before[i] + weight * ((ends[j] - ends[i] - target) / scale) ** 2`` over i < j, and its first i."""
    n = len(ends) - 1
    same = lambda x: np.full(n + 1, x)
    return _cheapest(before, ends, same(target), same(scale), weight, *(np.array([x]) for x in (1, n, 0, n - 1)))


def _cheapest(before: np.ndarray, ends: np.ndarray, target: np.ndarray, scale: np.ndarray, weight: float, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``cheapest_cuts`` of the stretches of ends from ``low`` to ``high`` with cuts from ``first`` to ``last``, all at once.

    The squares make the best cut move forward only as the end does, so ends are taken in halves: the middle one's cut
    bounds those on both sides. All middles of a level are tried at once; a level costs the ends' number, and there are
    log n levels.
    """
    best, cut = np.full(len(ends), np.inf), np.zeros(len(ends), np.int64)
    while len(low):
        middle = (low + high) // 2
        stop = np.minimum(last, middle - 1)
        sizes = stop - first + 1
        starts = np.cumsum(sizes) - sizes
        i = np.arange(sizes.sum()) - np.repeat(starts - first, sizes)
        cost = before[i] + weight * ((np.repeat(ends[middle], sizes) - ends[i] - np.repeat(target[middle], sizes)) / np.repeat(scale[middle], sizes)) ** 2
        least = np.minimum.reduceat(cost, starts)
        hits = np.flatnonzero(cost == np.repeat(least, sizes))
        found = i[hits[np.searchsorted(hits, starts)]]
        best[middle], cut[middle] = least, found
        left, right = low < middle, middle < high
        low, high, first, last = (np.concatenate(x) for x in ((low[left], middle[right] + 1), (middle[left] - 1, high[right]), (first[left], found[right]), (found[left], last[right])))
    return best, cut


def _whole_keys(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by ``key`` as tables that cut no key's rows in two: about a batch each, or a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(key).dictionary_encode("encode").indices.to_numpy()
        at = int(np.flatnonzero(codes != codes[-1])[-1]) + 1 if (codes != codes[-1]).any() else 0
        goes_on = at == 0 and held and len(pa.concat_arrays([held[-1].column(key)[-1:], batch.column(key)[:1]]).unique()) == 1
        if held and not goes_on:
            yield pa.Table.from_batches([*held, batch[:at]])
            held = []
        elif at:
            yield pa.Table.from_batches([batch[:at]])
        held.append(batch[at:])
    if held:
        yield pa.Table.from_batches(held)


def _dealt_parts(sizes: np.ndarray, dur: np.ndarray, targets: list | None, parts: int, weight: float) -> np.ndarray:
    """The part of each clip of titles that follow each other with ``sizes`` clips; all titles' cuts are looked for at once."""
    titles, begin = np.arange(len(sizes)), np.cumsum(sizes) - sizes
    off = begin + titles  # a title of n clips has n + 1 ends
    ends = np.zeros(len(dur) + len(sizes))
    for n in np.unique(sizes):
        some = sizes == n
        ends[off[some][:, None] + np.arange(1, n + 1)] = np.cumsum(dur[begin[some][:, None] + np.arange(n)], axis=1)
    if not np.isfinite(ends).all():
        raise ValueError("clips need finite durations")
    k = np.minimum(parts, sizes)
    before = np.full(len(ends), np.inf)
    before[off] = 0.0
    cuts = []
    for p in range(k.max()):
        t = np.flatnonzero(k > p)
        want = ends[off + sizes] / k if targets is None else np.array([float(x[p]) if i > p else 0.0 for x, i in zip(targets, k, strict=True)])
        want = np.repeat(want, sizes + 1)
        # the part takes a clip at least, and leaves one for each before it: ends from p + 1, cuts from p
        before, cut = _cheapest(before, ends, want, np.maximum(want, 1.0), weight, off[t] + p + 1, off[t] + sizes[t], off[t] + p, off[t] + sizes[t] - 1)
        cuts.append(cut)
    part, j = np.zeros(len(dur), np.int64), off + sizes
    for p in range(len(cuts) - 1, -1, -1):
        t = np.flatnonzero(k > p)
        i = cuts[p][j[t]]
        n = j[t] - i
        part[np.arange(n.sum()) + np.repeat(i - t - (np.cumsum(n) - n), n)] = p + 1
        j[t] = i
    return part


def _every_cut(before: np.ndarray, ends: np.ndarray, fits: np.ndarray, target: float, scale: float, weight: float, semantic: float) -> tuple[np.ndarray, np.ndarray]:
    """The same with the mean of the clips' scores taken off; their means keep no order, so every cut is tried."""
    n = len(ends) - 1
    best, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    for j in range(1, n + 1):
        i = np.arange(j)
        c = before[i] + weight * ((ends[j] - ends[i] - target) / scale) ** 2 - semantic * (fits[j] - fits[i]) / (j - i)
        cut[j] = int(c.argmin())
        best[j] = c[cut[j]]
    return best, cut


def partition_clips(clips: DataFrame, parts: int, weight: float = 1.0, semantic: float = 0.0, strict: bool = False) -> DataFrame:
    """Contiguous assignment of a title's clips (pos, dur) to ``parts`` ordered parts of least cost, the earliest cut on ties.

    A part costs ``weight`` times its squared relative error of duration (a target under 1 counts as 1 in what the error is
    divided by), less ``semantic`` times the mean score of its clips for it. Columns of arrays, the same in all rows of a
    title, if there are any: ``targets`` (duration of each part, else even shares), and ``fits`` (a clip's score for each
    part). One row a clip. Fewer clips than parts use as many parts as there are clips; with ``strict`` they can't be dealt, and their part is null.

    Without scores n clips cost n log n for each part and a title's cuts are all that is held; titles are taken as they come in
    batches, many at once (``_dealt_parts``).
    """
    has_fits, has_targets = "fits" in clips.columns and bool(semantic), "targets" in clips.columns

    def titles(batches):
        for rows in _whole_keys(batches, "title"):
            codes = rows.column("title").combine_chunks().dictionary_encode("encode").indices.to_numpy()
            begin = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            sizes = np.diff(np.append(begin, len(codes)))
            dur = rows.column("_dur").to_numpy().astype(float)
            part = _dealt_parts(sizes, dur, rows.column("targets").take(pa.array(begin)).to_pylist() if has_targets else None, parts, weight)
            few = np.repeat(sizes < parts, sizes) if strict else np.zeros(len(part), bool)
            yield from rows.drop_columns(["_dur"]).append_column("part", pa.array(part, mask=few)).to_batches()

    if not has_fits:
        rows = clips.withColumn("_dur", F.col("dur").cast("double")).transform(dealt, "title").sortWithinPartitions("title", "pos")
        return rows.mapInArrow(titles, f"{_ddl(clips)}, part long")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").copy()
        ends = np.concatenate(([0.0], np.cumsum(pdf["dur"])))
        n, k = len(pdf), min(parts, len(pdf))
        if strict and n < parts:
            pdf["part"] = pd.array([None] * n, "Int64")
            return pdf
        want = np.asarray(pdf["targets"].iloc[0], float)[:k] if has_targets else np.full(k, ends[-1] / k)
        fits = np.vstack((np.zeros(k), np.cumsum([list(x)[:k] for x in pdf["fits"]], axis=0)))
        before = np.concatenate(([0.0], np.full(n, np.inf)))
        cuts = []
        for p in range(k):
            scale = max(want[p], 1.0)
            # the part takes a clip at least, and leaves one for each before it: ends from p + 1, cuts from p
            own = before[p:], ends[p:]
            best, cut = _every_cut(*own, fits[p:, p], want[p], scale, weight, semantic)
            before = np.concatenate((np.full(p, np.inf), best))
            cuts.append(np.concatenate((np.zeros(p, np.int64), cut + p)))
        part, j = np.zeros(n, np.int64), n
        for p in range(k - 1, -1, -1):
            part[cuts[p][j] : j] = p + 1
            j = cuts[p][j]
        pdf["part"] = pd.array(part, "Int64")
        return pdf

    return clips.groupBy("title").applyInPandas(run, f"{_ddl(clips)}, part long")


#: Vectors of a block; two blocks meet in one matrix product.
VECTORS = 2048
#: Queries whose scores against a block are held at once.
QUERIES = 128


def _blocks(df: DataFrame, key: str, name: str) -> DataFrame:
    """Blocks of about VECTORS rows (key, vector), dealt by a hash of the key, each as one array."""
    parts = max(1, -(-df.count() // VECTORS))
    rows = df.select(F.struct(F.col(key).alias("id"), "vector").alias("x"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("_b"))
    return rows.groupBy("_b").agg(F.collect_list("x").alias(name)).drop("_b")


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of ``corpus`` (c_id, vector) for each of ``queries`` (q_id, vector); unit vectors.

    A stated query set meets all rows of the corpus, block by block: a task multiplies two blocks and sends on the best
    ``k`` of each query only, rounded scores first, then smaller ids. Ids are numbers.
    """

    def nearest(batches):
        for batch in batches:
            for q, c in zip(*batch.columns, strict=True):
                one, two = q.values, c.values
                vectors = [x.field("vector").flatten().to_numpy().astype(np.float64).reshape(len(x), -1) for x in (one, two)]
                ids = two.field("id").to_numpy()
                order = np.argsort(ids, kind="stable")
                sorted_ids, others = ids[order], vectors[1][order].T
                for lo in range(0, len(one), QUERIES):
                    score = np.round(vectors[0][lo : lo + QUERIES] @ others, 6)
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    row = np.repeat(np.arange(len(score)), best.shape[1])
                    yield pa.RecordBatch.from_arrays([one.field("id").take(pa.array(row + lo)), pa.array(sorted_ids[best.ravel()]), pa.array(score[row, best.ravel()])], ["q_id", "c_id", "score"])

    kinds = dict(queries.dtypes)["q_id"], dict(corpus.dtypes)["c_id"]
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = _blocks(queries, "q_id", "q").join(_blocks(corpus, "c_id", "c").repartition(tasks), F.lit(True))  # blocks are dealt before they meet
    found = pairs.mapInArrow(nearest, f"q_id {kinds[0]}, c_id {kinds[1]}, score double")
    w = Window.partitionBy("q_id").orderBy(F.col("score").desc(), "c_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
