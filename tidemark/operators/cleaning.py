"""Cleaning of recognised cues (by..., s, e, text, conf): filter, merge, drop bridges, collapse dense clusters, audit.

What depends on the last kept row and on text similarity runs as a grouped pandas function on short pieces: a stretch
of cues between two silences that nothing can bridge. All else is windows and column expressions.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import cues as C
from tidemark.functions import text as T
from tidemark.operators.intervals import islands
from tidemark.storage import dealt

By = list[str]
_SIGNS = "。！？!?，,：:"


def similarity(a: str, b: str) -> float:
    """Ratio of matching blocks, in this order of arguments; two empty texts are alike, one isn't like any other."""
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else float(a == b)


def reaches(a: str, b: str, threshold: float) -> bool:
    """Whether the similarity is at least ``threshold``; lengths and common characters, which bound it, are tried first."""
    if not a or not b:
        return float(a == b) >= threshold
    total = len(a) + len(b)
    if 2.0 * min(len(a), len(b)) / total < threshold:
        return False
    matcher = difflib.SequenceMatcher(None, a, b)
    return matcher.quick_ratio() >= threshold and matcher.ratio() >= threshold


def _many_parts(text: str) -> bool:
    return sum(map(text.count, "：:")) >= 2 or sum(map(text.count, "。！?？")) >= 2


def alike(left: str, right: str, threshold: float) -> bool:
    """Equal, or one inside the other unless the longer has several parts, or similar."""
    if left == right:
        return True
    if left in right or right in left:
        return not _many_parts(left if len(left) >= len(right) else right)
    return reaches(left, right, threshold)


def merge_pairs(df: DataFrame, by: By, threshold: float = 0.72, gap: int = 600_000) -> DataFrame:
    """Cues that follow the last kept one within ``gap`` and are like it are merged into it, with the better text.

    Pieces are cut where a cue starts more than ``gap`` after all before it have ended: nothing merges over that.
    """
    scored = islands(dealt(df, *by).withColumn("quality", C.cue_quality(F.col("text"), F.col("conf"), F.col("e") - F.col("s"))), by, "s", "e", gap, ("pos",))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "e", "pos"], kind="stable")
        kept: list[dict] = []
        for row in pdf.to_dict("records"):
            last = kept[-1] if kept else None
            if last and row["s"] - last["e"] <= gap and alike(last["text"], row["text"], threshold):
                if row["quality"] > last["quality"]:
                    last["text"] = row["text"]
                last.update(e=max(last["e"], row["e"]), conf=max(last["conf"], row["conf"]))
                last["quality"] = _requality(last)
            else:
                kept.append(row)
        return pd.DataFrame(kept, columns=list(pdf.columns))

    return scored.groupBy(*by, "island").applyInPandas(run, scored.schema).drop("island", "quality")


def _ratios(bare: str) -> tuple[float, float]:
    zh = sum(0x3400 <= (c := ord(x)) <= 0x4DBF or 0x4E00 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF or 0x20000 <= c <= 0x2EBEF or x in "，。！？：；、“”‘’（）《》【】" for x in bare)
    latin = sum(x.isascii() and (x.isalpha() or x in ".,!?;:'\"-()") for x in bare)
    return (zh / len(bare), latin / len(bare)) if bare else (0.0, 0.0)


def _requality(cue: dict) -> float:
    """``cues.cue_quality`` of a merged cue, whose duration and confidence have changed."""
    t = cue["text"]
    bare = t.replace(" ", "")
    zh, latin = _ratios(bare)
    if latin > zh:
        reads = len(bare) >= 3 and any(x.isascii() and x.isalpha() for x in t) and latin >= 0.45
    else:
        reads = len(t) >= 2 and any("㐀" <= x <= "鿿" or "！" <= x <= "～" for x in t) and zh >= 0.45
    paired = any(t.count(a) == t.count(b) > 0 for a, b in ("（）", "()"))
    colon = max(t.rfind("："), t.rfind(":"))
    score = min(1.0, len(bare) / 16) + min(1.0, max(0, cue["e"] - cue["s"]) / 2.5e6) + max(zh, latin) + 0.75 * max(0.0, min(1.0, cue["conf"]))
    return score + 0.8 * reads + 0.2 * bare.endswith(("。", "！", "？", ")", "）")) + 0.15 * paired - 0.35 * bare.endswith(("：", ":", "，", ",", "·")) - 0.4 * (colon >= 0 and colon > int(len(t) * 0.6))


def _holds(container: str, content: str) -> bool:
    a, b = (x.replace(" ", "").rstrip(_SIGNS) for x in (container, content))
    return bool(a and b and b in a)


def drop_bridges(df: DataFrame, by: By, threshold: float = 0.72, longest: int = 1_200_000) -> DataFrame:
    """Drops short cues that hold, or are like, both the last kept cue and the next, and are longer than either.

    The first and the last cue of a group stay. Cues longer than ``longest`` always stay and so do their followers'
    states: pieces end after one that no neighbour can change, so a group is dealt out in stretches of short cues.
    """
    from tidemark.operators.folds import ordered_fold  # which imports this module

    order = Window.partitionBy(*by).orderBy("s", "e", "pos")
    short = F.col("e") - F.col("s") <= longest
    rows = dealt(df, *by).withColumn("_next", F.lead("text").over(order)).withColumn("_first", F.row_number().over(order) == 1).withColumn("_short", short & ~F.col("_first") & F.col("_next").isNotNull())
    # a piece is a kept cue and the run of cues after it that may be bridges
    rows = rows.withColumn("_piece", F.sum(F.when(F.col("_short"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def step(last, text, follows, candidate):
        bridge = candidate and last is not None and len(text) > max(len(last), len(follows))
        bridge = bridge and (_holds(text, last) or reaches(last, text, threshold)) and (_holds(text, follows) or reaches(follows, text, threshold))
        return (last, False) if bridge else (text, True)

    kept = ordered_fold(rows, [*by, "_piece"], ["s", "e", "pos"], ["text", "_next", "_short"], lambda: None, step, "_keep", "boolean")
    return kept.where("_keep").select(df.columns)


def collapse_clusters(df: DataFrame, by: By, least: int = 4, span: int = 6_000_000, reach: int = 500_000) -> DataFrame:
    """Of a cluster of at least ``least`` cues in a short span that are mostly short, only the best reading stays.

    A cluster: cues that start at most ``reach`` after all earlier ones of it have ended.
    """
    rows = islands(df, by, "s", "e", reach, ("pos",)).withColumn("_d", F.greatest(F.col("e") - F.col("s"), F.lit(0)))
    c = Window.partitionBy(*by, "island")
    n, brief = F.count(F.lit(1)).over(c), F.count_if(F.col("_d") <= 1_000_000).over(c)
    dense = (n >= least) & (F.max("e").over(c) - F.min("s").over(c) <= span) & ((brief >= F.greatest(F.lit(3), n - 1)) | (F.avg("_d").over(c) <= 1_400_000))
    best = F.row_number().over(c.orderBy(F.col("_q").desc(), F.col("conf").desc(), F.col("_d").desc(), "s", "e", "pos"))
    rows = rows.withColumn("_q", F.round(C.cue_quality(F.col("text"), F.col("conf"), F.col("_d")), 9)).withColumn("_dense", dense).withColumn("_best", best)
    return rows.where(~F.col("_dense") | (F.col("_best") == 1)).drop("island", "_d", "_q", "_dense", "_best")


def clean_cues(df: DataFrame, by: By, threshold: float = 0.72, gap: int = 600_000, min_length: int = 2, min_confidence: float | None = None, language: str = "ch") -> DataFrame:
    """The whole chain on (by..., pos, s, e, text, conf); cues are numbered anew from 1 in ``index``."""
    kept = dealt(df, *by).where(C.keep_cue(F.col("text"), F.col("conf"), F.greatest(F.col("e") - F.col("s"), F.lit(0)), min_length, min_confidence, language))
    kept = kept.withColumn("text", T.normalize_text(F.col("text"))).withColumn("e", F.greatest("e", "s"))
    out = collapse_clusters(drop_bridges(merge_pairs(kept, by, threshold, gap), by, threshold), by)
    return out.withColumn("index", F.row_number().over(Window.partitionBy(*by).orderBy("s", "e", "pos")).cast("long"))


def merge_adjacent(df: DataFrame, by: By, threshold: float, interval: int) -> DataFrame:
    """Cues that follow the last one within a frame's ``interval`` and are similar become one: longer text, higher confidence."""
    rows = islands(dealt(df, *by), by, "s", "e", interval)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for row in pdf.sort_values(["s", "e"], kind="stable").to_dict("records"):
            last = kept[-1] if kept else None
            if last and row["s"] - last["e"] <= interval and reaches(last["text"], row["text"], threshold):
                last.update(e=max(last["e"], row["e"]), conf=max(last["conf"], row["conf"]), text=last["text"] if len(last["text"]) >= len(row["text"]) else row["text"])
            else:
                kept.append(row)
        return pd.DataFrame(kept, columns=list(pdf.columns))

    return rows.groupBy(*by, "island").applyInPandas(run, rows.schema).drop("island")


def audit_items(items: DataFrame) -> DataFrame:
    """Adds char_accuracy and exact of each item (text, reference_text); both null where there is no reference."""
    bare = lambda c: F.regexp_replace(T.normalize_text(F.col(c)), r"(?U)\s+", "")
    there = F.trim(F.coalesce("reference_text", F.lit(""))) != ""
    return items.withColumn("char_accuracy", F.when(there, T.char_accuracy(bare("text"), bare("reference_text")))).withColumn("exact", F.when(there, bare("text") == bare("reference_text")))


def audit_score(items: DataFrame, by: By, threshold: float = 0.9) -> DataFrame:
    """Per group: items, scored, missing, the mean accuracy, and whether all were scored and the mean is enough."""
    scored = audit_items(items).groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count("char_accuracy").alias("scored"), F.avg("char_accuracy").alias("accuracy"))
    passed = F.coalesce((F.col("scored") == F.col("total")) & (F.col("accuracy") >= threshold), F.lit(False))
    return scored.withColumn("missing", F.col("total") - F.col("scored")).withColumn("passed", passed)


def worst_items(items: DataFrame, by: By, order: str, k: int = 10) -> DataFrame:
    """The ``k`` scored items of each group with the least accuracy, in order of it."""
    w = Window.partitionBy(*by).orderBy("char_accuracy", order)
    return audit_items(items).where("char_accuracy is not null").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def profile_score(frames: DataFrame, by: By, language: str = "ch") -> DataFrame:
    """How well a profile reads sampled frames (text, conf): coverage, confidence, script and length in one score."""
    found = F.trim(F.coalesce("text", F.lit(""))) != ""
    script = C.chinese_ratio(F.col("text")) if language == "ch" else C.latin_ratio(F.col("text"))
    length = F.length(F.replace("text", F.lit("\n"), F.lit("")))
    sums = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.count_if(found).alias("detected"), *(F.coalesce(F.avg(F.when(found, x)), F.lit(0.0)).alias(n) for n, x in (("confidence", F.col("conf")), ("length", length), ("script", script))))
    score = F.col("detected") / F.col("samples") * 0.40 + F.col("confidence") * 0.30 + F.col("script") * 0.20 + F.least(F.lit(1.0), F.col("length") / 14.0) * 0.10
    return sums.withColumn("score", score)


def subtitle_lines(lines: DataFrame, min_confidence: float, language: str = "ch", width: int | None = None, height: int | None = None) -> DataFrame:
    """Recognised lines (text, conf, x, y, w, h) that can be subtitles; with the frame's size, only those in its lower part."""
    kept = lines.where((F.col("conf") >= min_confidence) & C.looks_like_subtitle(F.col("text"), language))
    if height is None or width is None:
        return kept
    small = (F.col("w") < width * 0.08) & (F.length("text") < 4)
    return kept.where((F.col("y") + F.col("h") / 2 >= height * 0.45) & (F.col("h") <= height * 0.16) & ~small)
