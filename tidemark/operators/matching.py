"""Matching of a part's cues in stages that exclude each other, and the forced filling of what they leave open.

Both sides of a part are ordered cues. a: by, pos, s, e (seconds), text, vector; b: the same and clip, confidence. Matches
are one table, a row for each cue of a: by, a_pos, status, origin, score, confidence, clip, b_pos (array), group (array
of positions of a), note. A stage takes what is still free of both sides, by anti-joins with the stored matches of the
stages before, cut into scopes (a clip, a window between anchors, a part) which share no cue. All scopes of all parts are
aligned at once, in tiles; so the rounds of a job are its stages, whatever the number of parts.

Null texts count as empty and, like cues without a vector, are never matched. Positions are unique in a part's side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import cues as C
from tidemark.functions.text import normalize_text
from tidemark.operators import align, gates, tiles
from tidemark.operators.sequences import joined_fragments
from tidemark.storage import large, spent, stored

By = list[str]
MATCH = "a_pos long, status string, origin string, score double, confidence double, clip string, b_pos array<bigint>, `group` array<bigint>, note string"


@dataclass(frozen=True)
class Scope:
    """How a scope's cues are matched: similarity, path, context radii, name of its matches."""

    origin: str
    blend: tiles.Blend
    path: tiles.Path
    around: tuple[int, int] = (2, 1)
    gated: bool = True  # pairs of different speakers are left out


@dataclass(frozen=True)
class Groups:
    """How neighbours are matched as groups: largest sizes, thresholds, costs, name."""

    origin: str
    note: str
    largest: int = 2
    match: float = 0.56
    output: float = 0.64
    skip_a: float = 0.06
    skip_b: float = 0.04
    graded: bool = False  # pairs of one and one are graded by their score


def summed(vectors: Column) -> Column:
    """The sum of an array of vectors."""
    return F.aggregate(F.slice(vectors, 2, F.size(vectors)), F.transform(vectors[0], lambda x: x.cast("double")), lambda t, v: F.zip_with(t, v, lambda x, y: x + y))


def length(vector: Column) -> Column:
    return F.greatest(F.sqrt(F.aggregate(vector, F.lit(0.0), lambda t, x: t + x * x)), F.lit(1e-12))


def _latin(text: Column) -> Column:
    return F.regexp_count(normalize_text(text), F.lit("[A-Za-z0-9]"))


Span = tuple[str, str] | None


def features(a: DataFrame, b: DataFrame, by: By, blend: tiles.Blend, around: tuple[int, int], names: dict[str, str], span: Span = None) -> DataFrame:
    """Both sides' cues with the columns that ``blend`` needs.

    A context is the sum of the vectors of the cues around, whose direction counts. Progress of a runs from its first start to its
    last end, or between the columns of ``span``; that of b from 0 to its last end; both over a second at least.
    """
    out = []
    for side, rows, radius in (("a", a, around[0]), ("b", b, around[1])):
        whole, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("pos")
        start, end = F.lit(0.0), F.max("e").over(whole)
        if side == "a":
            start, end = (F.col(span[0]), F.col(span[1])) if span else (F.min("s").over(whole), end)
        text = F.col("text")
        if blend.context:
            rows = rows.withColumn("_context", summed(F.collect_list("vector").over(order.rowsBetween(-radius, radius))))
        made = {
            "context": F.col("_context"),
            "length": length(F.col("_context")),
            "progress": C.clamp(((F.col("s") + F.col("e")) / 2 - start) / F.greatest(end - start, F.lit(1.0)), 0.0, 1.0),
            "names": C.english_speakers(text, names) if side == "a" else F.lit(None).cast("array<string>"),
            "name": C.chinese_speaker(text) if side == "b" else F.lit(None).cast("string"),
            "named": C.explicit_speaker(text),
            "chars": (_latin(text) if side == "a" else C.cjk_count(text)).cast("int"),
        }
        columns = [F.coalesce(made[c], F.lit(False)).alias(c) if c == "named" else made[c].alias(c) for c in blend.columns() if c != "vector"]
        out.append(rows.select(*by, F.lit(side).alias("side"), "pos", "vector", *columns))
    return out[0].unionByName(out[1])


def graded(score: Column, confidence: Column, high: float = 0.82, medium: float = 0.70, low: float = 0.58) -> Column:
    """The status that a score deserves, less up to a fifth of it for a doubtful reading."""
    x = score * (0.8 + 0.2 * C.clamp(confidence, 0.0, 1.0))
    return F.when(x >= high, "matched-high").when(x >= medium, "matched-medium").when(x >= low, "matched-low").otherwise("unmatched")


def estimated(score: Column) -> Column:
    """The status of a forced match."""
    return F.when(score >= 0.70, "matched-high").when(score >= 0.42, "matched-medium").otherwise("matched-low")


def free_a(a: DataFrame, found: DataFrame, by: By) -> DataFrame:
    return a.join(large(found.select(*by, F.col("a_pos").alias("pos"))), [*by, "pos"], "left_anti")


def free_b(b: DataFrame, found: DataFrame, by: By) -> DataFrame:
    """Cues of b that no match holds; a match that names no clip holds none."""
    return b.join(large(found.where("clip is not null").select(*by, F.explode("b_pos").alias("pos"))), [*by, "pos"], "left_anti")


def _add(found: DataFrame, more: DataFrame) -> DataFrame:
    return stored(found.unionByName(more.select(found.columns)))


def _clip(keys: By) -> list[str]:
    return [] if "clip" in keys else ["clip"]


def _pairs(a: DataFrame, b: DataFrame, keys: By, scope: Scope, names: dict[str, str], status: str, span: Span) -> DataFrame:
    """Single matches of each scope, graded by ``status``: 'graded', 'estimated', or what is given."""
    pairs = tiles.aligned(features(a, b, keys, scope.blend, scope.around, names, span), keys, scope.blend, scope.path).withColumn("score", F.round("score", 4))
    rows = pairs.join(large(a.select(*keys, F.col("pos").alias("a_pos"), F.col("text").alias("_a"))), [*keys, "a_pos"])
    rows = rows.join(large(b.select(*keys, F.col("pos").alias("b_pos"), F.col("text").alias("_b"), "confidence", *_clip(keys))), [*keys, "b_pos"])
    if scope.gated:
        rows = rows.where(C.speakers_compatible(F.col("_a"), F.col("_b"), names))
    how = {"graded": graded(F.col("score"), F.col("confidence")), "estimated": estimated(F.col("score"))}.get(status, F.lit(status))
    rows = rows.withColumn("status", how).where("status <> 'unmatched'")
    return rows.withColumn("b_pos", F.array("b_pos")).withColumn("group", F.array("a_pos")).withColumn("origin", F.lit(scope.origin))


def _grouped(a: DataFrame, b: DataFrame, keys: By, how: Groups, names: dict[str, str]) -> DataFrame:
    """Matches of neighbours as groups in each scope, a row for each cue of a in a group."""
    side = lambda rows, x, **more: rows.select(*keys, F.lit(x).alias("side"), "pos", "s", "e", "vector", *(v.alias(k) for k, v in more.items()))
    no_names, no_name = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    rows = side(a, "a", names=C.english_speakers(F.col("text"), names), name=no_name).unionByName(side(b, "b", names=no_names, name=C.chinese_speaker(F.col("text"))))
    found = align.group_align(rows, keys, how.largest, how.largest, how.match, how.output, how.skip_a, how.skip_b, speakers=True)
    found = found.withColumn("score", F.round("score", 4)).withColumnsRenamed({"a_pos": "group", "b_pos": "bs"})
    one = estimated(F.col("score")) if how.graded else F.lit("matched-medium")
    found = found.withColumn("status", F.when(F.size("group") > 1, "merged-n1").when(F.size("bs") > 1, "merged-1n").otherwise(one))
    members = found.select(*keys, "group", F.explode("bs").alias("pos")).join(large(b.select(*keys, "pos", "confidence", *_clip(keys))), [*keys, "pos"])
    members = members.groupBy(*keys, "group").agg(F.round(F.avg("confidence"), 4).alias("confidence"), *(F.min_by(c, "pos").alias(c) for c in _clip(keys)))
    found = found.join(large(members), [*keys, "group"]).withColumnRenamed("bs", "b_pos").withColumn("a_pos", F.explode("group"))
    return found.withColumn("origin", F.lit(how.origin)).withColumn("note", F.concat(F.lit(how.note), "alignment", F.lit("" if how.graded else f"-{how.origin}")))


def match_scopes(found: DataFrame, a: DataFrame, b: DataFrame, by: By, keys: By, scope: Scope, groups: Groups | None, names: dict[str, str], status: str = "graded", span: Span = None, note: str | None = None) -> DataFrame:
    """``found`` and what is matched of the free cues of a and b scope by scope (``keys``): singly, then the rest in groups."""
    more = stored(_pairs(free_a(a, found, by), free_b(b, found, by), keys, scope, names, status, span).withColumn("note", F.lit(note or f"auto-matched-{scope.origin}")))
    found = _add(found, more)
    spent(more)
    if groups:
        more = stored(_grouped(free_a(a, found, by), free_b(b, found, by), keys, groups, names))
        found = _add(found, more)
        spent(more)
    return found


def reserved(reviewed: DataFrame, a: DataFrame, by: By) -> DataFrame:
    """Reviewed matches (group, b_pos, status, score, clip) as they are, for each of their cues that a has; the last wins.

    reviewed: by, ord (order of rows), group (positions of a), b_pos, status, score, clip.
    """
    rows = reviewed.select("*", F.explode("group").alias("a_pos"))
    last = Window.partitionBy(*by, "a_pos").orderBy(F.col("ord").desc())
    rows = rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").join(large(a.select(*by, F.col("pos").alias("a_pos"))), [*by, "a_pos"], "left_semi")
    return rows.select(*by, "a_pos", "status", F.lit("reviewed-master").alias("origin"), "score", F.lit(1.0).alias("confidence"), F.nullif("clip", F.lit("")).alias("clip"), "b_pos", "group", F.lit("locked-from-reviewed").alias("note"))


def in_clips(a: DataFrame, clips: DataFrame, by: By) -> DataFrame:
    """a with ``clip``: the one whose stretch of the part (half-open, the last with its end and a millisecond) holds a
    cue's midpoint, the first if several do; else the part's last. clips: by, clip, ord, start, end (seconds)."""
    order = Window.partitionBy(*by).orderBy("ord")
    marks = clips.withColumn("_last", F.lead("ord").over(order).isNull())
    mid = (F.col("s") + F.col("e")) / 2
    some = marks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("ord", "start", "end", "_last", "clip"))).alias("_clips"), F.max_by("clip", "ord").alias("_final"))  # a part's clips: one row
    hit = F.filter("_clips", lambda c: (mid >= c["start"]) & ((mid < c["end"]) | (c["_last"] & (mid <= c["end"] + 0.001))))
    return a.join(large(some), by).withColumn("clip", F.coalesce(F.get(hit, F.lit(0))["clip"], F.col("_final"))).drop("_clips", "_final")


def between(anchors: DataFrame, rows: DataFrame, by: By) -> DataFrame:
    """The windows that anchors leave, for each cue of both sides: by, side, pos, window.

    anchors: by, a_first, a_last, b_first, b_last. A window reaches from the furthest end so far to the next start; only
    where it has room on both sides; a part without anchors is one window. rows: by, side, pos.
    """
    ends = rows.groupBy(*by).agg((F.max(F.when(F.col("side") == "a", F.col("pos"))) + 1).alias("a_first"), (F.max(F.when(F.col("side") == "b", F.col("pos"))) + 1).alias("b_first"))
    marks = anchors.select(*by, "a_first", "a_last", "b_first", "b_last", F.lit(0).alias("_tail")).unionByName(ends.select(*by, "a_first", "b_first", F.lit(1).alias("_tail")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_tail", "a_first", "a_last", "b_first", "b_last")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    low = lambda c: F.coalesce(F.max(c).over(before), F.lit(-1)) + 1
    spans = marks.select(*by, low("a_last").alias("a0"), (F.col("a_first") - 1).alias("a1"), low("b_last").alias("b0"), (F.col("b_first") - 1).alias("b1"), F.row_number().over(w).alias("window"))
    spans = spans.where("a0 <= a1 and b0 <= b1")
    out = []
    for side in "ab":
        own = rows.where(F.col("side") == side).select(*by, "side", "pos")
        opened = spans.select(*by, F.col(f"{side}0").alias("pos"), F.struct("window", F.col(f"{side}1").alias("to")).alias("_in"))
        order = Window.partitionBy(*by).orderBy("pos", F.col("side").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        every = own.unionByName(opened, allowMissingColumns=True).withColumn("_in", F.last("_in", ignorenulls=True).over(order)).where("side is not null")
        out.append(every.where(F.col("pos") <= F.col("_in.to")).select(*by, "side", "pos", F.col("_in.window").alias("window")))
    return out[0].unionByName(out[1])


def meaningful(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cues whose prepared text says something; only these are matched in the stages."""
    empty = lambda x: F.coalesce(x, F.lit("")) != ""
    return a.where(empty(C.prepared_english_sequence(F.col("text"))) & F.col("vector").isNotNull()), b.where(empty(C.prepared_chinese_sequence(F.col("text"))) & F.col("vector").isNotNull())


LOCAL = tiles.Blend(0.45, 0.55, 0.08)
NEAR = tiles.Path(0.42, 0.50, 0.025, 0.018, 0.28, 120)


@dataclass(frozen=True)
class Stages:
    """The five stages' settings; None leaves a stage out."""

    clip: tuple[Scope, Groups] | None = (Scope("auto-clip-local-v1", LOCAL, NEAR), Groups("group-clip-local-v1", "group-dp-"))
    window: tuple[Scope, Groups] | None = (Scope("auto-anchor-window-v1", LOCAL, NEAR), Groups("group-anchor-window-v1", "group-dp-"))
    fallback: Scope | None = Scope("progress-fallback-v1", tiles.Blend(0.55, 0.30, 0.15), tiles.Path(0.26, 0.42, 0.014, 0.012, 0.45, 180), (1, 1))
    gate: bool = True
    #: Whether reviewed cues of b can bound windows. They are taken out of the sequence first, so as a rule a part is one window.
    anchored: bool = False
    names: dict[str, str] = field(default_factory=dict)


def rebuilt(a: DataFrame, b: DataFrame, clips: DataFrame, reviewed: DataFrame, by: By, stages: Stages = Stages()) -> DataFrame:
    """Every cue of a with its match: what is reviewed, then clip by clip, between anchors, over the part, and a gate.

    The gate takes back what can't stand and says why; such rows are 'unmatched' with the origin 'quality-gated-qc1-inline'.
    Cues without a match have the status 'unmatched' and the origin 'none'.
    """
    found = stored(reserved(reviewed, a, by))
    locked = reviewed.where(F.coalesce("clip", F.lit("")) != "").select(*by, F.explode("b_pos").alias("pos"))
    own, others = meaningful(a, b.join(large(locked), [*by, "pos"], "left_anti"))
    if stages.clip:
        found = match_scopes(found, in_clips(own, clips, by), others, by, [*by, "clip"], *stages.clip, stages.names)
    if stages.window:
        every = a.select(*by, F.lit("a").alias("side"), "pos").unionByName(b.select(*by, F.lit("b").alias("side"), "pos"))
        spans = reviewed.where("size(group) > 0 and size(b_pos) > 0").select(*by, *(f(c).alias(n) for c, x in (("group", "a"), ("b_pos", "b")) for f, n in ((F.array_min, f"{x}_first"), (F.array_max, f"{x}_last"))))
        windows = stored(between(spans if stages.anchored else spans.limit(0), every, by))
        scoped = lambda rows, side: rows.join(large(windows.where(F.col("side") == side).select(*by, "pos", "window")), [*by, "pos"])
        found = match_scopes(found, scoped(own, "a"), scoped(others, "b"), by, [*by, "window"], *stages.window, stages.names)
    if stages.fallback:
        spans = a.groupBy(*by).agg(F.lit(0.0).alias("from"), F.max("e").alias("to"))
        found = match_scopes(found, own.join(large(spans), by), others, by, by, stages.fallback, None, stages.names, "matched-low", ("from", "to"), "fallback-progress-alignment-on-full-part-sequence")
    rows = with_matches(a, b, found, by)
    return gates.gate_matches(rows, inline=True).drop("gate_reasons") if stages.gate else rows


def with_matches(a: DataFrame, b: DataFrame, found: DataFrame, by: By) -> DataFrame:
    """Every cue of a as an aligned row: by, pos, s, e, english_text, status, match_origin, match_score,
    chinese_confidence, source_clip, chinese_text (the matched cues' texts, joined), chinese_cue_ids, group, notes."""
    texts = found.select(*by, "a_pos", F.posexplode("b_pos").alias("_k", "pos")).join(large(b.select(*by, "pos", "text")), [*by, "pos"])
    texts = joined_fragments(texts, [*by, "a_pos"], "_k", "text").withColumnRenamed("text", "chinese_text")
    got = found.join(large(texts), [*by, "a_pos"], "left").withColumnRenamed("a_pos", "pos")
    rows = a.select(*by, "pos", "s", "e", F.col("text").alias("english_text")).join(large(got), [*by, "pos"], "left")
    return rows.select(
        *by, "pos", "s", "e", "english_text", F.coalesce("status", F.lit("unmatched")).alias("status"), F.coalesce("origin", F.lit("none")).alias("match_origin"), F.col("score").alias("match_score"),
        F.col("confidence").alias("chinese_confidence"), F.col("clip").alias("source_clip"), F.coalesce("chinese_text", F.lit("")).alias("chinese_text"),
        F.transform(F.coalesce("b_pos", F.array().cast("array<bigint>")), lambda x: x.cast("string")).alias("chinese_cue_ids"), F.coalesce("group", F.array("pos")).alias("group"), F.coalesce("note", F.lit("")).alias("notes"),
    )

