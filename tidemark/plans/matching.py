"""Queries on aligned sequences: similarity in bands, alignments, stages and forced passes over the cues of every user.

Cues of even ids are one side, those of odd ids the other; vectors and texts are made from times, types and amounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import align, forced, matching, tiles, trials
from tidemark.plans.catalog import CUES, query
from tidemark.storage import large

BLEND = tiles.Blend(0.76, 0.24, 0.28, 0.16, 0.06, 0.04, forced.SHORT)
PATH = tiles.Path(0.80, 0.85, 0.01, 0.01, 0.05, 6)
NAMES = {"ann": "安"}
TYPES = ("view", "click", "error", "purchase", "signup")


def parts() -> list[Column]:
    kind = sum((F.when(F.col("text") == t, i).otherwise(0) for i, t in enumerate(TYPES)), F.lit(1))
    return [(F.col("cents") % 7 + 1).cast("double"), (F.floor(F.col("cents") / 7) % 5 + 1).cast("double"), kind.cast("double"), (F.floor(F.col("s") / 1_000_000) % 11 + 1).cast("double")]


def cues(t) -> tuple[DataFrame, DataFrame]:
    """Both sides of every user: part, pos, s and e (seconds from the user's first cue), text, vector; b has clip and confidence."""
    rows = t.relative().withColumn("side", F.when(F.col("seg_id") % 2 == 0, "a").otherwise("b"))
    order = Window.partitionBy("grp", "side").orderBy("s", "seg_id")
    length = F.sqrt(sum((x * x for x in parts()), F.lit(0.0)))
    rows = rows.withColumn("pos", F.row_number().over(order).cast("long") - 1).withColumn("vector", F.array(*(x / length for x in parts())))
    seconds = [(F.col(c) / 1_000_000).alias(c) for c in ("s", "e")]
    said = F.concat(F.when(F.col("cents") % 3 == 0, "Ann: ").otherwise(""), F.lit("we count "), F.col("text"), F.lit(" "), F.col("cents").cast("string"))
    read = F.concat(F.when(F.col("cents") % 4 == 0, "安：").when(F.col("cents") % 4 == 1, "波：").otherwise(""), F.translate(F.col("cents").cast("string"), "0123456789", "零一二三四五六七八九"))
    a = rows.where("side = 'a'").select(F.col("grp").alias("part"), "pos", *seconds, said.alias("text"), "vector")
    b = rows.where("side = 'b'").select(F.col("grp").alias("part"), "pos", *seconds, read.alias("text"), "vector", F.concat(F.lit("clip"), F.floor(F.col("pos") / 12).cast("string")).alias("clip"), (0.6 + (F.col("cents") % 5) / 10).alias("confidence"))
    return a, b


def clips(a: DataFrame) -> DataFrame:
    """Stretches of twelve cues of each part."""
    made = a.withColumn("ord", F.floor(F.col("pos") / 12).cast("int")).groupBy("part", "ord").agg(F.min("s").alias("start"))
    after = F.lead("start").over(Window.partitionBy("part").orderBy("ord"))
    return made.select("part", F.concat(F.lit("clip"), F.col("ord").cast("string")).alias("clip"), "ord", "start", F.coalesce(after, F.lit(1e12)).alias("end"))


def reviewed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every tenth cue of a is reviewed, with the cue of b at its place."""
    pairs = a.where("pos % 10 = 4").select("part", "pos").join(large(b.select("part", "pos", "clip")), ["part", "pos"])
    return pairs.select("part", F.col("pos").alias("ord"), F.array("pos").alias("group"), F.array("pos").alias("b_pos"), F.lit("matched-high").alias("status"), F.lit(0.9).alias("score"), "clip")


_V = ["cents % 7 + 1", "cents // 7 % 5 + 1", "case text when 'click' then 2 when 'error' then 3 when 'purchase' then 4 when 'signup' then 5 else 1 end", "(s // 1000000) % 11 + 1"]
_SIDES = f"""{CUES}, base as (select grp, min(s) as b0 from cues group by grp),
    r0 as (select c.grp, seg_id, (c.s - b0) as s, (c.e - b0) as e, text, cents, case when seg_id % 2 = 0 then 'a' else 'b' end as side from cues c join base using (grp)),
    r1 as (select *, row_number() over (partition by grp, side order by s, seg_id) - 1 as pos, {", ".join(f"({x})::double as w{i}" for i, x in enumerate(_V))} from r0),
    r2 as (select *, sqrt(w0 * w0 + w1 * w1 + w2 * w2 + w3 * w3) as len from r1),
    r3 as (select *, w0 / len as v0, w1 / len as v1, w2 / len as v2, w3 / len as v3, count(*) over (partition by grp, side) as n, s / 1e6 as ss, e / 1e6 as se from r2)"""
_AROUND = lambda k: ", ".join(f"sum(v{i}) over (partition by grp order by pos rows between {k} preceding and {k} following) as c{i}" for i in range(4))
_BLEND = f"""with {_SIDES},
    a0 as (select *, {_AROUND(2)}, greatest(0, least(1, ((ss + se) / 2 - min(ss) over g) / greatest(max(se) over g - min(ss) over g, 1))) as p from r3 where side = 'a' window g as (partition by grp)),
    b0_ as (select *, {_AROUND(1)}, greatest(0, least(1, (ss + se) / 2 / greatest(max(se) over g, 1))) as p from r3 where side = 'b' window g as (partition by grp)),
    a as (select *, sqrt(c0 * c0 + c1 * c1 + c2 * c2 + c3 * c3) as cl, cents % 3 = 0 as named, 7 + length(text) + length(cents::varchar) + case when cents % 3 = 0 then 3 else 0 end as chars from a0),
    b as (select *, sqrt(c0 * c0 + c1 * c1 + c2 * c2 + c3 * c3) as cl, case cents % 4 when 0 then '安' when 1 then '波' end as name, length(cents::varchar) + case when cents % 4 < 2 then 1 else 0 end as chars from b0_)
    select a.grp as part, a.pos as a_pos, b.pos as b_pos,
        round(1e9 * (0.76 * (a.v0 * b.v0 + a.v1 * b.v1 + a.v2 * b.v2 + a.v3 * b.v3) + 0.24 * (a.c0 * b.c0 + a.c1 * b.c1 + a.c2 * b.c2 + a.c3 * b.c3) / (a.cl * b.cl)
        + 0.28 * greatest(0, least(1, 1 - abs(a.p - b.p) / 0.16)) - case when a.named and b.name = '波' then 0.06 else 0 end - case when a.named and b.name is null then 0.04 else 0 end
        - case when b.chars <= 1 and a.chars >= 6 then 0.08 when b.chars <= 2 and a.chars >= 10 then 0.05 else 0 end))::bigint as score_billionths
    from a join b on a.grp = b.grp and abs(b.pos + 1 - floor(a.pos * (b.n / a.n))) <= floor(greatest(least(6, b.n), 0.05 * b.n))"""


@query(_BLEND)
def blended_similarity(t):
    a, b = cues(t)
    rows = matching.features(a, b, ["part"], BLEND, (2, 1), NAMES)
    return tiles.blended(rows, ["part"], BLEND, PATH).select("part", "a_pos", "b_pos", F.round(F.col("score") * 1e9).cast("long").alias("score_billionths"))


@query()
def tiled_align(t):
    a, b = cues(t)
    return tiles.aligned(matching.features(a, b, ["part"], BLEND, (2, 1), NAMES), ["part"], BLEND, PATH)


@query()
def group_align_speakers(t):
    a, b = cues(t)
    from tidemark.functions import cues as C

    side = lambda rows, x, names, name: rows.select("part", F.lit(x).alias("side"), "pos", "s", "e", "vector", names.alias("names"), name.alias("name"))
    rows = side(a, "a", C.english_speakers(F.col("text"), NAMES), F.lit(None).cast("string")).unionByName(side(b, "b", F.lit(None).cast("array<string>"), C.chinese_speaker(F.col("text"))))
    return align.group_align(rows, ["part"], 2, 2, speakers=True)


@query()
def exclusive_pairs(t):
    a, b = cues(t)
    rows = matching.features(a, b, ["part"], BLEND, (2, 1), NAMES)
    return align.exclusive(tiles.blended(rows, ["part"], BLEND, PATH).where("score >= 0.9"), ["part"])


@query()
def staged_rebuild(t):
    a, b = cues(t)
    return matching.rebuilt(a, b, clips(a), reviewed(a, b), ["part"], matching.Stages(names=NAMES))


@query()
def forced_fill(t):
    a, b = cues(t)
    found = matching.reserved(reviewed(a, b), a, ["part"])
    return forced.forced(a, b, clips(a), found, ["part"], forced.Passes(names=NAMES, tail=(3, 0.5, 0.18)))


def _clip_order(b: DataFrame) -> DataFrame:
    return b.withColumn("ord", F.regexp_extract("clip", "([0-9]+)$", 1).cast("int"))


_B = f"with {_SIDES}, b as (select grp as part, pos, ss as s, se as e, 'clip' || (pos // 12) as clip, pos // 12 as ord from r3 where side = 'b')"


@query(f"{_B}, d as (select part, clip, ord, arg_max(e, pos) - arg_min(s, pos) as length from b group by all), w as (select *, coalesce(sum(length) over (partition by part order by ord rows between unbounded preceding and 1 preceding), 0) as ws from d) select part, clip, round(ws * 1000)::bigint as window_start, round((ws + length) * 1000)::bigint as window_end from w")
def trial_windows(t):
    rows = trials.end_to_end(_clip_order(cues(t)[1]), ["part"])
    ms = lambda c, name: F.round(F.col(c) * 1000).cast("long").alias(name)
    return rows.select("part", "clip", ms("ws", "window_start"), ms("we", "window_end"))


@query(
    f"""{_B}, p as (select *, row_number() over (partition by part, clip order by s, e) as i, max(e) over (partition by part, clip order by s, e rows between unbounded preceding and 1 preceding) as before from b),
    r as (select *, sum(case when before is null or s > before + 3600 then 1 else 0 end) over (partition by part, clip order by s, e rows unbounded preceding) as run from p),
    w as (select part, clip, min(s) as ws, max(e) as we from r group by part, clip, run), a as (select grp as part, pos, ss as s from r3 where side = 'a'),
    h as (select distinct part, clip, pos from w join a using (part) where a.s between ws - 300 and we + 300)
    select part, clip, count(*) as cues, sum(pos)::bigint as pos_sum from h group by part, clip"""
)
def anchor_window_cues(t):
    a, b = cues(t)
    windows = trials.around_anchors(b.select("part", "clip", "s", "e"), ["part"], 3600.0)
    near = trials.in_windows(a, windows, ["part"], 300.0, 36_000.0)
    return near.groupBy("part", "clip").agg(F.count(F.lit(1)).alias("cues"), F.sum("pos").alias("pos_sum"))


@query()
def trial_results(t):
    a, b = cues(t)
    windows = trials.around_anchors(b.select("part", "clip", "s", "e"), ["part"], 3600.0)
    found = trials.trial_align(a, b, windows, ["part"], 300.0, 0.7, width=36_000.0)
    return trials.reconciled(trials.deduped(found, ["part"]), ["part"])
