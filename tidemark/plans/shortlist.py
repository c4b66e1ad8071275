"""Queries over the driver's tables for inspection, review rounds, shortlists and probes, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import shortlist
from tidemark.plans.catalog import query
from tidemark.plans.review import CASES, cases

MODES = ("manual-replacement", "manual-override", "anchor-fallback", "auto", "manual-accepted-compression", "manual-text-cleanup", "auto")
#: The speakers of the English case texts.
SPEAKERS = {"mira": "小梅", "baker": "老板"}


@query(
    """with m as (select p_partkey, p_partkey * 7 % 256 as luma, p_size as contrast, p_partkey % 11 <> 0 as found from part), s as (select p_partkey, case when not found then '缺失' when (luma < 40 or luma > 215) and contrast < 18 then '需关注'
    when luma < 40 then '偏暗' when luma > 215 then '偏亮' when contrast < 18 then '低对比度' else '正常' end as severity from m) select p_partkey, severity, severity <> '正常' as needs_attention from s"""
)
def frame_inspection(t):
    seen = shortlist.frame_inspection(F.col("p_partkey") * 7 % 256, F.col("p_size"), F.col("p_partkey") % 11 != 0)
    return t.part.select("p_partkey", seen.alias("x")).select("p_partkey", "x.*")


_MODE = f"([{', '.join(repr(m) for m in MODES)}])[id % {len(MODES)} + 1]"


@query(
    f"""with {CASES}, m as (select id, {_MODE} as mode, id % 3 = 0 as partial, id % 5 = 0 as low from cases),
    a as (select id, case when mode in ('manual-replacement', 'manual-accepted-compression') then 'check_compression_or_omission' when mode in ('manual-override', 'manual-text-cleanup') then 'check_wording_and_merge' when mode = 'anchor-fallback' then 'confirm_anchor_alignment'
        when partial then 'confirm_partial_alignment' when low then 'spot_check_low_score' else 'general_review' end as action,
        case when partial then 'confirm_partial_alignment' when mode in ('manual-override', 'manual-replacement', 'manual-text-cleanup') then 'check_wording_and_merge' when mode = 'anchor-fallback' then 'confirm_anchor_alignment' else 'spot_check_low_score' end as batch from m)
    select id, action, batch, case action when 'check_compression_or_omission' then 'round_a_compression' when 'check_wording_and_merge' then 'round_b_wording' when 'confirm_anchor_alignment' then 'round_c_anchor'
        when 'confirm_partial_alignment' then 'round_d_partial' when 'spot_check_low_score' then 'round_e_low_score' else 'round_z_misc' end as round from a"""
)
def review_rounds(t):
    i = F.col("id")
    mode = F.element_at(F.array(*(F.lit(m) for m in MODES)), (i % len(MODES) + 1).cast("int"))
    tags = F.array_compact(F.array(F.when(i % 3 == 0, "partial-segment"), F.when(i % 5 == 0, "accepted-low-score")))
    quality = F.when(i % 3 == 0, "phase-b-partial").otherwise("phase-b-accepted")
    rows = cases(t).select("id", shortlist.recommended_action(mode, tags).alias("action"), shortlist.batch_action(quality, mode).alias("batch"))
    return rows.withColumn("round", shortlist.review_round(F.col("action")))


_JUDGED = f"""with {CASES}, c as (select id, zh, id % 5 as clip, id // 15 as block, id % 8 as ne, id % 6 as nz, (id % 31) / 50.0::double as sc, case when en in ('Mira: Keep the lamp burning.', 'Mira:') then ['小梅'] when en = 'Baker: (laughs) Eat' then ['老板'] else []::varchar[] end as es,
    list_distinct(regexp_extract_all(zh, '([^：:\\s]{{1,12}})[：:]', 1)) as zs from cases),
    r as (select *, row_number() over (partition by clip, block order by sc desc, id) as r, sc - lead(sc) over (partition by clip, block order by sc desc, id) as gap from c),
    j as (select *, case when ne <= 3 and nz <= 3 and sc >= 0.58 then 'high' when ne <= 6 and nz <= 4 and sc >= 0.54 then 'medium' end as priority, len(list_intersect(es, zs)) as shared from r where r = 1),
    k as (select *, case when ne > 6 or nz > 4 then 'size-limit' when priority is null then 'score-threshold' when gap < 0.03 then 'low-score-gap' when len(es) > 0 and len(zs) > 0 and shared = 0 then 'speaker-disjoint'
        when len(es) = 1 and len(zs) > 1 then 'speaker-multi-mismatch' when len(es) > 1 and len(zs) >= 3 and 2 * shared < len(zs) then 'speaker-low-overlap' when contains(zh, '·') and not regexp_matches(zh, '[：:]') then 'label-fragment' end as skipped from j)"""


def _judged(t):
    i = F.col("id")
    rows = cases(t).select((i % 5).alias("clip"), F.expr("id div 15").alias("block"), i.alias("pos"), (i % 31 / 50.0).alias("score"), (i % 8).alias("n_english"), (i % 6).alias("n_chinese"), F.col("en").alias("english_text"), F.col("zh").alias("chinese_text"))
    return shortlist.judged_candidates(rows, ["clip", "block"], SPEAKERS)


@query(f"{_JUDGED} select clip, block, id as pos, priority, round(gap, 4) as gap, skipped from k")
def shortlist_gates(t):
    return _judged(t).select("clip", "block", "pos", "priority", F.round("gap", 4).alias("gap"), "skipped")


@query(f"{_JUDGED}, o as (select clip, block, id as pos, priority, row_number() over (partition by clip order by priority <> 'high', sc desc, block) as rank from k where skipped is null) select * from o where rank <= 40")
def shortlist_top(t):
    return shortlist.shortlisted(_judged(t), ["clip"], "block").select("clip", "block", "pos", "priority", "rank")


@query(
    """with s as (select o_custkey, o_orderpriority as part, (o_orderkey % 100) / 100.0::double as score from orders), b as (select o_custkey, max(score) filter (part = '1-URGENT') as assigned_score, max(score) filter (part <> '1-URGENT') as best_alternative from s group by 1),
    m as (select *, round(assigned_score - best_alternative, 4) as margin from b) select *, case when margin >= 0.08 then 'stable' when margin >= 0 then 'weak-positive' when margin >= -0.05 then 'ambiguous' when margin < -0.05 then 'misassigned-likely' end as status from m"""
)
def part_probe(t):
    rows = t.orders.select("o_custkey", F.col("o_orderpriority").alias("part"), F.lit("1-URGENT").alias("assigned"), (F.col("o_orderkey") % 100 / 100.0).alias("score"))
    return shortlist.part_probe(rows, ["o_custkey"], "part", "assigned")
