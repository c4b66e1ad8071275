"""Frame inspection, review actions and rounds, and shortlists of candidates by gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import cues as C
from tidemark.operators import sequences
from tidemark.operators.gates import margin_band

By = list[str]

#: What an inspected frame may be called (fixed values).
MISSING, DARK, BRIGHT, FLAT, BOTH, NORMAL = "缺失", "偏暗", "偏亮", "低对比度", "需关注", "正常"
#: What a selection mode, or else a reason tag, asks a reviewer to do; the first that fits (fixed values).
MODE_ACTIONS = {
    "manual-replacement": "check_compression_or_omission",
    "manual-accepted-compression": "check_compression_or_omission",
    "manual-override": "check_wording_and_merge",
    "manual-text-cleanup": "check_wording_and_merge",
    "anchor-fallback": "confirm_anchor_alignment",
}
TAG_ACTIONS = {"partial-segment": "confirm_partial_alignment", "accepted-low-score": "spot_check_low_score"}
#: The round of each action (fixed values).
ROUNDS = {
    "check_compression_or_omission": "round_a_compression",
    "check_wording_and_merge": "round_b_wording",
    "confirm_anchor_alignment": "round_c_anchor",
    "confirm_partial_alignment": "round_d_partial",
    "spot_check_low_score": "round_e_low_score",
}


def frame_inspection(luma: Column, contrast: Column, exists: Column) -> Column:
    """Struct of a frame's severity and whether it needs attention. A null measure breaks no rule; null ``exists`` is missing."""
    flat, tilted = contrast < 18, (luma < 40) | (luma > 215)
    severity = F.when(~F.coalesce(exists, F.lit(False)), MISSING).when(flat & tilted, BOTH).when(luma < 40, DARK).when(luma > 215, BRIGHT).when(flat, FLAT).otherwise(NORMAL)
    return F.struct(severity.alias("severity"), (severity != NORMAL).alias("needs_attention"))


def recommended_action(mode: Column, tags: Column) -> Column:
    """By the selection mode, else by the reason tags, else a general review."""
    by_mode = [F.when(mode == m, F.lit(action)) for m, action in MODE_ACTIONS.items()]
    by_tag = [F.when(F.array_contains(tags, tag), F.lit(action)) for tag, action in TAG_ACTIONS.items()]
    return F.coalesce(*by_mode, *by_tag, F.lit("general_review"))


def batch_action(quality: Column, mode: Column) -> Column:
    """The action for rows of a review batch: partial segments first, then by mode, else a spot check."""
    by_hand = mode.isin("manual-override", "manual-replacement", "manual-text-cleanup")
    return (
        F.when(quality == "phase-b-partial", "confirm_partial_alignment").when(by_hand, "check_wording_and_merge")
        .when(mode == "anchor-fallback", "confirm_anchor_alignment").otherwise("spot_check_low_score")
    )


def review_round(action: Column) -> Column:
    return F.coalesce(*(F.when(action == a, F.lit(name)) for a, name in ROUNDS.items()), F.lit("round_z_misc"))


def speaker_conflict(english: Column, chinese: Column) -> Column:
    """Why two arrays of speakers don't belong together, or null; an empty one fits all."""
    shared, n = F.size(F.array_intersect(english, chinese)), F.size(chinese)
    extras = F.size(F.array_except(chinese, english)) > 0
    found = F.when(shared == 0, "speaker-disjoint").when((F.size(english) <= 1) & (n > 1) & extras, "speaker-multi-mismatch").when((n >= 3) & (2 * shared < n), "speaker-low-overlap")
    return F.when((F.size(english) > 0) & (n > 0), found)


def judged_candidates(candidates: DataFrame, by: By, names: dict[str, str], high: float = 0.58, medium: float = 0.54, most_english: int = 6, most_chinese: int = 4, least_gap: float = 0.03) -> DataFrame:
    """The best candidate of each group ``by`` (score, n_english, n_chinese, english_text, chinese_text, pos) with its ``gap``
    to the runner-up (null when alone), its ``priority`` and ``skipped``: the first gate that it fails, or null."""
    best = sequences.runner_up_gap(candidates, by, "score", [F.col("score").desc(), "pos"])
    score, english, chinese, text = F.col("score"), F.col("n_english"), F.col("n_chinese"), F.coalesce("chinese_text", F.lit(""))
    priority = F.when((english <= 3) & (chinese <= 3) & (score >= high), "high").when((english <= 6) & (chinese <= 4) & (score >= medium), "medium")
    conflict = speaker_conflict(C.english_speakers(F.coalesce("english_text", F.lit("")), names), F.array_distinct(F.regexp_extract_all(text, F.lit(r"([^：:\s]{1,12})[：:]"), F.lit(1))))
    best = best.withColumn("priority", priority).withColumn("_conflict", conflict)
    skipped = (
        F.when((english > most_english) | (chinese > most_chinese), F.lit("size-limit")).when(F.col("priority").isNull(), "score-threshold")
        .when(F.col("gap") < least_gap, "low-score-gap").when(F.col("_conflict").isNotNull(), F.col("_conflict")).when(F.contains(text, F.lit("·")) & ~text.rlike("[：:]"), "label-fragment")
    )
    return best.withColumn("skipped", skipped).drop("_conflict")


def shortlisted(judged: DataFrame, clip: By, block: str, top: int = 40) -> DataFrame:
    """The ``top`` candidates of each clip that passed every gate: high priority first, then by score, then by ``block``."""
    return sequences.top_k(judged.where("skipped is null"), clip, [F.col("priority") != "high", F.col("score").desc(), block], top)


def part_probe(scores: DataFrame, by: By, part: str, assigned: str) -> DataFrame:
    """For each group ``by``: the best score in the assigned part, the best in any other, their margin to four digits, and
    its band. Without one of the two, margin and status are null."""
    own = F.col(part).eqNullSafe(F.col(assigned))
    rows = scores.groupBy(*by).agg(F.max(F.when(own, F.col("score"))).alias("assigned_score"), F.max(F.when(~own, F.col("score"))).alias("best_alternative"))
    margin = F.round(F.col("assigned_score") - F.col("best_alternative"), 4)
    return rows.withColumn("margin", margin).withColumn("status", F.when(F.col("margin").isNotNull(), margin_band(F.col("margin"))))
