"""Quality gates, review queues and decision tables: ordered conditions as column expressions, no shuffle of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import cues as C
from tidemark.functions.text import let
from tidemark.operators.rules import reasons


def _c(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def gate_reasons(inline: bool = False) -> Column:
    """Why a generated match (english_text, chinese_text, match_origin, match_score) can't stand; none if it is reviewed.

    ``inline``: the rules while matches are made, which let short but sure ones pass and know one reason more.
    """
    en, zh, origin, score = _c("english_text"), _c("chinese_text"), _c("match_origin"), F.coalesce("match_score", F.lit(0.0))
    facts = F.struct(
        let(C.prepared_english(en), lambda meaning: C.word_count(F.when(meaning != "", meaning).otherwise(en))).alias("words"),
        C.cjk_count(zh).alias("cjk"), C.explicit_speaker(zh).alias("spoken"), (C.explicit_speaker(en) & ~C.explicit_speaker(zh)).alias("lacks"),
    )

    def found(x: Column) -> Column:
        words, cjk, spoken, lacks_speaker = x["words"], x["cjk"], x["spoken"], x["lacks"]
        no_short = no_missing = no_group = F.lit(False)
        group = origin == "group-anchor-window-v1"
        extra = []
        if inline:
            group = F.startswith(origin, F.lit("group-"))
            no_short, no_missing = spoken & (score >= 0.75), (score >= 0.76) & (cjk >= 4)
            no_group = (spoken & C.question(en) & C.question(zh)) | ((score >= 0.74) & C.stage_direction(en) & C.stage_direction(zh) & spoken)
            extra = [("clip-local-speaker-mismatch", F.startswith(origin, F.lit("group-clip-")) & lacks_speaker & (words >= 2) & (score < 0.74))]
        return reasons(
            ("no-cjk", cjk == 0),
            ("ascii-noise", C.ascii_alpha_count(zh) >= 3),
            ("repeated-ocr-fragment", C.repeated_phrase(zh)),
            ("empty-semantic-after-clean", (words >= 2) & (C.prepared_chinese(zh) == "")),
            ("too-short-for-english-length", (cjk <= 2) & (words >= 2) & ~no_short),
            ("speaker-missing-on-short-zh", lacks_speaker & (cjk <= 4) & (words >= 2) & ~no_missing),
            ("short-group-match", group & (cjk <= 4) & (words >= 2) & (score < 0.75) & ~no_group),
            *extra,
        )

    return F.when(origin.isin("none", "reviewed-master"), F.array().cast("array<string>")).otherwise(let(facts, found))


def gate_matches(rows: DataFrame, inline: bool = False) -> DataFrame:
    """Rows with a reason become unmatched: their text, score, confidence, clip and cue ids go, a note says why."""
    tag = "qc1-inline" if inline else "qc1"
    rows = rows.withColumn("gate_reasons", gate_reasons(inline))
    bad = F.size("gate_reasons") > 0
    fresh = {
        "status": F.lit("unmatched"), "match_origin": F.lit(f"quality-gated-{tag}"), "match_score": F.lit(None), "chinese_confidence": F.lit(None), "source_clip": F.lit(None),
        "chinese_text": F.lit(""), "chinese_cue_ids": F.array().cast("array<string>"), "notes": F.concat(F.lit(f"{tag}-rejected: "), F.array_join("gate_reasons", ", ")),
    }
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: F.when(bad, x.cast(kinds[c])).otherwise(F.col(c)) for c, x in fresh.items() if c in rows.columns})


def score_status(score: Column) -> Column:
    return F.when(score >= 0.70, "matched-high").when(score >= 0.42, "matched-medium").otherwise("matched-low")


def auto_status(score: Column, confidence: Column, high: float = 0.82, medium: float = 0.70, low: float = 0.58) -> Column:
    """Bands of a score that the reading's confidence lowers by a fifth at most."""
    sure = score * (0.8 + 0.2 * C.clamp(confidence, 0.0, 1.0))
    return F.when(sure >= high, "matched-high").when(sure >= medium, "matched-medium").when(sure >= low, "matched-low").otherwise("unmatched")


def reviewed_status(n_english: Column, n_chinese: Column) -> Column:
    return F.when(n_english > 1, "merged-n1").when(n_chinese > 1, "merged-1n").otherwise("matched-high")


def margin_band(margin: Column) -> Column:
    return F.when(margin >= 0.08, "stable").when(margin >= 0.0, "weak-positive").when(margin >= -0.05, "ambiguous").otherwise("misassigned-likely")


#: Selection modes in which a person decided (fixed values).
MANUAL_MODES = ("manual-accepted-compression", "manual-text-cleanup", "manual-override", "manual-replacement")


def curation(rows: DataFrame, low_score: float, manual: tuple[str, ...] = MANUAL_MODES) -> DataFrame:
    """Adds tags and priority for curation from quality_label, selection_mode and match_score; skip where there is no tag."""
    partial, accepted = F.col("quality_label") == "phase-b-partial", F.col("quality_label") == "phase-b-accepted"
    by_hand = F.col("selection_mode").isin(*manual)
    tags = reasons(("partial-segment", partial), ("manual-decision-trace", by_hand), ("accepted-low-score", accepted & (F.col("match_score") < low_score)))
    high = (by_hand & accepted) | (partial & (F.col("selection_mode").isin("manual-accepted-compression", "manual-text-cleanup") | (F.col("match_score") < 0.72)))
    return rows.withColumn("tags", tags).withColumn("priority", F.when(F.size("tags") == 0, "skip").when(high, "high").otherwise("medium"))


def cue_review(rows: DataFrame) -> DataFrame:
    """Adds review reasons from selection_mode and the counts n_english and n_chinese, and whether there is something to do."""
    mode = _c("selection_mode")
    named = [(m, mode == m) for m in ("anchor-fallback", "manual-override", "manual-replacement")]
    rows = rows.withColumn("reasons", reasons(*named, ("structural_compression", F.col("n_english") > F.col("n_chinese"))))
    return rows.withColumn("actionable", F.array_contains("reasons", "structural_compression") & (mode != "manual-replacement"))


#: Review buckets with their priority, and what the model's queue calls them, with its priority (fixed values).
BUCKETS = {"needs-review-unmatched": 0, "needs-review-low": 1, "needs-review-medium": 2, "needs-review-auto-high": 3, "locked-anchor": 9}
MODEL_BUCKETS = {"needs-review-low": ("model-review-low-match", 0), "needs-review-medium": ("model-review-medium-match", 1), "needs-review-auto-high": ("model-review-auto-high", 2)}


def review_bucket(origin: Column, status: Column) -> Column:
    status = F.coalesce(status, F.lit("unmatched"))
    return (
        F.when(origin == "reviewed-master", "locked-anchor").when(status == "unmatched", "needs-review-unmatched").when(status == "matched-low", "needs-review-low")
        .when(status.isin("matched-medium", "merged-1n", "merged-n1"), "needs-review-medium").otherwise("needs-review-auto-high")
    )


def bucket_priority(bucket: Column) -> Column:
    return F.coalesce(*(F.when(bucket == b, F.lit(p)) for b, p in BUCKETS.items()), F.lit(9))


def model_bucket(bucket: Column) -> Column:
    """Struct of the model queue's name and priority."""
    made = lambda name, p: F.struct(F.lit(name).alias("name"), F.lit(p).alias("priority"))
    return F.coalesce(*(F.when(bucket == b, made(n, p)) for b, (n, p) in MODEL_BUCKETS.items()), made("model-review-unmatched", 3))


def low_value_reason(bucket: Column, english: Column, current: Column, preview: Column, label: str = r"^[A-Z0-9 '&:,.!?-]+$") -> Column:
    """Why an unmatched row isn't worth a model's time: nothing to compare, a label, or too short without a preview."""
    text = F.trim(F.coalesce(english, F.lit("")))
    words = C.word_count(text)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    found = F.when(C.prepared_english(text) == "", "empty-english-semantic").when(text.rlike(label) & (words <= 8), "ui-only").when((words <= 3) & blank(current) & blank(preview), "too-short-no-preview")
    return F.when(bucket == "needs-review-unmatched", found)


def junk_reason(status: Column, english: Column, whole: list[str], parts: list[str], short: int) -> Column:
    """Why an unmatched row is junk: a known text, a text with a known part, or at most ``short`` characters."""
    text = F.trim(F.coalesce(english, F.lit("")))
    low = F.lower(text)
    part = F.lit(False)
    for p in parts:
        part = part | F.contains(low, F.lit(p))
    found = F.when(low.isin(*whole), "junk-pattern").when(part, "junk-substring").when(F.length(text) <= short, f"short-unmatched<={short}")
    return F.when(status == "unmatched", found)


def mini_bucket(status: Column, origin: Column, score: Column, low: float) -> Column:
    return F.when(status == "unmatched", "mini-unmatched").when(F.startswith(F.coalesce(origin, F.lit("none")), F.lit("forced-")) & (F.coalesce(score, F.lit(0.0)) <= low), "mini-low-forced")


def noise_ratio(text: Column, noise: str = r"[^\p{L}\p{N}，。！？：；、“”‘’（）《》【】,.!?;:'\"()-]") -> Column:
    """Share of characters that a reading of a text shouldn't have."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    return F.regexp_count(bare, F.lit(noise)) / F.greatest(F.length(bare), F.lit(1))


#: Points of a match's risk by review bucket and by origin (fixed values).
RISK_BUCKET = {"needs-review-low": 4.0, "needs-review-medium": 2.0, "needs-review-auto-high": 1.0}
RISK_ORIGIN = {"group-clip-local-v1": 3.0, "group-anchor-window-v1": 2.5, "auto-anchor-window-v1": 1.5, "auto-clip-local-v1": 1.0}


def match_risk(mismatch: Column, bucket: Column, origin: Column, text: Column, score: Column) -> Column:
    """How likely a match is wrong, in points."""
    pick = lambda c, table: F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in table.items()), F.lit(0.0))
    points = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    t = F.trim(F.coalesce(text, F.lit("")))
    short = F.length(F.regexp_replace(t, r"[\s，。！？：:]", "")) <= 2
    total = points(F.coalesce(mismatch, F.lit(False)), 6.0) + pick(bucket, RISK_BUCKET) + F.greatest(F.lit(0.0), 0.8 - F.coalesce(score, F.lit(0.0))) * 10 + pick(origin, RISK_ORIGIN)
    return F.round(total + points(short, 2.5) + points(noise_ratio(t) >= 0.08, 2.0) + points(F.length(t) <= 1, 2.0), 4)


def unmatched_value(preview: Column, previous: Column, following: Column, english: Column, seconds: Column) -> Column:
    """How much an unmatched row is worth another look, in points."""
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    points = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    seen = F.when(there(preview), F.least(F.length(preview), F.lit(80)) / 20.0 + points(noise_ratio(preview) < 0.06, 1.0)).otherwise(F.lit(0.0))
    return F.round(seen + points(there(previous), 0.8) + points(there(following), 0.8) + points(C.word_count(english) >= 4, 0.6) + points(seconds >= 2.0, 0.3), 4)


def split_queues(rows: DataFrame, at: float = 4.0) -> DataFrame:
    """Adds queue and focus_rank from kind ('fix' or 'unmatched'), score, mismatch and match_origin; ranked by ``pos`` in each.

    Hot fixes that mismatch on an anchor window come first, then all other fixes, then the rich and the other unmatched rows.
    """
    first = (F.col("score") >= at) & F.coalesce("mismatch", F.lit(False)) & F.col("match_origin").isin("auto-anchor-window-v1", "group-anchor-window-v1")
    queue = F.when((F.col("kind") == "fix") & first, "first_pass_match_fix").when(F.col("kind") == "fix", "remaining_match_fix").when(F.col("score") >= at, "unmatched_rich").otherwise("unmatched_rest")
    w = Window.partitionBy("queue").orderBy(F.col("score").desc(), "pos")
    return rows.withColumn("queue", queue).withColumn("focus_rank", F.row_number().over(w).cast("long"))


def speaker_decision(english: Column, chinese: Column, mismatch: Column, names: dict[str, str]) -> Column:
    """Keep where both sides name the same safe speaker in the right clip, reject where they don't and it is the wrong one."""
    speaker = F.regexp_extract(F.coalesce(english, F.lit("")), r"^\s*([A-Z][A-Za-z' .-]{0,30}):", 1)
    own = F.trim(F.regexp_extract(F.coalesce(chinese, F.lit("")), r"^\s*([^：:\s]{1,12})[：:]", 1))
    expected = F.coalesce(*(F.when(F.trim(speaker) == k, F.lit(v)) for k, v in names.items()), F.lit(None).cast("string"))
    wrong = F.coalesce(mismatch, F.lit(False))
    both = (own != "") & expected.isNotNull()
    made = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    return F.when(both & ~wrong & (own == expected), made("keep_current_match", "speaker-safe-keep")).when(both & wrong & (own != expected), made("reject_current_match", "speaker-safe-reject"))


def coarse_decision(queue: Column) -> Column:
    """What is left of both fix queues is kept as it is; other queues go on to the model."""
    return F.when(queue.isin("first_pass_match_fix", "remaining_match_fix"), "keep_current_match")


def predecisions(rows: DataFrame, queue: str = "queue", order: str = "focus_rank") -> DataFrame:
    """Automatic decisions (decision, reason) in the form of responses: custom_id numbers each queue's rows from 1."""
    n = F.row_number().over(Window.partitionBy(queue).orderBy(order))
    made = rows.where("decision is not null").withColumn("custom_id", F.format_string("%s:%05d", F.col(queue), n))
    return made.select("custom_id", "decision", F.lit(1.0).alias("confidence"), F.lit("").alias("suggested_chinese_text"), "reason")


def second_pass(rows: DataFrame) -> DataFrame:
    """Decides rows anew from status, current, english, context, phrase, corrected, garbled and the prior decision and
    confidence: known phrases first, then readings that can be corrected, then garbled ones; else as before."""
    prior, low = _c("prior_decision"), F.col("status") == "matched-low"
    fixed, now = F.trim(_c("corrected")), F.trim(_c("current"))
    has, garbled = fixed != "", F.coalesce("garbled", F.lit(False))
    long_enough = (now == "") | (F.length(fixed) >= F.greatest(F.lit(4), F.length(now) - 3))
    known = F.trim(_c("english")) != ""
    made = lambda d, c, s=F.lit(""): F.struct(F.lit(d).alias("decision"), F.greatest(F.coalesce("prior_confidence", F.lit(0.0)), F.lit(c)).alias("confidence"), s.alias("suggestion"))
    keep, reject, suggest = "keep_current_match", "reject_current_match", "suggest_new_match"
    stays = known & (F.trim(_c("context")) != "") & ~garbled
    decided = (
        F.when(_c("phrase") != "", made(suggest, 0.78, _c("phrase")))
        .when(low & has & long_enough, made(suggest, 0.83, fixed)).when(low & has, made(keep, 0.78)).when(low & garbled, made(reject, 0.82)).when(low, made(keep, 0.72))
        .when((prior == "no_match") & stays, made("no_match", 0.68)).when(prior == "no_match", made("no_match", 0.72))
        .when((prior == keep) & has, made(suggest, 0.84, fixed)).when((prior == keep) & garbled, made(reject, 0.80)).when(prior == keep, made(keep, 0.75))
        .otherwise(made("unsure", 0.0))
    )
    return rows.withColumn("decided", decided)
