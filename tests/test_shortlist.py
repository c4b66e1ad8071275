"""Known cases of inspection, review rounds, shortlists and probes."""

from pyspark.sql import functions as F

from tidemark.operators import shortlist


def test_frames_are_named_by_their_faults(spark):
    frames = spark.createDataFrame([(39.9, 18.0, True), (40.0, 17.9, True), (216.0, 30.0, True), (10.0, 1.0, True), (215.0, 18.0, True), (10.0, 1.0, False), (None, None, True), (90.0, 40.0, None)], "luma double, contrast double, found boolean")
    got = [tuple(r["x"]) for r in frames.select(shortlist.frame_inspection(F.col("luma"), F.col("contrast"), F.col("found")).alias("x")).collect()]
    assert got == [("偏暗", True), ("低对比度", True), ("偏亮", True), ("需关注", True), ("正常", False), ("缺失", True), ("正常", False), ("缺失", True)]


def test_actions_and_rounds(spark):
    df = spark.createDataFrame([("anchor-fallback", ["partial-segment"]), ("auto", ["accepted-low-score", "partial-segment"]), ("auto", ["accepted-low-score"]), (None, []), ("manual-replacement", [])], "mode string, tags array<string>")
    action = shortlist.recommended_action(F.col("mode"), F.col("tags"))
    got = [tuple(r) for r in df.select(action, shortlist.review_round(action)).collect()]
    assert got == [
        ("confirm_anchor_alignment", "round_c_anchor"), ("confirm_partial_alignment", "round_d_partial"), ("spot_check_low_score", "round_e_low_score"),
        ("general_review", "round_z_misc"), ("check_compression_or_omission", "round_a_compression"),
    ]


def test_gates_of_the_shortlist(spark):
    names = {"atsu": "笃", "kin": "金"}
    rows = [
        ("c", "alone", 0, 0.60, 2, 2, "Atsu: hey", "笃：嘿"), ("c", "close", 1, 0.60, 2, 2, "", "x"), ("c", "close", 2, 0.58, 2, 2, "", "y"), ("c", "large", 3, 0.9, 7, 2, "", "x"), ("c", "low", 4, 0.53, 2, 2, "", "x"),
        ("c", "other", 5, 0.7, 2, 2, "Atsu: hey", "金：嘿"), ("c", "more", 6, 0.7, 2, 2, "Atsu: hey", "笃：嘿 金：嗯"), ("c", "few", 7, 0.7, 2, 2, "Atsu: a Kin: b", "笃：一 甲：二 乙：三"), ("c", "label", 8, 0.7, 2, 2, "", "青木·城"), ("c", "second", 9, 0.7, 5, 4, None, None),
    ]
    judged = shortlist.judged_candidates(spark.createDataFrame(rows, "clip string, block string, pos int, score double, n_english int, n_chinese int, english_text string, chinese_text string"), ["clip", "block"], names)
    got = {r["block"]: (r["priority"], r["skipped"]) for r in judged.collect()}
    assert got == {
        "alone": ("high", None), "close": ("high", "low-score-gap"), "large": (None, "size-limit"), "low": (None, "score-threshold"), "other": ("high", "speaker-disjoint"),
        "more": ("high", "speaker-multi-mismatch"), "few": ("high", "speaker-low-overlap"), "label": ("high", "label-fragment"), "second": ("medium", None),
    }
    assert [r["block"] for r in shortlist.shortlisted(judged, ["clip"], "block").orderBy("rank").collect()] == ["alone", "second"]
    assert [r["block"] for r in shortlist.shortlisted(judged, ["clip"], "block", 1).collect()] == ["alone"]


def test_margins_of_the_assigned_part(spark):
    scores = spark.createDataFrame([("a", "p1", "p1", 0.58), ("a", "p2", "p1", 0.5), ("b", "p1", "p1", 0.5), ("b", "p2", "p1", 0.52), ("b", "p3", "p1", 0.1), ("c", "p1", "p1", 0.9), ("d", "p2", "p1", 0.9)], "clip string, part string, own string, score double")
    got = {r["clip"]: (r["margin"], r["status"]) for r in shortlist.part_probe(scores, ["clip"], "part", "own").collect()}
    assert got == {"a": (0.08, "stable"), "b": (-0.02, "ambiguous"), "c": (None, None), "d": (None, None)}
