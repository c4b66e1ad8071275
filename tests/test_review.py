"""Known cases of text predicates, cue cleaning, matching, records, names, logs and exports."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import cues as C
from tidemark.functions import names as N
from tidemark.operators import align, cleaning, folds, gates, records, sequences
from tidemark.sources import exports, logs

SEC = 1_000_000


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def cues(spark, *items):
    made = [("m", i, int(s * SEC), int(e * SEC), t, float(c)) for i, (s, e, t, c) in enumerate(items)]
    return spark.createDataFrame(made, "m string, pos long, s long, e long, text string, conf double")


def cleaned(spark, *items, **options):
    return [r["text"] for r in cleaning.clean_cues(cues(spark, *items), ["m"], **options).orderBy("index").collect()]


def test_cleaning_cases(spark):
    assert cleaned(spark, (1, 2, "笃：(呼吸起伏)", 1), (1.5, 2.5, "笃： (呼吸起伏)", 1), (3, 3.4, "斋藤匪徒：", 1)) == ["笃：(呼吸起伏)"]
    bridge = [(1, 2, "笃：等会儿吧。", 1), (2, 2.6, "笃：等会儿吧。 笃：母亲催我呢", 1), (2.5, 3.5, "笃：母亲催我呢。", 1)]
    assert cleaned(spark, *bridge) == ["笃：等会儿吧。", "笃：母亲催我呢。"]
    unsure = [(1, 1.8, "斋藤匪徒：让它瞎蹦！", 0.96), (2, 2.8, "客藤匪佳", 0.52), (3, 3.8, "村民：快进屋里去。", 0.99)]
    assert cleaned(spark, *unsure, min_confidence=0.6) == [unsure[0][2], unsure[2][2]]
    assert cleaned(spark, (1, 4, "查看：按住", 0.98), (5, 6.5, "村民：快进屋里去。", 0.99)) == ["村民：快进屋里去。"]
    english = [(1, 2, "OPEN SPYGLASS", 0.98), (3, 4, "YOTEI RIVER", 0.98), (5, 6.5, "Atsu: Time to get their attention.", 0.99)]
    assert cleaned(spark, *english, language="en") == ["Atsu: Time to get their attention."]


def test_dense_clusters_keep_the_best_reading(spark):
    noisy = [(25 + i * 0.5, 25.8 + i * 0.5, t, 0.7 + i / 100) for i, t in enumerate(["匪徒甲乙丙丁。", "天地玄黄宇宙。", "斋藤匪徒：真蠢！", "日月盈昃辰宿。", "寒来暑往秋收。"])]
    got = cleaning.collapse_clusters(cues(spark, *noisy, (60, 62, "村民：快进屋里去。", 0.9)), ["m"])
    quality = {r["text"]: r["q"] for r in cues(spark, *noisy).select("text", C.cue_quality(F.col("text"), F.col("conf"), F.col("e") - F.col("s")).alias("q")).collect()}
    assert rows(got, "text") == sorted([(max(quality, key=quality.get),), ("村民：快进屋里去。",)])
    assert cleaning.collapse_clusters(cues(spark, *noisy[:3]), ["m"]).count() == 3


def test_quality_in_both_forms_is_the_same(spark):
    texts = ["笃：（呼吸起伏）", "Atsu: Time to go (now).", "好", "", "ab,", "你好，世界：", "斋藤匪徒：让它瞎蹦！"]
    df = cues(spark, *[(i, i + 0.7 * i, t, 0.5 + i / 20) for i, t in enumerate(texts)])
    for r in df.withColumn("q", C.cue_quality(F.col("text"), F.col("conf"), F.col("e") - F.col("s"))).collect():
        assert r["q"] == pytest.approx(cleaning._requality(r.asDict()))


def test_prepared_texts(spark):
    one = spark.range(1).select(
        C.prepared_chinese_sequence(F.lit("青木城 笃：走吧。")).alias("a"), C.prepared_chinese_sequence(F.lit("（惊呼）")).alias("b"), C.prepared_english_sequence(F.lit("TASK Atsu: We go now.")).alias("c"),
        C.prepared_english_sequence(F.lit("Atsu: (laughs)")).alias("d"), C.repeated_phrase(F.lit("哈哈 哈哈哈哈")).alias("e"), C.contains_substance(F.lit("笃：走吧。"), F.lit("走吧！")).alias("f"),
        C.speakers_compatible(F.lit("Old Kin: hey"), F.lit("金：嘿"), {"old": "金爷"}).alias("g"), C.speakers_compatible(F.lit("Atsu: hey"), F.lit("金：嘿"), {"atsu": "笃"}).alias("h"), C.clipped(F.lit("a  b cdefgh"), 7).alias("i"),
        C.speakers_disjoint(F.array(F.lit("x")), F.array(F.lit("y"))).alias("j"),
    ).first()
    assert tuple(one) == ("走吧", "", "We go now.", "", True, True, True, False, "a b...", True)


def test_gate_empties_rejected_matches(spark):
    df = spark.createDataFrame([("Atsu: We leave at dawn.", "好", "group-clip-local-v1", 0.6, "matched-low", ["1"]), ("Hello there friend", "你好啊朋友们", "auto", 0.6, "matched-low", ["2"])], "english_text string, chinese_text string, match_origin string, match_score double, status string, chinese_cue_ids array<string>")
    bad, good = gates.gate_matches(df, inline=True).collect()
    assert bad["gate_reasons"] == ["too-short-for-english-length", "speaker-missing-on-short-zh", "short-group-match", "clip-local-speaker-mismatch"]
    assert (bad["status"], bad["match_score"], bad["chinese_text"], bad["chinese_cue_ids"]) == ("unmatched", None, "", []) and good["status"] == "matched-low"


def test_risk_value_and_speakers(spark):
    one = spark.range(1).select(
        gates.match_risk(F.lit(True), F.lit("needs-review-low"), F.lit("group-clip-local-v1"), F.lit("好"), F.lit(0.5)).alias("a"), gates.unmatched_value(F.lit("预览文本"), F.lit("x"), F.lit(""), F.lit("one two three four"), F.lit(2.5)).alias("b"),
        gates.speaker_decision(F.lit("Atsu: hey"), F.lit("笃：嘿"), F.lit(False), {"Atsu": "笃"})["decision"].alias("c"), gates.speaker_decision(F.lit("Atsu: hey"), F.lit("金：嘿"), F.lit(True), {"Atsu": "笃"})["decision"].alias("d"),
        gates.low_value_reason(F.lit("needs-review-unmatched"), F.lit("OPEN MAP"), F.lit(""), F.lit("")).alias("e"), gates.junk_reason(F.lit("unmatched"), F.lit("Loading..."), ["skip"], ["loading"], 3).alias("f"), gates.auto_status(F.lit(0.9), F.lit(0.5)).alias("g"),
        gates.coarse_decision(F.lit("remaining_match_fix")).alias("h"),
    ).first()
    assert one["a"] == pytest.approx(6 + 4 + 3 + 3 + 2.5 + 2) and one["b"] == pytest.approx(0.2 + 1 + 0.8 + 0.6 + 0.3)
    assert tuple(one)[2:] == ("keep_current_match", "reject_current_match", "empty-english-semantic", "junk-substring", "matched-medium", "keep_current_match")
    df = spark.createDataFrame([("q", 2, "keep_current_match", "r"), ("q", 1, "reject_current_match", "s"), ("q", 3, None, None)], "queue string, focus_rank int, decision string, reason string")
    assert rows(gates.predecisions(df), "custom_id", "decision") == [("q:00001", "reject_current_match"), ("q:00002", "keep_current_match")]
    df = spark.createDataFrame([("manual-replacement", 2, 1), ("auto", 2, 1), (None, 1, 1)], "selection_mode string, n_english int, n_chinese int")
    assert [(r["reasons"], r["actionable"]) for r in gates.cue_review(df).collect()] == [(["manual-replacement", "structural_compression"], False), (["structural_compression"], True), ([], False)]


def test_greedy_subset_and_search(spark):
    pairs = spark.createDataFrame([("g", 1, 5, 0.9, 0.0), ("g", 1, 2, 0.9, 0.1), ("g", 2, 2, 0.99, 0.0), ("g", 2, 3, 0.5, 0.0), ("g", 3, 1, 1.0, 0.0)], "g string, segment long, cue long, score double, context double")
    assert rows(align.greedy_pairs(pairs, ["g"]), "segment", "cue") == [(1, 2), (2, 3)]
    one = spark.createDataFrame([([1.0, 0.0], 1.0, 1, [[0.0, 1.0], [1.0, 0.0], [0.9, 0.1]], [0.0, 1.0, 2.0], [1.0, 2.0, 3.0])], "vector array<double>, duration double, least int, vectors array<array<double>>, starts array<double>, ends array<double>")
    best = align.best_subset(one).first()["best"]
    assert (best["first"], best["last"]) == (1, 1) and best["score"] == pytest.approx(0.95)
    rnd = np.random.RandomState(1)
    choices = [("g", p, k, float(rnd.rand())) for p in range(4) for k in range(3)]
    got = align.assignment_search(spark.createDataFrame(choices, "g string, pos long, part long, score double"), ["g"], 5).orderBy("rank").collect()
    score = {(p, k): x for _, p, k, x in choices}
    every = sorted((-sum(score[i, k] for i, k in enumerate(path)), path) for path in itertools.combinations_with_replacement(range(3), 4))[:5]
    assert [tuple(r["parts"]) for r in got] == [p for _, p in every]


def test_bounds_spans_and_fills(spark):
    blocks = spark.createDataFrame([("g", "b1", 3, 4, 2, 3, 10), ("g", "b2", 8, 9, 0, 1, 10)], "g string, block string, first long, last long, est_first long, est_last long, total long")
    anchors = spark.createDataFrame([("g", 1, 1, 1), ("g", 6, 6, 7), ("g", 5, None, None)], "g string, pos long, lo long, hi long")
    assert rows(align.anchored_bounds(blocks, anchors, ["g"], 3), "block", "lower", "upper") == [("b1", 2, 6), ("b2", 0, 5)]
    cue = spark.createDataFrame([("g", p, p == 3, float(p), p + 1.0, [1.0, 0.0] if p == 2 else [0.6, 0.8]) for p in range(6)], "g string, pos long, used boolean, s double, e double, vector array<double>")
    block = spark.createDataFrame([("g", "b", 1, 6, 2, 2, 1.0, [1.0, 0.0])], "g string, block string, lower long, upper long, est_first long, est_last long, duration double, vector array<double>")
    found = align.span_candidates(block, cue, ["g"], 2, 9).collect()
    assert (found[0]["pos"], found[0]["n"]) == (2, 1) and {(r["pos"], r["n"]) for r in found} == {(1, 1), (2, 1), (1, 2), (4, 1), (5, 1), (4, 2)}
    side = lambda flags: spark.createDataFrame([("g", i, f) for i, f in enumerate(flags)], "g string, pos long, matched boolean")
    assert rows(align.fill_gaps(side([True, False, False, True]), side([True, False, True, False]), ["g"], 2, 0.2, "x"), "a_pos", "b_pos") == [(1, 1)]
    assert rows(align.fill_tail(side([False] * 3), side([True] * 5), ["g"], 0.1, "x"), "a_pos", "b_pos") == [(0, 0), (1, 2), (2, 4)]
    spaced = spark.range(1).select(*(align.spaced_indices(F.lit(n), F.lit(k)).alias(f"x{i}") for i, (n, k) in enumerate([(10, 4), (3, 5), (5, 1), (0, 2)]))).first()
    assert tuple(spaced) == ([0, 3, 6, 9], [0, 1, 2], [0], [])
    b = spark.createDataFrame([("g", "a", i) for i in range(5)], "g string, block string, pos long")
    assert rows(align.split_blocks(b, ["g"], 2), "block", "pos") == [("a_sub01", 0), ("a_sub01", 1), ("a_sub02", 2), ("a_sub02", 3), ("a_sub03", 4)]


def test_stages_share_no_rows(spark):
    side = spark.createDataFrame([("g", i) for i in range(5)], "g string, pos long")
    reserved = spark.createDataFrame([("g", 0, 4, 1.0)], "g string, a_pos long, b_pos long, score double")
    same = lambda a, b: a.join(b.withColumnRenamed("pos", "p2"), "g").where("abs(pos - p2) <= 1").select("g", F.col("pos").alias("a_pos"), F.col("p2").alias("b_pos"), (1.0 - 0.1 * F.abs(F.col("pos") - F.col("p2"))).alias("score"))
    got = align.staged(side, side, ["g"], reserved, [("first", same), ("second", same)]).collect()
    assert len({r["a_pos"] for r in got}) == len({r["b_pos"] for r in got}) == len(got) and {r["origin"] for r in got} == {"reserved", "first"}  # what is left is too far apart
    swept = align.sweep(side, [{"n": 1}, {"n": 3}], lambda df, n: df.where(F.col("pos") < n), [F.count(F.lit(1)).alias("found")], [F.col("found").desc()])
    assert [(r["combo"], r["found"]) for r in swept.collect()] == [(1, 3), (0, 1)]


def test_ingest_names_every_outcome(spark):
    requests = spark.createDataFrame([("r1", ""), ("r2", "a"), ("r2", "b"), ("r3", ""), ("r4", "")], "custom_id string, row_id string")
    lines = [
        {"custom_id": "r1", "output_text": 'so {"decision": "keep_current_match", "confidence": 0.9}'},
        {"custom_id": "r2", "response": {"choices": [{"message": {"content": '{"rows": [{"id": "a", "decision": "unsure"}, {"id": "z", "decision": "unsure"}]}'}}]}},
        {"custom_id": "r3", "content": "no json"}, {"custom_id": "r9", "content": "{}"}, {"content": "{}"},
        {"custom_id": "r4", "response": {"output": [{"content": [{"text": '{"decision":'}, {"text": '"no_match"}'}]}]}},
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")
    got = rows(records.ingest(requests, logs.replies(df)), "custom_id", "row_id", "state", "decision")
    assert got == sorted([("", "", "missing-custom-id", ""), ("r1", "", "ok", "keep_current_match"), ("r2", "a", "ok", "unsure"), ("r2", "b", "group-row-missing:b", ""), ("r2", "b", "missing-response", ""), ("r2", "z", "group-row-id-not-found:z", "unsure"),
                          ("r3", "", "missing-response", ""), ("r3", "", "unparseable-response-json", ""), ("r4", "", "ok", "no_match"), ("r9", "", "custom-id-not-found", "")])


def test_review_patches_split_and_revise(spark):
    base = spark.createDataFrame([("a", 0, 10, "x"), ("b", 10, 20, "y"), ("c", 20, 30, "z")], "id string, s long, e long, text string")
    patches = spark.createDataFrame(
        [(1, "a", "revised", {"text": "X", "e": "12", "id": "no"}, None, "n1"), (2, "a", "revised", {"text": "XX"}, None, "n2"), (3, "b", "split", None, [(10, 15, "y1"), (15, 20, None)], "n3"), (4, "c", "pending", None, None, "")],
        "pos int, id string, decision string, revised map<string,string>, splits array<struct<s:long,e:long,text:string>>, notes string",
    )
    got = rows(records.review_patches(base, patches, "id", ["text", "e"]), "id", "s", "e", "text", "duration", "review_status")
    assert got == [("a", 0, 12, "XX", 12, "revised"), ("b", 10, 20, "y", 10, "superseded-by-split"), ("b__s01", 10, 15, "y1", 5, "split-derived"), ("b__s02", 15, 20, "y", 5, "split-derived"), ("c", 20, 30, "z", 10, "baseline")]
    with pytest.raises(Exception, match="missing segment: q"):
        records.review_patches(base, patches.withColumn("id", F.lit("q")), "id", ["text"]).collect()


def test_small_records(spark):
    base = spark.createDataFrame([(1, "unmatched", "p"), (2, "matched", "p"), (3, "unmatched", "q")], "k int, status string, text string")
    overlays = spark.createDataFrame([(1, 1, 0, "o", 0.9), (1, 2, 1, "o", 0.9), (2, 1, 2, "o", 0.9), (3, 1, 3, "x", 0.9), (4, 1, 4, "o", 0.9)], "k int, rule int, pos int, match_origin string, score double")
    rule = spark.createDataFrame([(1, ["o"], 0.5), (2, ["o"], 0.5)], "rule int, origins array<string>, least double")
    assert rows(records.overlay_rules(base, overlays, ["k"], rule), "k", "rule", "outcome") == [(1, 1, "applied"), (1, 2, "later-overlay"), (2, 1, "base-matched"), (3, 1, "origin-not-listed"), (4, 1, "not-in-base")]
    many = spark.createDataFrame([(2, [("p1",), ("p2",)]), (3, [])], "k int, items array<struct<text:string>>")
    assert rows(records.replace_many(base, many, "k", "items"), "k", "text", "piece") == [(1, "p", 0), (2, "p1", 1), (2, "p2", 2)]
    by_key, by_text = spark.createDataFrame([(1, "K")], "k int, new_text string"), spark.createDataFrame([("p", "T")], "old_text string, new_text string")
    assert rows(records.row_overrides(base, by_key, by_text, ["k"], "text").fillna("-"), "k", "text", "overridden") == [(1, "K", "key"), (2, "T", "text"), (3, "q", "-")]
    names = spark.createDataFrame([("round2",), ("round10",), ("other",)], "n string")
    assert records.next_round(names, "n", "round").first()["name"] == "round11"
    assert records.exit_code(spark.createDataFrame([("Success",), ("Failed",)], "s string"), "s").first()["code"] == 1
    got = spark.range(1).select(*(records.atempo_factors(F.lit(x)).alias(f"f{i}") for i, x in enumerate([5.0, 0.2, 1.0, 4.0]))).first()
    assert [list(x) for x in got] == [[2.0, 2.0, 1.25], [0.5, 0.5, pytest.approx(0.8)], [1.0], [2.0, 2.0]]
    cards = records.context_cards(spark.createDataFrame([("g", 1, 2, 3)], "g string, card int, first long, last long"), spark.createDataFrame([("g", i, f"t{i}") for i in range(6)], "g string, pos long, text string"), ["g"], 1)
    assert rows(cards, "pos", "role") == [(1, "before"), (2, "focus"), (3, "focus"), (4, "after")]
    hits, misses = logs.cached(spark.createDataFrame([("a",), ("b",), ("c",)], "x string"), spark.sql("select sha2(k, 256) as key, v as value, timestamp'2024-01-01' + make_dt_interval(d) as stored_at from values ('a', 1, 20), ('b', 2, 1) as t(k, v, d)"), F.col("x"), F.lit("2024-01-30").cast("timestamp"))
    assert rows(hits, "x") == [("a",)] and rows(misses, "x") == [("b",), ("c",)]
    kept = records.with_defaults(spark.createDataFrame([(0, "x"), (5, None)], "n int, t string"), {"n": (3, lambda c: c > 0), "t": ("d", lambda c: c.isNotNull()), "u": (1, lambda c: c.isNotNull())})
    assert rows(kept, "n", "t", "u") == [(3, "x", 1), (5, "d", 1)]
    assert records.one_row_report({"a": base.groupBy().count(), "b": base.groupBy().count()}).first().asDict() == {"a_count": 3, "b_count": 3}


def test_names_and_titles(spark):
    names = ["[SubsPlease] Sousou no Frieren - 03 (1080p) [A1B2C3D4].mkv", "葬送的芙莉莲 第2季 第05话.mkv", "[G][H] Some.Show S02E07.mkv", "Show 2nd Season - 11v2 [x265].mkv", "Ｓｈｏｗ　Ａ [04].mkv", "nothing here.mkv"]
    got = [r["x"] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, p string").orderBy("i").select(N.file_name_parts(F.col("p")).alias("x")).collect()]
    assert [(x["raw_title"], x["normalized_title"], x["season"], x["episode"]) for x in got[:5]] == [("Sousou no Frieren", "sousou no frieren", None, 3), ("葬送的芙莉莲", "葬送的芙莉莲", 2, 5), ("Some Show", "some show", 2, 7), ("Show", "show", 2, 11), ("Ｓｈｏｗ　Ａ", "show a", None, 4)]
    assert got[5] is None and got[3]["search_keyword"] == "Show 2nd Season Season 2"
    q = spark.createDataFrame([("k", "some show", "some show season 2")], "k string, title_form string, keyword_form string")
    c = spark.createDataFrame([("k", 1, "Some Show 中配", "some show", "", 12), ("k", 2, "Some Show", "some show", "", 3), ("k", 3, "Other", "other show", "", 60)], "k string, season_id long, title string, title_form string, original_form string, episodes int")
    assert tuple(N.best_titles(q, c, "k").first()) == ("k", 2, "Some Show", 321)
    entries = spark.createDataFrame([("e1", 0, ["some"], ""), ("e2", 1, ["some show"], "")], "entry string, pos int, titles array<string>, keyword string")
    assert N.local_mapping(q, entries, "k").first()["entry"] == "e2"
    eps = spark.createDataFrame([(9, 0, 0, 1, 11, 101, "第1话", "", ""), (9, 1, 0, 2, 12, 102, "第2话", "Finale", ""), (9, 2, 1, 3, 13, 103, "SP", "", "")], "season_id long, pos int, section int, number int, cid long, episode_id long, show_title string, long_title string, share_copy string")
    over = spark.createDataFrame([("c", 3, 77, None, None), ("d", 4, None, None, "finale"), ("f", 5, None, 101, None)], "k string, episode int, cid long, episode_id long, title_contains string")
    asked = spark.createDataFrame([("a", 9, 2), ("b", 9, 3), ("c", 9, 3), ("d", 9, 4), ("f", 9, 5)], "k string, season_id long, episode int")
    assert [(r["k"], r["cid"], r["rule"]) for r in N.episode_of(asked, eps, over, "k").orderBy("k").collect()] == [("a", 12, "number"), ("b", None, "not-found"), ("c", 77, "override-cid"), ("d", 12, "override-title"), ("f", 11, "override-id")]


def test_logs(spark, tmp_path):
    lines = lambda *x: spark.createDataFrame([("m", i, v) for i, v in enumerate(x)], "m string, n int, value string")
    assert rows(logs.scene_cuts(lines("pts_time:1.5 x", "none", "pts_time:-0.2"), ["m"]), "t") == [(0,), (1_500_000,)]
    assert rows(logs.black_segments(lines("black_start:1 black_end:2.5 black_duration:1.5", "black_start:1"), ["m"]), "s", "e", "dur") == [(SEC, 2_500_000, 1_500_000)]
    assert rows(logs.freeze_segments(lines("freeze_start: 1", "freeze_end: 3", "freeze_duration: 2", "freeze_end: 4 freeze_duration: 1", "freeze_end: 9 freeze_duration: 2"), ["m"], "n"), "s", "e") == [(SEC, 4 * SEC), (7 * SEC, 9 * SEC)]
    level = "lavfi.astats.Overall.RMS_level="
    samples = logs.volume_samples(lines("pts_time:1", level + "-20.5", level + "-3", "pts_time:2", "pts_time:3", level + "-inf"), ["m"], "n")
    assert rows(samples, "t", "level") == [(SEC, -20.5), (3 * SEC, float("-inf"))]
    assert rows(logs.volume_windows(samples, ["m"], 2 * SEC), "s", "mean_db") == [(0, -20.5), (2 * SEC, float("-inf"))]
    assert rows(logs.voice_segments(lines("VAD segment 0: start = 1.5, end = 2", "VAD segment 1: start = 3, end = 3"), ["m"]), "s", "e") == [(1_500_000, 2 * SEC)]
    done = logs.progress(lines("out_time_us=500000", "speed=2x", "out_time=00:00:03.0", "out_time_ms=1500"), ["m"], "n", F.lit(2 * SEC))
    assert rows(done.fillna("-"), "n", "percent", "speed") == [(0, 25.0, "-"), (2, 100.0, "2x"), (3, 75.0, "2x")]
    probe = json.dumps({"format": {"size": "12", "duration": "1.5"}, "streams": [{"index": 1, "codec_type": "audio", "codec_name": "aac", "channels": 2, "sample_rate": "x", "disposition": {"default": 1}}, {"index": 2, "codec_type": "subtitle", "tags": {"language": "chi"}}]})
    r = logs.probes(lines(probe)).first()
    assert (r["size"], r["duration"], r["audio"][0]["is_default"], r["audio"][0]["sample_rate"], r["subtitles"][0]["language"]) == (12, 1_500_000, True, 0, "chi")
    heard = json.dumps({"transcription": [{"offsets": {"from": 0, "to": 1250}, "text": " hello"}, {"offsets": {"from": 1250, "to": 2500}, "text": " world"}]})
    assert rows(logs.whisper_segments(lines(heard), ["m"]), "seg_id", "s", "e", "text") == [("seg_001", 0, 1_250_000, "hello"), ("seg_002", 1_250_000, 2_500_000, "world")]
    hit = json.dumps({"code": 0, "data": {"result": [{"season_id": 0, "media_id": 7, "title": "<em>A</em> b", "ep_size": 3}]}})
    assert rows(logs.search_results(lines(hit, '{"code": 1}'), ["m"]), "season_id", "title", "episodes") == [(7, "A b", 3)]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert rows(logs.json_lines(spark, str(tmp_path / "x.jsonl"), "a int"), "a") == [(1,), (2,)]
    (tmp_path / "c.xml").write_text("<i><d p='1'>x</d><d/><dd/></i>")
    assert logs.tag_count(spark, str(tmp_path / "c.xml")).first()["n"] == 2
    vectors = logs.embedded(spark.createDataFrame([(0, "a"), (1, "b"), (2, "b")], "pos int, text string"), spark.createDataFrame([("a", [1.0])], "text string, vector array<double>"), lambda df: df.select("text", F.array(F.lit(2.0)).alias("vector")))
    assert rows(vectors, "pos", "vector") == [(0, [1.0]), (1, [2.0]), (2, [2.0])]


def test_exports(spark):
    doc = json.loads(exports.cues_json(cues(spark, (1, 2.5, "你好 | x", 0.123456)), ["m"]).first()["json"])
    assert doc["cue_count"] == 1 and doc["cues"][0] == {"id": "cue_00001", "index": 1, "start": 1.0, "end": 2.5, "duration": 1.5, "text": "你好 丨 x", "confidence": 0.1235}
    com = spark.createDataFrame([("m", 0, 1_200_000, 1, 16777215, "first"), ("m", 1, 2_400_000, 5, 255, "to{p}"), ("m", 2, 2_000_000, 4, 0, "low")], "m string, pos long, at long, mode int, color int, content string")
    laid = exports.ass_lines(folds.allocate_lanes(com, ["m"], folds.lane_counts(40, True, True)), 40, True, True)
    line = {r["pos"]: r["line"] for r in laid.collect()}
    assert "0:00:01.20" in line[0] and "\\move(2044,36,-124,36)" in line[0] and "\\an8\\pos(960,36)" in line[1] and "\\c&HFF0000&" in line[1] and "to｛p｝" in line[1] and "\\an2\\pos(960,520)" in line[2]
    whole = exports.ass_document(laid, ["m"], "A,b", 40).first()["ass"]
    assert whole.startswith("[Script Info]\n") and "Style: Danmaku,Ab,40," in whole and whole.count("Dialogue:") == 3
    kept = spark.createDataFrame([("m", 0, 100_000), ("m", SEC, 2 * SEC)], "m string, s long, e long")
    assert exports.keep_graph(kept, ["m"]).first()["graph"] == "[0:a]atrim=start=0:end=0.1,asetpts=PTS-STARTPTS[a1];[0:a]atrim=start=1:end=2,asetpts=PTS-STARTPTS,afade=t=in:st=0:d=0.05,afade=t=out:st=0.95:d=0.05[a2];[a1][a2]concat=n=2:v=0:a=1[out]"
    table = spark.createDataFrame([("m", 1, "a\tb"), ("m", 0, None)], "m string, k int, x string")
    assert exports.tsv_text(table, ["m"], "k", ["k", "x", "y"]).first()["tsv"] == "﻿k\tx\ty\n0\t\t\n1\ta b\t\n"
    assert exports.history_text(table, ["m"], "k", ["k", "x"]).first()["history"] == "1 | a\tb\n0 | -"


def test_sequences_of_texts(spark):
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate(["I was", "I was there", "there.", "", "Go"])], "g string, k int, text string")
    assert sequences.joined_fragments(df, ["g"], "k", "text").first()["text"] == "I was there Go"
    assert sequences.signature(df, ["g"], "k", "text", 2, 100).first()["signature"] == "I was I was there there. Go"
