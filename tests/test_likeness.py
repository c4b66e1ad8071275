"""Like texts against all pairs."""

import difflib
import random

from tidemark.operators import cleaning, likeness


def words(seed, n):
    rnd = random.Random(seed)
    base = ["小梅：再等一会儿。", "小梅： 父亲在叫我呢", "the quick brown fox", "hello there general", "a", "aa", "aaab", "中文字幕在这里出现了"]
    out = [None, "", *base]
    for _ in range(n):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(t) + 1)
            t[k : k + rnd.randint(0, 1)] = rnd.choice(["x", "。", "a", "梅", ""])
        out.append("".join(t))
    return out


def test_no_pair_is_lost(spark):
    a, b = words(1, 60), words(2, 60)
    left, right = (spark.createDataFrame([(t, i % 2) for i, t in enumerate(x)] + [(x[3], 0)], "text string, g int") for x in (a, b))
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    for threshold in (0.6, 0.86, 1.0):
        got = {(r.text_a, r.text_b): r.ratio for r in likeness.similar_texts(left, right, threshold).collect()}
        want = {(x, y): ratio(x, y) for x in set(a) - {None, ""} for y in set(b) - {None, ""} if ratio(x, y) >= threshold}
        assert got == want
    grouped = {(r.g, r.text_a, r.text_b) for r in likeness.similar_texts(left, right, 0.8, ["g"]).collect()}
    assert grouped == {(k, x, y) for k in (0, 1) for x in {t for i, t in enumerate(a) if i % 2 == k and t} | ({a[3]} if k == 0 else set()) for y in {t for i, t in enumerate(b) if i % 2 == k and t} | ({b[3]} if k == 0 else set()) if ratio(x, y) >= 0.8}
    assert likeness.similar_texts(left.limit(0), right, 0.5).count() == 0


def test_the_ratio_sees_candidates_only(spark):
    """Of unlike texts none reaches the exact ratio."""
    a, b = (spark.createDataFrame([(c * 20 + str(i),) for i in range(20)], "text string") for c in "xy")
    assert likeness.similar_texts(a, b, 0.8).count() == 0


def test_texts_meet_in_all_tasks_and_each_pair_once(spark, monkeypatch):
    """Few bytes, many candidates: neither one task for all, nor a table of them that drops repeated ones."""
    kept = []
    monkeypatch.setattr(likeness, "stored", lambda df: kept.append(df) or df)
    rows = spark.createDataFrame([(t,) for t in {"".join(random.Random(i).choices("abc", k=9)) for i in range(40)}], "text string")
    likeness.similar_texts(rows, rows, 0.8)
    assert kept[-1].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(kept[-1].collect()) == kept[-1].distinct().count() > 40
    assert "keys=[text_a" not in kept[-1]._jdf.queryExecution().executedPlan().toString()


def test_overrides_of_like_texts(spark):
    rows = spark.createDataFrame([(1, "hello there"), (2, "hallo there"), (3, "something else"), (4, None), (5, "hello there")], "k int, text string")
    over = spark.createDataFrame([("hello there!", "v1"), ("hallo there!", "v2"), ("hello there!", "v0"), (None, "v3")], "text string, value string")
    assert {r.k: r.value for r in likeness.like_overrides(rows, over, 0.9).collect()} == {1: "v0", 2: "v2", 3: None, 4: None, 5: "v0"}


def test_bounds_before_the_ratio():
    rnd = random.Random(3)
    texts = [t for t in words(5, 80) if t is not None]
    for _ in range(2000):
        x, y, t = rnd.choice(texts), rnd.choice(texts), rnd.choice([0.5, 0.72, 0.86, 0.99])
        assert cleaning.reaches(x, y, t) == (cleaning.similarity(x, y) >= t)
