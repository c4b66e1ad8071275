"""Centroid clusters, fill-in-the-middle and SentencePiece: against plain Python and the library."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import clusters, fim, pieces
from tidemark.llm.common import utf8_rows
from tidemark.llm.queries import PIECES


def texts(seed=5, n=80):
    rnd = random.Random(seed)
    alphabet = "ab e\n\t<>PSM▁é日本😀ñ 0.5\x00\r\x0b"
    odd = [None, "", "\n", "\n\n\n", " ", "   ", "a", "é", "😀", "a\nb", "a\nb\n", "x<P>y\nz", "<S>", "a <M", "<", "P>\n<", "▁▁a ▁", "日本語のテキスト", "a\r\nb\n", "�\x00x", "<s>a</s> <0x0A>", "word " * 4000, "ж" * 30_000, "no blank" + "x" * 9000]
    return odd + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for _ in range(n)] + ["a\nb", "a\nb"]


def table(spark, rows):
    made = [(i, x, "f", 1, "p") for i, x in enumerate(rows)]
    return spark.createDataFrame(made + [(None, "null\nid", "f", 1, "p"), (3, "again\nonce\n", "f", 1, "p")], "doc_id long, text string, form string, n int, output string").repartition(3)


def cut(key, text, unit):
    h = [int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    parts = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "lines" else list(text)
    a, b = sorted(x % (len(parts) + 1) for x in h[:2])
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(x in text for x in fim.SENTINELS):
        return len(parts), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(parts), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(parts), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["lines", "characters"])
def test_fim_equals_plain_python_and_comes_back(spark, unit):
    docs = table(spark, texts())
    made = fim.transformed(docs, unit=unit).withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    want = sorted((str(r.doc_id), *map(str, cut(r.doc_id, r.text or "", unit)), r.text or "") for r in docs.collect())
    assert sorted((str(r.doc_id), *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.back) for r in made) == want
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_exceptions_convert_both_ways():
    for text in filter(None, texts()):
        raw = np.frombuffer(text.encode(), np.uint8)
        index = fim.Exceptions(raw)
        at = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
        assert np.array_equal(index.chars(at), np.arange(len(text) + 1)) and np.array_equal(index.bytes(np.arange(len(text) + 1)), at)
        assert len(index.at) == sum(ord(c) > 127 for c in text)  # nothing is kept of ASCII


def test_fim_rates_string_ids_and_sentinels(spark):
    docs = spark.createDataFrame([(f"id {i}", f"line {i}\nsecond\nthird") for i in range(200)] + [(None, None)], "doc_id string, text string")
    assert {r.form for r in fim.transformed(docs, rate=0).collect()} == {"plain"}
    some = fim.transformed(docs, rate=50, spm=0, sentinels=("[a]", "[b]", "[c]")).collect()
    assert 50 < sum(r.form == "psm" for r in some) < 150 and all(r.form in ("plain", "psm") for r in some)
    for bad in [("a", "a", "b"), ("aba", "x", "y"), ("ab", "b", "c"), ("", "x", "y")]:
        with pytest.raises(ValueError):
            fim.transformed(docs, sentinels=bad)
    with pytest.raises(ValueError):
        fim.transformed(docs, unit="words")


def test_pieces_equal_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = table(spark, texts())
    want = sorted((str(r.doc_id), str(model.encode(r.text or "")), model.decode(model.encode(r.text or ""))) for r in docs.collect())
    assert sorted((str(r.doc_id), str(r.ids), r.decoded) for r in pieces.encoded(docs, PIECES).collect()) == want


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_words_are_segmented_once_for_each_table(limit):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    segmenter = pieces.Segmenter(PIECES, limit)
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choice("abcdeé日 \n▁") for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    for _ in range(20):
        some = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))) for _ in range(10)]
        data, offsets = utf8_rows(pieces.marked(pa.array(some)))
        ids, bounds = segmenter.encode(data[offsets[0] : offsets[-1]], offsets - offsets[0])
        assert [ids[p:q].tolist() for p, q in zip(bounds, bounds[1:], strict=False)] == [model.encode(x) for x in some]
        assert segmenter.decode(ids, bounds) == [model.decode(model.encode(x)) for x in some]
    if limit > 1:
        assert segmenter.segmented == len(segmenter.slots) < segmenter.asked / 5
    else:
        assert len(segmenter.slots) < segmenter.segmented


def test_models_that_cross_markers_are_refused(monkeypatch):
    segmenter = pieces.Segmenter(PIECES)
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as file:
        proto.ParseFromString(file.read())
    segmenter._check(proto)
    proto.pieces.add(piece="a▁b", type=1)
    with pytest.raises(ValueError):
        segmenter._check(proto)
    del proto.pieces[-1]
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        segmenter._check(proto)


def nearest(v, centroids):
    return min(((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)))


def in_plain_python(rows, k, rounds, size):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    hashed = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda x: (hashed(x[0]), x[1]))[:k]]
    for _ in range(rounds):
        got = [nearest(v, centroids)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, got, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    got = [(i, *nearest(v, centroids)) for i, v in kept]
    per = {j: sum(d for _, d, c in got if c == j) for j in range(len(centroids))}
    return sorted((str(i), j, d, per[j], sum(per.values()), centroids[j]) for i, d, j in got)


@pytest.mark.parametrize(("n", "k"), [(120, 7), (3, 5), (0, 4)])
def test_clusters_equal_plain_python(spark, n, k):
    rnd = random.Random(n)
    vector = lambda: [rnd.choice([-1.5, -0.001, 0.0, 0.3, 0.9]) + rnd.random() for _ in range(4)]
    rows = [(i, vector()) for i in range(n)]
    if n > 100:
        rows += [(i, rows[0][1]) for i in range(200, 240)] + [(5, rows[5][1]), (5, vector()), (None, vector()), (300, None), (301, [1.0]), (302, [1.0, None, 2.0, 3.0])]
        rows += [(303, [math.nan, 1.0, 1.0, 1.0]), (304, [math.inf, 0.0, 0.0, 0.0]), (305, []), (306, vector() + [1.0])]
    table = spark.createDataFrame([(*r, [1], 2, 3) for r in rows], "vec_id long, embedding array<double>, v array<int>, cluster int, dots int").repartition(3)
    made = clusters.clustered(table, k=k, rounds=3, size=4).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in made) == in_plain_python(rows, k, 3, 4)


def test_products_change_by_moved_components_only():
    rnd = np.random.default_rng(1)
    v = rnd.integers(-300, 300, (50, 8))
    before, after = rnd.integers(-300, 300, (6, 8)), None
    after = before.copy()
    after[2, 3] += 5
    after[4] = 0
    assert np.array_equal(clusters.moved(v, v @ before.T, before, after), v @ after.T)
    large = v << 20
    assert np.array_equal(clusters.product(large, large[0]), (large.astype(object) @ large[0].astype(object)).astype(np.int64))


def test_too_large_components_raise(spark):
    table = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="don't fit in a long"):
        clusters.clustered(table, size=2).collect()


def test_empty_tables_and_digest(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, form string")
    assert fim.transformed(docs).collect() == [] and pieces.encoded(docs, PIECES).collect() == []
    one = spark.createDataFrame([([-1, 20, 3],)], "c array<long>").select(clusters.digest("c").alias("d")).first()
    assert one.d == hashlib.sha256(b"-1,20,3").hexdigest()
