"""The corpus operators' methods against versions written out in plain Python, and odd inputs."""

import collections
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, common, components, fingerprint, language, minhash, mixing, pii, quality, suffix, toxicity, warc
from tidemark.llm.common import shared_dir, spent, stored
from tidemark.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def ids(rows):
    return {r["doc_id"]: r for r in rows}


def test_viterbi_equals_enumeration():
    """Short disguised words: the best of all ways to read each character."""
    rnd = np.random.RandomState(3)
    counts = rnd.randint(0, 30, (28, 28, 28)) * (rnd.rand(28, 28, 28) < 0.3)
    restorer = toxicity.Restorer(counts)
    code = lambda x: ord(x) - 96 if "a" <= x <= "z" else 27

    def score(ways):
        total, p, q = 0.0, 0, 0
        for x, cost in ways:
            if x.startswith(" "):  # a new word, which only comes after a letter
                total = total + restorer.logs[p][q][0] - toxicity.BREAK if q else -math.inf
                p, q, x = 0, 0, x[1:]
            if x:
                total, p, q = total - cost + restorer.logs[p][q][code(x)], q, code(x)
            else:
                total -= cost + 1.5
        return total + restorer.logs[p][q][0]

    for word in ("st0p", "b@d", "5.a.d", "aaab", "l1fe", "no-w", "h3ll0", "$1ck"):
        options = [restorer.options(word, i) for i in range(len(word))]
        options = [found + [(" " + x, cost) for x, cost in found if x] for found in options]
        every = [(score(ways), "".join(x for x, _ in ways)) for ways in itertools.product(*options)]
        assert restorer.restore(word) in {w for s, w in every if math.isclose(s, max(every)[0], rel_tol=1e-9)}


def grams(text):
    """1- to 3-grams of a text's lower-case words with blanks around them, as strings."""
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text).split()
    out = collections.Counter()
    for w in words:
        padded = f" {w} "
        for k in (1, 2, 3):
            for i in range(len(padded) - k + 1):
                g = padded[i : i + k]
                if g.strip() and not (k == 3 and g[0] != " " and g[2] == " " and False):
                    out[g] += 1
    return out


def test_out_of_place_distance_in_plain_python(spark):
    rnd = random.Random(5)
    parts = {"xx": ["ka", "lo", "mi", "zu"], "yy": ["sch", "ung", "ei", "ka"], "zz": ["да", "не", "то"]}
    text = lambda p: " ".join("".join(rnd.choice(parts[p]) for _ in range(rnd.randint(1, 3))) for _ in range(30))
    rows = [(i, text(p), p) for i, p in enumerate(list(parts) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    profiles = language.learn(docs, profile=60)
    assert list(profiles) == sorted(parts) and all(len(p) == 60 or len(p) < 60 for p in profiles.values())
    # an n-gram's key as the operator packs it: its length and its letters' codes
    key = {}
    for _, t, _ in rows:
        raw = t.encode()
        found = language.gram_counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for g, n in zip(found[1].tolist(), found[2].tolist(), strict=True):
            key.setdefault(g, 0)
            key[g] += n
    counted = collections.Counter()
    for _, t, p in rows:
        raw = t.encode()
        _, g, n, _ = language.gram_counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for a, b in zip(g.tolist(), n.tolist(), strict=True):
            counted[p, a] += b
    for p, profile in profiles.items():
        want = sorted((g for q, g in counted if q == p), key=lambda g: (-counted[p, g], g))[:60]
        assert profile.tolist() == want
    longest = max(map(len, profiles.values()))
    got = ids(language.identify(docs, profiles, own=40).collect())
    for i, t, _ in rows:
        raw = t.encode()
        _, g, n, _ = language.gram_counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        own = sorted(zip(g.tolist(), n.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:40]
        rank = {p: {g: k for k, g in enumerate(profile.tolist())} for p, profile in profiles.items()}
        cost = {p: sum(abs(rank[p][g] - k) if g in rank[p] else longest for k, (g, _) in enumerate(own)) for p in profiles}
        best = min(sorted(cost), key=cost.__getitem__)
        second = sorted(cost.values())[1]
        assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx((second - cost[best]) / max(second, 1))


def water_filled(budget, weights, room):
    """Shares by raising a level in small steps: an independent way to the same split, up to rounding."""
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(r, w * mid) for w, r in zip(weights, room, strict=True)) < budget else (lo, mid)
    return [min(r, w * lo) for w, r in zip(weights, room, strict=True)]


def test_budgets_and_prefixes_equal_water_filling(spark):
    rnd = random.Random(11)
    for _ in range(200):
        n = rnd.randint(1, 7)
        weights, room = [rnd.choice([0.5, 1.0, 2.5]) for _ in range(n)], [rnd.randint(0, 60) for _ in range(n)]
        budget = rnd.randint(0, 150)
        got = mixing.split_budget(budget, list(zip(weights, room, strict=True)))
        want = water_filled(min(budget, sum(room)), weights, room)
        assert sum(got) == min(budget, sum(room)) and all(abs(g - w) <= 1.000001 and g <= r for g, w, r in zip(got, want, room, strict=True))
    rows = [(i, " ".join(["w"] * rnd.randint(0, 9)), rnd.choice(["en", "de"]), rnd.choice(["a1", "a2"])) for i in range(3000)]
    rows += [(None, "null id one", "en", "a1"), (None, "null id two two", "en", "a1"), (5, "same id other text", "en", "a1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    tree = mixing.Node(children={"": mixing.Node(children={x: mixing.Node(w, {s: mixing.Node() for s in ("a1", "a2")}) for x, w in (("en", 3.0), ("de", 1.0))})})
    size = {(i, t): len(t.split()) for i, t, *_ in rows}
    for budget in (900, 7000, 21_000):
        got = mixing.mixed(docs, tree, budget, F.lit(None).cast("string"), seed=9).collect()
        capacity = collections.Counter()
        for i, t, x, s in rows:
            capacity["", x, s] += size[i, t] * 2
        shares = mixing.leaf_budgets(tree, dict(capacity), budget)
        order = {(r["doc_id"], r["text"], e): r[f"h{e}"] for r in docs.select("doc_id", "text", *(F.xxhash64(F.lit(9), F.lit(e).cast("long"), F.xxhash64("doc_id", "text")).alias(f"h{e}") for e in (0, 1))).collect() for e in (0, 1)}
        for leaf, share in shares.items():
            mine = [(i, t) for i, t, x, s in rows if (x, s) == leaf[1:] and size[i, t]]
            whole, rest = divmod(share, sum(size[k] for k in mine))
            n_buckets = 1 + sum((x, s) == leaf[1:] for *_, x, s in rows) // mixing.BUCKET_ROWS
            place = lambda k: (((order[*k, whole] & (1 << 64) - 1) >> 20) % n_buckets, order[*k, whole])  # noqa: B023, E731
            want = [(*k, e) for e in range(whole) for k in mine]
            for k in sorted(mine, key=place) if rest else []:
                rest -= size[k]
                if rest < 0:
                    break
                want.append((*k, whole))
            assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"], r["epoch"])) for r in got if (r["lang"], r["source"]) == leaf[1:])


def test_fingerprint_digits_in_plain_python(spark):
    """Bins, densification and low bits from the shingles' hashes, one by one."""
    texts = ["one two three four five six seven eight nine ten", "a b", "x " * 40, " ".join(map(str, range(900)))]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    borrowed = {(i, j): None for i in range(128) for j in range(128)}
    pairs = spark.range(128 * 128).select((F.col("id") / 128).cast("long").alias("i"), (F.col("id") % 128).alias("j"))
    for r in pairs.select("i", "j", F.xxhash64("i", "j").alias("h")).collect():
        borrowed[r["i"], r["j"]] = r["h"]
    for r in docs.select("text", fingerprint.shingles(F.col("text")).alias("s"), fingerprint.digits(F.col("text")).alias("d")).collect():
        least = {}
        for h in sorted(r["s"]):
            least.setdefault((h & (1 << 64) - 1) >> 57, h)
        want = []
        for i in range(128):
            if i in least:
                want.append(least[i] & 15)
            else:  # the filled bin whose hash with this bin is least; its low bits decide between equal high bits
                want.append(min((borrowed[i, j] & ~15) | (h & 15) for j, h in least.items()) & 15)
        assert r["d"] == want


def test_neighbours_at_any_distance(spark, monkeypatch):
    """Next documents where ids repeat, are null, far apart or very unevenly spread, with cells of a few rows."""
    monkeypatch.setattr(fingerprint, "CELL_BYTES", 64)
    rnd = random.Random(2)
    rows = [(i, f"text {i}") for i in range(40)] + [(2**62, "far"), (-(2**62), "near"), *((None, f"none {i}") for i in range(30)), *((7, f"seven {i}") for i in range(30))]
    rnd.shuffle(rows)
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], hashes[r[1]]), reverse=True)
    edited = {}
    for (key, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        third = len(t) // 3
        edited[key, len(t)] = edited.get((key, len(t)), []) + [t[: len(t) - third] + following[:third]]
    import hashlib

    want = sorted((str(k), hashlib.sha256(x.encode()).hexdigest()) for (k, _), xs in edited.items() for x in xs)
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == want


def pattern_scores(edges, rounds, sure, seeds):
    """The graph's scores in plain Python. edges: (pattern, rank, value, seed)."""
    score = {}
    for _, k, v, s in edges:
        score[k, v] = max(score.get((k, v), 0.0), float(s))
    every = collections.defaultdict(set)
    for p, _, v, _ in edges:
        every[p].add(v)
    for _ in range(rounds):
        confidence = {}
        for p, k in {(p, k) for p, k, *_ in edges}:
            mine = {v for q, r, v, _ in edges if (q, r) == (p, k)}
            if sum(score[k, v] >= sure for v in mine) >= seeds:
                confidence[p, k] = sum(score[k, v] for v in mine) / (len(every[p]) + 1)
        fresh = {}
        for k, v in score:
            behind = {p for p, r, w, _ in edges if (r, w) == (k, v)}
            doubt = math.prod(1 - min(confidence[p, k], 0.999) for p in behind if (p, k) in confidence)
            fresh[k, v] = 1.0 if any(s for _, r, w, s in edges if (r, w) == (k, v)) else 1 - doubt
        score = fresh
    return {x for x, c in confidence.items() if c >= sure}


def test_contexts_are_believed_over_two_hops(spark):
    """Identifiers that only one context knows make another context known, in which there is no base seed at all."""
    made = []
    for i in range(60):
        made.append((len(made), f"then mail contact: seed{i}@host{i}.example.com ok"))
    for i in range(15):
        made.append((len(made), f"then mail contact: hidden{i} (at) corp{i} (dot) org ok"))
        made.append((len(made), f"and reach writer hidden{i} (at) corp{i} (dot) org now"))
    made.append((len(made), "and reach writer last (at) unseen (dot) org now"))
    made.append((len(made), "meet at noon (at) home (dot) dot now"))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = ids(pii.report(docs).collect())
    assert got[len(made) - 2]["spans"].startswith("email:") and got[len(made) - 1]["spans"] == ""
    candidates = pii._candidates(pii.with_seeds(docs)).collect()
    edges = {}
    for r in candidates:
        for p in r["patterns"]:
            edges[p, r["rank"], r["value"]] = edges.get((p, r["rank"], r["value"]), False) or r["seed"]
    want = pattern_scores([(*k, s) for k, s in edges.items()], pii.ROUNDS, pii.SURE, pii.SEEDS)
    found = {tuple(r) for r in pii.confident_patterns(pii._candidates(pii.with_seeds(docs))).collect()}
    assert found == want and ("writer", 0) in found


def test_rules_are_only_run_where_rows_stand():
    texts = ["#$ # $ % & one two" for _ in range(30)] + ["plain words that stand on their own here and go on" for _ in range(10)]
    raw = [t.encode() for t in texts]
    block = quality.Block(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
    work = {}
    alive, by = quality.cascade(block, np.ones(40, bool), quality.RULES, work)
    assert alive.sum() == 10 and set(by[:30]) == {"symbols"}
    assert work["symbols"] == 40 and all(n == 10 for name, n in work.items() if name != "symbols")
    counted = quality.Block(block.data, block.offsets)
    for name in quality.COUNTS:
        counted.of(name)
    work = {}
    assert (quality.cascade(counted, np.ones(40, bool), quality.RULES, work)[0] == alive).all() and set(work) <= {"shouting", "few_letters"}


def test_quality_verdicts_without_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole, brief = ids(quality.quality(docs).collect()), ids(quality.quality(docs, counts=False).collect())
    assert all((whole[k]["base_failed"], whole[k]["kept"]) == (r["base_failed"], r["kept"]) for k, r in brief.items()) and len(whole) == len(brief)


def test_documents_that_share_chunks_meet_and_reuse_them(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base = [" ".join(word() for _ in range(900)) for _ in range(6)]
    rows = [(i, base[i % 6] + (f" tail{i}" if i % 3 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    placed = bpe.gathered(docs).select("doc_id", F.spark_partition_id().alias("p")).collect()
    home = collections.defaultdict(set)
    for r in placed:
        home[r["doc_id"] % 6].add(r["p"])
    assert all(len(x) == 1 for x in home.values()) and len(placed) == 60
    codec = bpe.Codec(**TOKENIZER)
    codec.encode([t for _, t in rows])
    distinct = len({t[p:q] for _, t in rows for p, q in itertools.pairwise([0, *bpe.cuts(t)])})
    assert codec.encoded == distinct < codec.asked / 3
    small = bpe.Codec(**TOKENIZER, cache=4)
    assert [x.tolist() for x in small.encode([t for _, t in rows[:9]])] == [x.tolist() for x in codec.encode([t for _, t in rows[:9]])] and len(small.kept) <= 4


def test_crowded_pieces_equal_brute_force(spark, monkeypatch):
    """One passage in many texts with different neighbours: dealt by halves down to single distances."""
    monkeypatch.setattr(suffix, "CROWD", 3)
    rnd = random.Random(8)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(230))
    rows = [(i, "".join(rnd.choice("xyz ") for _ in range(rnd.randint(90, 160))) + passage + "".join(rnd.choice("uvw ") for _ in range(rnd.randint(90, 160)))) for i in range(24)]
    rows += [(100 + i, rows[i][1][30:]) for i in range(4)]
    seen = collections.Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    for r in suffix.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[r["doc_id"]]
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - 199):
            gone[i : i + 200] |= seen[text[i : i + 200]] > 1
        assert r["n_removed"] == gone.sum() and bytes(r["kept"]).decode() == "".join(c for c, g in zip(text, gone, strict=True) if not g)


def test_template_texts_stay_apart_and_copies_meet(spark, monkeypatch):
    """Many texts of one template under the threshold, in small blocks, and a few near copies among them."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rnd = random.Random(4)
    frame = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        t = list(frame)
        for k in rnd.sample(range(120), 6):
            t[k] = f"f{rnd.randrange(40)}"
        rows.append((i, " ".join(t)))
    rows += [(500 + i, rows[i][1] + " end") for i in range(5)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    own = {i: i for i in sets}
    top = lambda x: x if own[x] == x else top(own[x])
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            own[y] = x
    got = ids(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert {i: r["component_id"] for i, r in got.items()} == {i: top(i) for i in sets}


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stored_tables_go_when_spent(spark):
    df = stored(spark.range(3))
    assert df.count() == 3 and shared_dir(spark)
    spent(df)
    with pytest.raises(Exception, match="(?i)not exist|no such"):
        spark.read.parquet(df._tidemark_path).count()


def test_toxicity_of_odd_texts(spark):
    counts = np.ones((28, 28, 28), np.int64)
    model = toxicity.Model(counts, np.empty(0, np.uint64), np.empty(0), 1.0, -2.0)
    texts = [None, "", "s " * 5000, "a" * 20_000, "1" * 20_000, "😀" * 50, "x.y" * 3000]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(toxicity.score(model).alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in got)


def test_empty_and_odd_pages(spark):
    schema = "page_id long, url string, html string, text string"
    assert warc.derivatives(warc.responses(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, None, "", None), (1, None, "", None), (2, "u", "<p>" + "x " * 50_000, "mine")]
    made = warc.derivatives(warc.responses(spark.createDataFrame(rows, schema))).collect()
    assert len(made) == 6 and sum(r["content_length"] > 90_000 for r in made) == 1


def test_pipeline_stages_on_odd_tables(spark):
    """Empty tables, null texts, repeated ids and columns whose names clash with the operators' own."""
    import corpus_pipeline as P

    schema = SCHEMA + ", component_id long, epoch int, base string, _own string, salt int, least long"
    rows = [(None, None, None, None, None), (1, "", "en", "s1", 0), (1, "mail me at a@b.example.com today or else", "en", "s1", 40), (2, "one two three four five six", None, "s2", 27), (2, "one two three four five six", None, "s2", 27)]
    extra = (7, 8, "b", "o", 3, 4)
    sf = "/root/testdata/sf0.001"
    for data in ([], [r + extra for r in rows]):
        docs = spark.createDataFrame(data, schema)
        for _, stage in P.STAGES[:-1]:
            after = stored(stage(spark, docs, sf))
            assert after.columns == docs.columns
            assert all((r["component_id"], r["base"], r["_own"], r["salt"], r["least"]) == (7, "b", "o", 3, 4) for r in after.collect())
            docs = after
        last = P.STAGES[-1][1](spark, docs, sf).collect()
        assert len(last) == docs.count() and all(r["exact"] for r in last)


def test_pipeline_is_its_stages_in_order(spark):
    """What each stage keeps, from the operators themselves."""
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = docs.where(toxicity.score(model) < 0.5)
    groups = minhash.near_duplicates(clean, percent=80)
    one = clean.join(groups.where("kept").select("doc_id"), "doc_id", "left_semi")
    mixed = stored(P.mix_sources(spark, stored(pii.redacted(one)), sf))
    want = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in bpe.encoded(mixed, TOKENIZER).collect())
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in P.run(spark, sf).collect()) == want


def test_trigrams_do_not_reach_from_text_to_text(spark):
    texts = ["so bad", "dog", "", "café", None, "éab", "baaa", "dog"]
    count = lambda some: toxicity.trigram_counts(spark.createDataFrame([(x,) for x in some], "text string").coalesce(1))
    assert (count(texts) == sum(count([x]) for x in texts)).all()


def test_stages_pass_texts_in_small_batches(spark, tmp_path):
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word ")), 1000).alias("text")).coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").coalesce(1)
    largest = lambda: docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").agg(F.max("n")).first()[0]
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for given, most in ((None, common.BATCH_BYTES), ("64m", common.BATCH_BYTES), ("1m", 1 << 20)):
        if given:
            spark.conf.set(name, given)
        try:
            corpus_pipeline.encode_tokens(spark, docs.limit(0), str(tmp_path))
            assert largest() < 1.5 * most
        finally:
            spark.conf.unset(name)
