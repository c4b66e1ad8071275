"""The text operators against brute-force versions, exact round trips and held-out accuracy."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, fingerprint, language, minhash, mixing, pii, quality, suffix, toxicity, warc
from tidemark.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, bucket string, n_tokens string"


def made(seed=3, n=60):
    """Odd documents: copies, near copies, shared passages, nulls, blanks, a long text, clashing extra columns."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeéinrstuü") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage, base = text(70), text(150)
    out = [None, "", " \n\t", "one two", "one two", "\x0b", "x" * 900, "ab" * 400, text(30_000)]
    for _ in range(n):
        kind = rnd.randint(0, 4)
        if kind == 0:
            out.append(text(rnd.randint(1, 200)))
        elif kind == 1:
            out.append(text(20) + "\n" + passage + "\n" + text(20))
        elif kind == 2:
            w = base.split(" ")
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(words).upper()
            out.append(" ".join(w))
        elif kind == 3:
            out.append(rnd.choice(out))
        else:
            line = text(12)
            out.append("\n".join([line, text(5), line, "#$% " + text(3)]))
    rows = [(i, x, rnd.choice(["en", "de", None]), rnd.choice(["src0", "src1", None]), None if x is None else len(x), 7, "b", "t") for i, x in enumerate(out)]
    return rows + [(None, base, None, None, None, 7, "b", "t")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = made()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(rows):
    return {r["doc_id"]: r for r in rows}


def test_suffix_dedup_equals_brute_force(odd, monkeypatch):
    rows, docs = odd
    for crowd in (suffix.CROWD, 2):  # the second deals groups out string by string
        monkeypatch.setattr(suffix, "CROWD", crowd)
        raw = [(x or "").encode() for _, x, *_ in rows]
        seen = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
        got = sorted(suffix.deduplicated(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
        for (key, *_), b, g in zip(rows, raw, got, strict=True):
            gone = np.zeros(len(b), bool)
            for i in range(len(b) - 199):
                if seen[b[i : i + 200]] > 1:
                    gone[i : i + 200] = True
            kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
            spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
            assert (g["doc_id"], g["n_bytes"], g["n_removed"], g["n_spans"]) == (key, len(b), gone.sum(), spans)
            assert bytes(g["kept"]) == kept and g["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_interval_expansion_equals_counting():
    rnd = np.random.RandomState(5)
    for length in (3, 6):
        suffix.LENGTH, suffix.open_prefixes.__defaults__ = length, (length,)
        for _ in range(60):
            pieces = [bytes(rnd.randint(97, 99, rnd.randint(1, 40)).astype(np.uint8)) for _ in range(rnd.randint(1, 7))]
            weights = rnd.randint(1, 3, len(pieces)).astype(float)
            seen = collections.Counter()
            for p, w in zip(pieces, weights, strict=True):
                for i in range(len(p) - length + 1):
                    seen[p[i : i + length]] += w
            for p, found in zip(pieces, suffix.repeated(pieces, weights), strict=True):
                assert found.tolist() == [i for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1]
    suffix.LENGTH, suffix.open_prefixes.__defaults__ = 200, (200,)


def test_bpe_equals_the_library_and_decodes_back(odd):
    from tokenizers import Tokenizer

    rows, docs = odd
    library = Tokenizer.from_file(TOKENIZER["path"])
    got = ids(bpe.encoded(docs, TOKENIZER).collect())
    digest = ids(bpe.digests(docs, TOKENIZER).collect())
    for key, text, *_ in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got[key]["ids"] == want and got[key]["exact"]
        assert digest[key]["n_tokens"] == len(want)
        assert digest[key]["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_mends_joints_without_spaces():
    from tokenizers import Tokenizer

    rnd = random.Random(2)
    texts = ["中文字符" * 3000, "ab1'" * 5000, "  " * 4000, "foo<|endoftext|>bar" * 900, "it's we're" * 900, "".join(rnd.choice("ab '\ns1é😀") for _ in range(20_000))]
    library = Tokenizer.from_file(TOKENIZER["path"])
    for settings in (TOKENIZER, {"path": TOKENIZER["path"]}):
        codec = bpe.Codec(**settings)
        found = codec.encode(texts)
        assert [x.tolist() for x in found] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
        assert codec.decode(found) == texts
        assert codec.encoded < codec.asked


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def base_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(kind, m.group(0))]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def test_pii_base_spans_equal_re(spark):
    rnd = random.Random(4)
    bits = ["a.b@c-d.e.f", "@", ".", "1.2.3.4", "300.1.1.1", "0012.1.1.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-0199", "+", "é😀", " ", "_x@y.z_w@v.u", "1" * 40, "-", "9"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(300)] + [None, "", "7" * 20_000, "a" * 20_000 + "@", "x@y.z " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(docs).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["n_email"] == want.count("email") and set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_pii_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"so it was. mail contact: user{i}@host{i}.example.com and more") for i in range(30)]
    rows += [(100, "so it was. mail contact: jane (at) corp (dot) org and more"), (101, "meet jane (at) corp (dot) org and more")]
    got = ids(pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[100]["n_email"] == 0 and got[100]["spans"] == "email:25:49" and got[101]["spans"] == ""
    masked = ids(pii.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert masked[100]["text"] == "so it was. mail contact: <email> and more" and masked[3]["text"] == "so it was. mail contact: <email> and more"


def test_quality_counts_and_order(odd):
    rows, docs = odd
    got = ids(quality.quality(docs).collect())
    for key, text, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat))
        g = got[key]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want
        assert g["base_failed"] == (len(w) < 10 or 100 * len(repeat) > 20 * len(w)) and not (g["kept"] and g["base_failed"])
        block = quality.Block(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        assert g["kept"] == (not g["base_failed"] and not any(r.rejects(block)[0] for r in quality.RULES))
    order = quality.measured([t or "" for _, t, *_ in rows])
    assert sorted(r.name for r, _, _ in order) == sorted(r.name for r in quality.RULES)
    rates = [(-(s + 1e-6) / c) for _, c, s in order]
    assert rates == sorted(rates)


def test_near_duplicates_equal_brute_force(odd):
    rows, docs = odd
    sets = {}
    for i, (_, text, *_) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    own = {i: i for i in sets if rows[i][0] is not None}
    top = lambda x: x if own[x] == x else top(own[x])
    for i in own:
        for j in own:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                own[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for i, (key, *_) in enumerate(rows):
        assert got[key]["n_shingles"] == len(sets[i])
        if key is not None:
            assert got[key]["component_id"] == rows[top(i)][0] and got[key]["kept"] == (top(i) == i)
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_bit_estimate_is_near_the_truth(spark):
    rnd = np.random.RandomState(1)
    a = np.unique(rnd.randint(0, 1 << 63, 900).astype(np.uint64))
    for share in (0.9, 0.5, 0.1):
        b = np.unique(np.concatenate((a[: int(len(a) * share)], rnd.randint(0, 1 << 63, int(len(a) * (1 - share))).astype(np.uint64))))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        pair = [(minhash.packed(minhash.minima(a)).view(np.int64).tolist(), minhash.packed(minhash.minima(b)).view(np.int64).tolist())]
        found = spark.createDataFrame(pair, "a array<long>, b array<long>").select(minhash.estimate(F.col("a"), F.col("b"))).first()[0]
        assert abs(found - true) < 0.16


def test_toxicity_restores_and_separates(spark):
    rnd = random.Random(6)
    plain = ["garden", "window", "music", "river", "stone", "table", "green", "paper", "stupid", "weather"]
    text = lambda: " ".join(rnd.choice(plain[:8] + plain[9:]) for _ in range(30))
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        hidden = rnd.choice(["stupid", "stup1d", "s.t.u.p.i.d", "stuuupid", "$tupid", "s t u p i d"])
        rows.append((i, f"{text()} {hidden} {text()}" if bad else text(), int(bad)))
    docs = spark.createDataFrame(rows + [(1000, None, None), (1001, "", None)], "doc_id long, text string, toxic int")
    model = toxicity.fitted(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    restorer = toxicity.Restorer(model.trigrams)
    assert [restorer.restore(x) for x in ("stup1d", "s.t.u.p.i.d", "stuuupid", "$tupid")] == ["stupid"] * 4
    got = docs.select("doc_id", "toxic", toxicity.held_out().alias("held"), toxicity.score(model).alias("score")).collect()
    held = [r for r in got if r["held"] and r["toxic"] is not None]
    assert sum((r["score"] >= 0.5) == r["toxic"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["score"] < 0.5 for r in got if r["doc_id"] >= 1000)


def test_toxicity_decodes_any_length_in_any_company():
    words = ["you", "are", "such", "garden", "window", "music", "stupid", "weather"]
    counts = np.zeros((28, 28, 28), np.int64)
    for w in words:
        c = [0, *(ord(x) - 96 for x in w), 0, 0]
        for a, b, d in zip([0, *c], c, c[1:], strict=False):
            counts[a, b, d] += 500 * bool(b or d)
    restorer = toxicity.Restorer(counts)

    def found(*texts):
        raw = [t.encode() for t in texts]
        row, hashes = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))), restorer)
        return [set(hashes[row == i, 0].tolist()) for i in range(len(texts))]

    stupid = found("stupid")[0]
    spaced = " ".join("youaresuchstupidgardenwindowmusicweather" * 3)
    hidden = [spaced, "st" + "u" * 90 + "pid", "s t u p 1 d", "5 t u p 1 d", "5.t.u.p.i.d", "s t u p ! d", "-".join("youaresuchstupidgardenwindowmusicweather")]
    for t in hidden:
        assert stupid <= found(t)[0], t
        assert found(t, "I am", t, "a b", t)[::2] == [found(t)[0]] * 3
    assert found("3 1 0 4", "hello!!", "a | b")[0] == set() and found("hello!!")[0] == found("hello")[0]


def test_toxicity_reads_the_same_letters_alike_at_every_length(spark):
    """A disguised word is read as its parts are, however long the whole is."""
    counts = toxicity.trigram_counts(spark.createDataFrame([(" ".join(["you", "worthless", "garbage", "and", "stupid", "idiot", "window", "garden"] * 50),)], "text string"))
    restorer = toxicity.Restorer(counts)
    part = "w0rthl3ss-garb4ge.and.st-u-p-i-d.idi0t"
    words = restorer.restore(part).split(" ")
    assert words == ["worthless", "garbage", "and", "stupid", "idiot"]
    for k in (2, 3, 40):
        assert restorer.restore(".".join([part] * k)).split(" ") == words * k


def test_contexts_are_whole_words(spark):
    long = "reach" * 30
    docs = spark.createDataFrame([(1, f"{long} at a@b.example.com"), (2, f"x {'y' * 39} at a@b.example.com"), (3, "a@b.example.com"), (4, f"{'z' * 900} {'w' * 500} a@b.example.com"), (5, "one two three a@b.example.com")], "doc_id long, text string")
    got = {r["doc_id"]: r["patterns"] for r in pii._candidates(pii.with_seeds(docs)).collect()}
    assert got == {1: ["at", f"{long} at"], 2: ["at", "y" * 39 + " at"], 3: [], 4: ["w" * 500, "z" * 900 + " " + "w" * 500], 5: ["three", "two three"]}


def test_string_ids(spark):
    docs = spark.createDataFrame([("a", "mail me at a@b.example.com today"), ("b", None)], "doc_id string, text string")
    assert {r["doc_id"] for r in bpe.digests(docs, TOKENIZER).collect()} == {"a", "b"}
    assert ids(pii.report(docs).collect())["a"]["n_email"] == 1


def test_hubs_meet_their_members_in_parts(spark, monkeypatch):
    """A text that most others are near to: its set is dealt to several tasks, and no pair is lost."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))] + [(i, " ".join([*base[:-1], f"own{i}"])) for i in range(1, 30)] + [(i, "") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ids(minhash.near_duplicates(docs, percent=85).collect())
    assert all(got[i]["component_id"] == 0 for i in range(30)) and all(got[i]["component_id"] == i and got[i]["kept"] for i in range(100, 140))
    sets = docs.where("doc_id < 30").mapInArrow(minhash._set_rows, minhash.SETS)
    pairs = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(1, 2)], "a long, b long")
    assert {tuple(r) for r in minhash.confirmed(pairs, sets, 85).collect()} == {(0, i) for i in range(1, 30)} | {(1, 2)}


def test_warc_sql_keeps_page_headers(spark):
    import duckdb

    from tidemark.llm import oracle, queries

    html = ["<head x><title>T</title></head\n><body><header class='a'><h1>Top</h1>by me</header>Body", "<scripted>One</scripted><script>no</script >", " a &amp;lt; b&nbsp; c <br/> \n\n x ", None, "<script>unclosed <a href=x>"]
    pages = spark.createDataFrame([(i, "u", x) for i, x in enumerate(html)], "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = sorted(map(str, con.execute("select page_id, record_type, record_id, refers_to, target_uri, source_digest, title, text_sha256, text_bytes, n_links from (" + oracle.WARC + ")").fetchall()))
    import tempfile

    folder = tempfile.mkdtemp()
    pages.write.parquet(f"{folder}/pages.parquet")
    assert sorted(str(tuple(r)) for r in queries.op7_warc(spark, folder).collect()) == want


def test_toxicity_without_labels(spark, empty):
    model = toxicity.fitted(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert spark.createDataFrame([("some words",)], "text string").select(toxicity.score(model)).first()[0] < 0.5


def test_language_on_held_out_texts(spark):
    rnd = random.Random(8)
    parts = {"en": ["the", "ing", "and", "th", "er"], "fr": ["eau", "ou", "é", "que", "re"], "de": ["sch", "ung", "ä", "keit", "en"]}
    rows = [(i, " ".join("".join(rnd.choice(parts[x]) for _ in range(rnd.randint(1, 3))) for _ in range(40)), x) for i, x in enumerate(["en", "fr", "de"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.learn(docs.where("doc_id % 4 <> 2"))
    got = ids(language.identify(docs.where("doc_id % 4 = 2"), profiles).collect())
    assert all(got[i]["lang_pred"] == x for i, _, x in rows if i % 4 == 2)
    odd = spark.createDataFrame([(0, None), (1, "12 ?!"), (2, "")], "doc_id long, text string")
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in language.identify(odd, profiles).collect())
    assert language.identify(docs, {}).first()["lang_pred"] == "und"


def test_language_letters_have_codes_of_their_own(spark):
    twin = str.maketrans({c: chr(ord(c) + 511) for c in "абвгдежзик"})
    base = ["абв где жзи", "где абв зик", "киз вба едг"]
    assert all(c.translate(twin).isalpha() for c in "абвгдежзик")
    rows = [(i, t.translate(twin) if k else t, "yy" if k else "xx") for i, (t, k) in enumerate((t, k) for t in base * 5 for k in (0, 1))]
    docs = spark.createDataFrame([*rows, (97, "𝒳𝒴 𠀀𠀁 𠀂", "zz"), (98, "😀🎉 12 ?! 🚀", "zz"), (99, "😀🎉 12", None)], "doc_id long, text string, lang string")
    got = ids(language.identify(docs, language.learn(docs)).collect())
    assert [got[i]["lang_pred"] for i, *_ in rows] == [x for *_, x in rows] and all(got[i]["score"] > 0 for i, *_ in rows)
    assert got[97]["lang_pred"] == "zz" and [(got[i]["lang_pred"], got[i]["score"]) for i in (98, 99)] == [("und", 0.0)] * 2
    many = "".join(chr(c) for c in range(0x4E00, 0x9FA5)) + "".join(chr(c) for c in range(0x20000, 0x2A000))
    texts = [many, *["ab"] * 9000]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    row, gram, n, has = language.gram_counts(data, offsets)
    assert has.all() and (n[row == 0] == 1).all() and len(np.unique(gram[row == 0])) == (row == 0).sum() == 3 * len(many) + 1
    assert gram[row == 9000].tolist() == language.gram_counts(data[-2:], np.array([0, 2]))[1].tolist()


def test_fingerprints(odd):
    rows, docs = odd
    got = ids(fingerprint.fingerprints(docs).collect())
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    by_text = collections.defaultdict(set)
    for k, (key, text, *_) in enumerate(order):
        t, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        assert got[key]["n_chars"] == len(t) and got[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        by_text[t].add(got[key]["fingerprint"])
        if t == edited:
            assert got[key]["near_edited"] == 1.0
    assert all(len(x) == 1 for x in by_text.values())
    assert all(len(r["fingerprint"]) in (0, fingerprint.BINS) for r in got.values())


def test_fingerprint_likeness_is_near_the_truth(spark):
    rnd = random.Random(9)
    words = [str(rnd.random()) for _ in range(700)]
    for n in (600, 40):
        a, b = words[:n], words[: n * 3 // 4] + [str(rnd.random()) for _ in range(n // 4)]
        grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        true = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        pair = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string")
        found = pair.select(fingerprint.likeness(fingerprint.digits(F.col("a")), fingerprint.digits(F.col("b")))).first()[0]
        assert abs(found - true) < 0.2


def test_mixing_equals_brute_force(spark):
    rnd = random.Random(10)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 9)), rnd.choice(["en", "de", None]), rnd.choice(["a1", "b2", "c9"])) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    tree = mixing.Node()
    for d, w in (("a", 3.0), ("b", 1.0)):
        node = tree.children.setdefault(d, mixing.Node(w))
        for x in ("en", "de"):
            node.children[x] = mixing.Node(1.0, {s: mixing.Node() for s in ("a1", "b2")})
    size = collections.Counter()
    for _, t, x, s in rows:
        size[s[0], x or "", s] += len(t.split())
    for budget, epochs in ((300, 2), (2600, 2), (10**9, 3)):
        got = mixing.mixed(docs, tree, budget, F.substring("source", 1, 1), max_epochs=epochs).collect()
        spent = collections.Counter()
        for r in got:
            spent[r["domain"], r["lang"], r["source"]] += r["n_tokens"]
        capacity = {k: v * epochs for k, v in size.items() if mixing._in(tree, k)}
        share = mixing.leaf_budgets(tree, capacity, budget)
        assert sum(share.values()) == min(budget, sum(capacity.values()))
        assert set(spent) == {k for k, v in share.items() if v} and all(share[k] - 9 < v <= share[k] for k, v in spent.items())
        assert len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)
    assert mixing.split_budget(100, [(1, 10), (1, 1000), (2, 1000)]) == [10, 30, 60]
    assert mixing.mixed(docs.limit(0), tree, 10, F.substring("source", 1, 1)).count() == 0


def test_mixing_reaches_unlisted_names(spark):
    from tidemark.llm import queries

    kinds = [(x, s) for x in ("en", "it", None) for s in ("src1", "src2", "web", None)]
    rows = [(i, "one two three", *kinds[i % len(kinds)]) for i in range(240)] + [(999, " ", "en", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    tree = queries.mixing_tree(docs)
    every = mixing.mixed(docs, tree, 10**6, queries.domain(), max_epochs=1).collect()
    assert sorted(r["doc_id"] for r in every) == list(range(240))
    part = mixing.mixed(docs, tree, queries.BUDGET, queries.domain()).collect()
    assert {(r["lang"], r["source"]) for r in part} == set(kinds) and 720 * queries.BUDGET - 36 < sum(r["n_tokens"] for r in part) <= 720 * queries.BUDGET


def test_mixing_keeps_columns_of_clashing_names(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = ("leaf", "whole", "rest", "bucket", "buckets", "end", "left", "sum", "u", "_lang", "_source", "mix_leaf", "n_tokens", "domain", "epoch")
    wide = docs.select("*", *(F.lit(n).alias(n) for n in names))
    got, plain = P.mix_sources(spark, wide, ""), P.mix_sources(spark, docs, "")
    assert got.columns == wide.columns and plain.columns == docs.columns
    rows = got.collect()
    assert all(r[n] == n for r in rows for n in names)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in plain.collect())


def test_warc_records(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<html><head><title>T &amp; U</title></head><body><p>One <a href='x'>two</a></p><script>no</script><!-- no -->&lt;b&gt;</body></html>", "extra"), (None, None, None, None)], "page_id long, url string, html string, block string")
    made_ = warc.derivatives(warc.responses(pages)).collect()
    assert len(made_) == 4
    for r in made_:
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest() and r["content_length"] == len(r["block"].encode())
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r["record_id"]) and r["http_headers"].startswith("HTTP/1.1 200 OK\r\n")
    one = [r for r in made_ if r["page_id"] == 1]
    assert len({r["refers_to"] for r in one}) == 1 and {r["block"] for r in one if r["record_type"] == "conversion"} == {"One two\n<b>"}
    lines = [r["record"] for r in warc.serialised(warc.derivatives(warc.responses(pages))).collect()]
    assert all(x.startswith("WARC/1.1\r\nWARC-Type: ") and "WARC-Refers-To: <urn:uuid:" in x for x in lines)


def test_warc_keeps_page_headers(spark):
    pages = ["<head data-x='1'><title>T</title></head\n><body><header class='a'><h1>Top</h1>by me</header><p>Body</p></body>", "<head><title>T</title><body><header>Top</header><p>Body</p>", "<scripted>One</scripted><styled>two</styled><script>no</script ><STYLE type='x'>no</STYLE>"]
    got = spark.createDataFrame(list(enumerate(pages)), "k int, html string").select("k", warc.plain_text(F.col("html")).alias("t")).collect()
    assert {r["k"]: r["t"] for r in got} == {0: "Top\nby meBody", 1: "T\nTopBody", 2: "Onetwo"}


def test_empty_tables(empty):
    assert suffix.deduplicated(empty).count() == 0
    assert bpe.digests(empty, TOKENIZER).count() == 0
    assert pii.report(empty).count() == 0
    assert quality.quality(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert language.learn(empty) == {}
    assert fingerprint.fingerprints(empty).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "tokens"]
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = P.stored(stage(spark, before, sf))
        assert after.columns == docs.columns and after.count() <= 2 * before.count()
        if name == "near_duplicates":
            assert after.count() == minhash.near_duplicates(before, percent=80).where("kept").count()
        if name == "personal_data":
            assert after.count() == before.count() and not any(base_spans(r["text"]) for r in after.collect())
        before = after
    last = P.STAGES[-1][1](spark, before, sf).collect()
    assert len(last) == before.count() and all(r["exact"] for r in last)
