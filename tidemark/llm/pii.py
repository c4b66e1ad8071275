"""Personal data by fixed patterns and by bootstrapped contexts, in DataFrame functions only.

1. Four base patterns give the seeds: e-mail addresses, IP addresses, card and phone numbers, checked by value.
2. Looser candidates of each kind (obfuscated addresses, numbers without a plus, card numbers that fail the check, ...)
   and the seeds stand behind lexical patterns: the word before them, and the two words before them.
   Texts are searched once; what is found is stored in a narrow table of spans, on which all else works.
3. On the graph of patterns and instances, a pattern's confidence is the mean score of the instances behind it, for
   one kind, and an instance's score is the chance that one of its patterns is right; seeds have score 1. Instances
   whose score is high count as seeds of the next round's patterns, so that a context which only unseen identifiers
   have is found through them. ``ROUNDS`` rounds.
4. Candidates behind a pattern of high confidence that has enough different seeds become spans as well.

Positions are code points, end exclusive. Null texts count as empty. Repeated rows get equal results. A pattern never
reaches over the text's start. An empty table gives an empty one; very long texts are searched whole. Equal scores need no
order: patterns and instances are judged by thresholds. Ids are of any type. Extra columns, of any name, pass through ``redacted`` and are ignored by ``report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, stored

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive loops match the same texts and need no stack; the look-behinds only skip starts that
# fail or lie inside what an earlier start in the same run would have matched.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tests that a text with a match surely passes, cheaper than the search itself.
GUARD = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": lambda t: F.contains(t, F.lit("+"))}
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9])",
}
LOOSE_GUARD = {"email": lambda t: t.rlike(r"(?:[(\[]|\x20)(?:dot|at)(?:[)\]]|\x20)"), "ip": lambda t: t.rlike(r"(?:[0-9A-Fa-f]{1,4}:){7}"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": lambda t: t.rlike(r"[0-9](?:[\x20().-]{0,2}[0-9]){6}")}
#: Characters before a span in which its two words are looked for first, in turn; where they may begin earlier, all before it.
CONTEXTS, ROUNDS = (40, 400), 3
#: What a pattern needs to be believed: confidence, and different seeds behind it.
SURE, SEEDS = 0.7, 10

_SPAN = "array<struct<start:int,end:int,rank:int,value:string,seed:boolean>>"


def _running(lengths: Column, to: int = 64) -> Column:
    """Running sums of an array, by blocks, so that long arrays don't cost the square of their length."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def sums(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / to).cast("int")), lambda k: total(F.slice(xs, 1, k * to)))
        return let(blocks, lambda b: F.transform(xs, lambda x, i: F.get(b, F.floor(i / to).cast("int")) + total(F.slice(xs, F.floor(i / to).cast("int") * to + 1, i % to + 1))))

    return let(lengths, sums)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return a + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) <= 3) & (F.coalesce(F.substring(q, 1, 3).try_cast("int"), F.lit(0)) <= 255))),
    "card": lambda v: let(_digits(v), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False)),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}
LOOSE_VALID = {"email": lambda v: F.lit(True), "ip": lambda v: F.lit(True), "card": lambda v: F.lit(True), "phone": lambda v: F.length(_digits(v)).between(7, 15)}


def found(text: Column, kind: str, pattern: str, guard, valid, seed: bool) -> Column:
    """Spans of the leftmost non-overlapping matches that are valid, as an array."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def spans(vs: Column) -> Column:
        steps = F.transform(F.zip_with(gaps, vs, lambda g, v: g + F.coalesce(F.length(v), F.lit(0))), lambda x: x)
        ends = let(_running(steps), lambda e: F.transform(vs, lambda v, i: F.struct((F.get(e, i) - F.length(v)).alias("start"), F.get(e, i).alias("end"), F.lit(KINDS.index(kind)).alias("rank"), v.alias("value"), F.lit(seed).alias("seed"))))
        return F.filter(ends, lambda s: valid(s["value"]))

    none = F.array().cast(_SPAN)
    return F.when(guard(text), let(values, lambda vs: F.when(F.size(vs) > 0, spans(vs)).otherwise(none))).otherwise(none)


def with_seeds(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``base``: the spans of the base patterns, by start, then kind."""
    text = F.coalesce("text", F.lit(""))
    each = [found(text, k, BASE[k], GUARD[k], VALID[k], True) for k in KINDS]
    return docs.withColumn("base", F.sort_array(F.concat(*each)))


def loose(text: Column) -> Column:
    """Spans of the looser candidates of all kinds, as an array."""
    return F.concat(*(found(text, k, LOOSE[k], LOOSE_GUARD[k], LOOSE_VALID[k], False) for k in KINDS))


def _patterns(text: Column, start: Column) -> Column:
    """The patterns of what stands behind ``start`` characters: the word before it, and the two words before it, whole."""

    def words(most: int | None) -> Column:
        before = F.substring(text, F.lit(1), start) if most is None else F.substring(text, F.greatest(start - most + 1, F.lit(1)), F.least(start, F.lit(most)))
        return F.regexp_extract_all(F.lower(before), F.lit(r"[^\x20\t-\r]+"), F.lit(0))

    def made(found: Column) -> Column:
        last, none = F.element_at(found, -1), F.array().cast("array<string>")
        return F.when(F.size(found) > 1, F.array(last, F.concat_ws(" ", F.element_at(found, -2), last))).when(F.size(found) == 1, F.array(last)).otherwise(none)

    def within(most: int, further: Column) -> Column:  # of three words the last two are whole, wherever the first was cut
        return let(words(most), lambda found: F.when((F.size(found) > 2) | (start <= most), made(found)).otherwise(further))

    out = made(words(None))
    for most in reversed(CONTEXTS):
        out = within(most, out)
    return out


def _with_candidates(seeded: DataFrame) -> DataFrame:
    """``seeded`` with ``seen``: seeds and looser candidates that don't overlap a seed, each with its patterns."""
    text = F.coalesce("text", F.lit(""))
    rows = seeded.withColumn("seen", loose(text))
    rows = rows.withColumn("seen", F.concat("base", F.filter("seen", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))))
    parts = lambda s: [s[c].alias(c) for c in ("start", "end", "rank", "value", "seed")]
    return rows.withColumn("seen", F.transform("seen", lambda s: F.struct(*parts(s), _patterns(F.col("text"), s["start"]).alias("patterns"))))


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "digest", F.explode("seen").alias("span")).select("doc_id", "digest", "span.*")


def _candidates(seeded: DataFrame) -> DataFrame:
    """doc_id, digest, start, end, rank, value, seed, patterns of all candidates."""
    return _exploded(_with_candidates(seeded).withColumn("digest", F.xxhash64("text")))


def confident_patterns(candidates: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, rank) of the believed patterns: the graph of patterns and instances, scored in rounds.

    A pattern's confidence for a kind: the summed scores of its instances of that kind over the number of all its
    instances plus one. A pattern supports its instances once SEEDS of them are seeds or have a score of SURE.
    """
    edges = stored(candidates.select(F.explode("patterns").alias("pattern"), "rank", "value", "seed").groupBy("pattern", "rank", "value").agg(F.max("seed").alias("seed")))
    everything = edges.groupBy("pattern").agg(F.countDistinct("value").alias("all"))
    scores = edges.groupBy("rank", "value").agg(F.when(F.max("seed"), 1.0).otherwise(0.0).alias("score"))
    for _ in range(rounds):
        sums = edges.join(scores, ["rank", "value"]).groupBy("pattern", "rank").agg(F.sum("score").alias("right"), F.sum((F.col("score") >= SURE).cast("int")).alias("seeds"))
        sums = sums.where(F.col("seeds") >= SEEDS)
        confidence = stored(sums.join(everything, "pattern").select("pattern", "rank", "seeds", (F.col("right") / (F.col("all") + 1)).alias("confidence")))
        doubt = F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))
        scores = edges.join(confidence, ["pattern", "rank"], "left").groupBy("rank", "value").agg(F.when(F.max("seed"), 1.0).otherwise(F.coalesce(1 - doubt, F.lit(0.0))).alias("score"))
    return confidence.where(F.col("confidence") >= SURE).select("pattern", "rank")


def with_spans(docs: DataFrame, texts: bool = True) -> DataFrame:
    """``docs`` with ``base`` and ``extra``: seed spans, and spans that the believed patterns add; without ``text`` if not ``texts``.

    Every text is searched once, and what was found is stored (with the text, if it is wanted). Only rows that have a
    looser candidate can gain a span, so only they are joined and moved; the others stay where they are.
    """
    searched = _with_candidates(with_seeds(docs)).withColumn("digest", F.xxhash64("text"))
    searched = stored(searched if texts else searched.drop("text"))
    candidates = _exploded(searched)
    believed = confident_patterns(candidates)
    unseen = candidates.where("not seed").select("doc_id", "digest", F.struct("start", "end", "rank", "value", "seed").alias("span"), F.explode("patterns").alias("pattern"), "rank")
    new = unseen.join(believed, ["pattern", "rank"], "left_semi").groupBy("doc_id", "digest").agg(F.collect_set("span").alias("new"))
    new = new.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "new")
    may, none = F.size("seen") > F.size("base"), F.array().cast(_SPAN)
    some = searched.where(may).join(new, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    some = some.withColumn("extra", F.sort_array(F.coalesce("new", none))).drop("_id", "_digest", "new")
    return some.unionByName(searched.where(~may).withColumn("extra", none)).drop("seen", "digest")


def _text(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _by_place(spans: Column) -> Column:
    """Spans by start, then kind, then end."""
    return F.transform(F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"]))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank")))


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans, for each row of ``docs`` (doc_id, text)."""
    rows = with_spans(docs.select("doc_id", "text"), texts=False)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, KINDS), F.sha2(_text(_by_place(F.col("base"))), 256).alias("base_sha256"), _text(_by_place(F.concat("base", "extra"))).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; overlapping spans become one.

    Other columns stay as they are, but for n_chars, where there is one.
    """
    columns = docs.columns
    others = [c for c in columns if c not in ("doc_id", "text", "n_chars")]
    rows = with_spans(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("others")))
    kinds = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    ordered = _by_place(F.concat("base", "extra"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        kept = F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.get(kinds, s["rank"]))
        return F.when(s["start"] >= a["at"], F.struct(kept.alias("out"), s["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at")))

    masked = F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    rows = rows.withColumn("_masked", F.when(F.size("base") + F.size("extra") > 0, masked).otherwise(F.col("text")))
    new = {"doc_id": F.col("doc_id"), "text": F.col("_masked"), "n_chars": F.length("_masked").cast("long")}
    return rows.select(*((new[c] if c in new else F.col("others")[c]).alias(c) for c in columns))
