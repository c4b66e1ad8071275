"""Toxicity scores of texts after noisy-channel deobfuscation.

1. A character trigram model is counted over all given texts (its table has at most 28 ** 3 entries).
2. Words that look disguised - digits or signs among letters, letters drawn out or spaced out - become lattices: each
   character may be itself, a letter it resembles, or nothing; a new word may begin at any letter, at a cost. A
   Viterbi search finds the likeliest plain words, by the same rule at every length.
3. Words and word beginnings of the restored text get weights: the log odds of labelled documents that have them.
   The weights of a text's five heaviest words are summed and turned into a probability by logistic regression.

Nulls and edge cases: a null or blank text has no words and gets the score of weight 0. Labels that are null are left
out; a document with several label rows counts as often. Without labels of both kinds every score is 0. Repeated rows are
scored alike, extra columns pass through. A very long text is a block of its own and is decoded whole. Ties: of equally
likely decodings the last in alphabetical order counts, of a text's equal weights any (their sum is the same). Empty tables
give no trigrams, no weights and no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as T
from tidemark.llm.common import blocks, stored

#: Letters that a character may stand for in a disguised word (fixed values).
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Characters that may stand between the letters of a disguised word.
SEPARATORS = ".-_*~'`^"
#: Costs, in nats, of a letter for a look-alike, of dropping a separator, of dropping a repeated letter, of a new word.
SWAP, DROP, SHRINK, BREAK = 0.4, 0.2, 0.3, 1.0
#: Letters in a row that count as spaced out; words of a text that count.
SPACED, HEAVIEST = 4, 5
#: Characters of decoded words that a worker keeps; a limit of memory only.
KEPT = 4_000_000
BEGINNINGS = (4, 5, 6)
_SYMBOLS = 28  # blank, a-z, any other letter

_letter = np.zeros(256, bool)
_letter[97:123] = _letter[0x80:] = True
_edge = np.zeros(256, bool)
_edge[[ord(c) for c in LOOKALIKES if c not in "!|+"]] = True
_like = _letter.copy()  # letters and what stands for them
_like[[ord(c) for c in LOOKALIKES]] = True
_stop = ~_like  # what no disguise is made of
_stop[[ord(c) for c in SEPARATORS]] = False
_code = np.zeros(256, np.int64)
_code[97:123] = np.arange(1, 27)
_code[0xC0:] = 27


def trigram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all rows of ``texts`` (text), blanks padding the words."""

    def count(batches):
        total = np.zeros(_SYMBOLS**3, np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                low = T.lower_ascii(data)
                lead = (low & 0xC0) != 0x80
                texts = np.concatenate(([0], np.cumsum(lead)))[offsets[1:-1]]  # where all but the first begin
                c = np.insert(_code[low[lead]], np.repeat(texts, 2), 0)  # no word reaches from one text into the next
                c = np.concatenate(([0, 0], c, [0, 0]))
                before = np.where(c[1:-1] > 0, c[:-2], 0)  # a word starts alike whatever stands before it
                key = (before * _SYMBOLS + c[1:-1]) * _SYMBOLS + c[2:]
                plain = (c[1:-1] > 0) | (c[2:] > 0)
                three = (c[:-2] == c[1:-1]) & (c[1:-1] == c[2:]) & (c[2:] > 0)
                drawn = np.concatenate(([False, False], three, [False, False]))
                plain &= ~(drawn[:-4] | drawn[1:-3] | drawn[2:-2] | drawn[3:-1] | drawn[4:])  # letters drawn out are the noise
                total += np.bincount(key[plain], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    out = np.zeros(_SYMBOLS**3, np.int64)
    for gram, n in texts.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[gram] = n
    return out


class Restorer:
    """Viterbi decoding of disguised words under the trigram model."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS).astype(float)
        uni = n.sum((0, 1)) + 0.5
        bi = n.sum(0) + 2 * uni / uni.sum()
        tri = n + 4 * bi / bi.sum(1, keepdims=True)
        self.logs = np.log(tri / tri.sum(2, keepdims=True)).tolist()
        self.kept: dict[str, str] = {}
        self.size = 0

    def options(self, word: str, i: int) -> list[tuple[str, float]]:
        c = word[i]
        if c.isalpha():
            drawn = i + 1 < len(word) and word[i + 1] == c or i and word[i - 1] == c
            return [(c, 0.0), ("", SHRINK)] if drawn else [(c, 0.0)]
        found = [(x, SWAP) for x in LOOKALIKES.get(c, "")]
        return found + [("", DROP if c in SEPARATORS else 3.0)]

    def restore(self, word: str) -> str:
        """The likeliest plain words, with blanks between them."""
        if word in self.kept:
            return self.kept[word]
        logs = self.logs
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # score, and (what came before, letters)
        for i in range(len(word)):
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            options = self.options(word, i)
            for (p, q), (score, out) in states.items():
                for x, cost in options:
                    if x:
                        r = ord(x) - 96 if "a" <= x <= "z" else 27
                        made = [((q, r), (score - cost + logs[p][q][r], (out, x)))]
                        if q:
                            made.append(((0, r), (score - cost - BREAK + logs[p][q][0] + logs[0][0][r], (out, " " + x))))
                    else:
                        made = [((p, q), (score - cost - 1.5, out))]
                    for key, new in made:
                        if key not in after or new[0] > after[key][0]:
                            after[key] = new
            states = after
        ends = [(score + logs[p][q][0], out) for (p, q), (score, out) in states.items()]
        most = max(score for score, _ in ends)
        best = max(_spelt(out) for score, out in ends if score == most)
        self.size += len(word)
        if self.size > KEPT:
            self.kept.clear()
            self.size = len(word)
        self.kept[word] = best
        return best


def _spelt(out: tuple) -> str:
    letters = []
    while out:
        out, x = out
        letters.append(x)
    return "".join(reversed(letters))


def features(data: np.ndarray, offsets: np.ndarray, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """The row of each word of the restored text, and the hashes of the word and of its beginnings (0: too short)."""
    low = T.lower_ascii(data)
    start, end, bounds = T.words(low, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    letters = np.flatnonzero(_letter[low])
    if not len(letters):
        return np.empty(0, np.int64), np.empty((0, 1 + len(BEGINNINGS)), np.uint64)
    i, j = np.searchsorted(letters, start), np.searchsorted(letters, end)
    has = j > i
    sign = ~has & (end - start == 1)  # look-alikes that are words by themselves
    sign[sign] = _like[low[start[sign]]]
    alone, alone_row = start[sign], row[sign]
    start, end, row, i, j = start[has], end[has], row[has], i[has], j[has]
    first, last = letters[i], letters[j - 1] + 1
    drawn = np.zeros(len(low) + 1, np.int64)
    if len(low) > 2:
        drawn[3:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & _letter[low[2:]]
    drawn = np.cumsum(drawn)
    # from the first to the last letter or look-alike that only letters, look-alikes and separators part from a letter
    ends = np.flatnonzero(_letter[low] | _edge[low])
    stops = np.concatenate(([-1], np.flatnonzero(_stop[low]), [len(low)]))
    p = ends[np.searchsorted(ends, np.maximum(start, stops[np.searchsorted(stops, first) - 1] + 1))]
    q = ends[np.searchsorted(ends, np.minimum(end, stops[np.searchsorted(stops, last)])) - 1] + 1
    disguised = (j - i < q - p) | (drawn[last] > drawn[np.minimum(first + 2, last)])
    disguised &= q - p > 1
    prefix = T.prefix_sums(low)
    rows, found = [row[~disguised]], [_hashes(prefix, first[~disguised], last[~disguised])]
    extra: list[tuple[int, str]] = []

    def restored(r: int, raw: np.ndarray) -> None:
        extra.extend((r, x) for x in restorer.restore(raw.tobytes().decode("utf-8", "replace")).split(" "))

    for k in np.flatnonzero(disguised):
        restored(row[k], low[p[k] : q[k]])
    single = q - p == 1
    if single.any():  # letters spaced out
        at = np.concatenate((first, alone))
        order = np.argsort(at)
        at, row, single, letter = at[order], np.concatenate((row, alone_row))[order], np.concatenate((single, np.ones(len(alone), bool)))[order], _letter[low[at[order]]]
        solid = letter | _edge[low[at]]
        first_of = np.concatenate(([True], row[1:] != row[:-1]))  # runs end with their text
        cuts = np.flatnonzero(first_of | np.concatenate(([True], single[1:] != single[:-1])))
        for a, b in zip(cuts, np.concatenate((cuts[1:], [len(at)])), strict=True):
            if b - a < SPACED or not single[a] or not letter[a:b].any():
                continue
            inner = a + np.flatnonzero(solid[a:b])
            run = at[inner[0] : inner[-1] + 1]
            if len(run) >= SPACED:
                restored(row[a], low[run])
    extra = [(r, x) for r, x in extra if x]
    if extra:
        joined = np.frombuffer("".join(x for _, x in extra).encode(), np.uint8)
        at = np.concatenate(([0], np.cumsum([len(x.encode()) for _, x in extra])))
        rows.append(np.array([r for r, _ in extra]))
        found.append(_hashes(T.prefix_sums(joined), at[:-1], at[1:]))
    return np.concatenate(rows), np.concatenate(found)


def _hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = [T.range_hashes(prefix, start, end)]
    for k in BEGINNINGS:
        out.append(np.where(end - start > k, T.range_hashes(prefix, start, np.minimum(start + k, end)) ^ np.uint64(k), np.uint64(0)))
    return np.stack(out, axis=1)


@dataclass(frozen=True)
class Model:
    trigrams: np.ndarray
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    slope: float
    bias: float


def _evidence(data: np.ndarray, offsets: np.ndarray, restorer: Restorer, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The summed weights of each row's heaviest distinct words."""
    out = np.zeros(len(offsets) - 1)
    row, found = features(data, offsets, restorer)
    if not len(keys) or not len(row):
        return out
    spot = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    weight = np.where(keys[spot] == found, weights[spot], 0.0).max(axis=1)
    at = np.flatnonzero(weight > 0)
    at = at[np.argsort(row[at], kind="stable")]
    for mine in np.split(at, np.flatnonzero(np.diff(row[at])) + 1) if len(at) else []:
        r = row[mine[0]]
        heavy = dict(zip(found[mine, 0].tolist(), weight[mine].tolist(), strict=True))
        out[r] = sum(sorted(heavy.values(), reverse=True)[:HEAVIEST])
    return out


def sampled(labels: DataFrame, most_rows: int, seed: int) -> DataFrame:
    """doc_id, toxic, copies: the labels of about ``most_rows`` ids at most, chosen by a seeded hash of the id."""
    labels = labels.select("doc_id", F.col("toxic").cast("long").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    labels = labels.groupBy("doc_id", "toxic").agg(F.count(F.lit(1)).alias("copies"))
    share = min(1.0, most_rows / max(1, labels.count()))
    return labels.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def learn(corpus: DataFrame, docs: DataFrame, labels: DataFrame, most_rows: int = 40_000, most_features: int = 20_000, least_share: float = 0.01, seed: int = 11) -> Model:
    """Fits on ``corpus`` (text; all rows) and on those of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) name.

    ``most_rows`` bounds the labels that are used: a seeded share of them where there are more. So they can be broadcast,
    and no other text moves; the texts that they name are stored once. ``most_features`` bounds the weights that are
    kept: those of the most evidence. What less than ``least_share`` of the toxic documents have gets no weight: it is
    chance, or the words of one text and its copies.
    """
    trigrams = trigram_counts(corpus)
    few = F.broadcast(sampled(labels, most_rows, seed))  # three numbers a row, most_rows rows or so
    labelled = stored(docs.select("doc_id", "text").join(few, "doc_id").select("text", "toxic", "copies"))
    total = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.sum("copies").alias("n")).collect()}
    if not total.get(0) or not total.get(1):
        return Model(trigrams, np.empty(0, np.uint64), np.empty(0), 0.0, -100.0)

    def count(batches):
        restorer = Restorer(trigrams)
        for batch in batches:
            toxic, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for lo, _, data, offsets in blocks(batch.column(0)):
                row, found = features(data, offsets, restorer)
                keys = np.empty(found.size, [("row", np.int64), ("key", np.uint64)])
                keys["row"], keys["key"] = np.repeat(row, found.shape[1]), found.ravel()
                keys = np.unique(keys[keys["key"] != 0])
                key, at = np.unique(keys["key"], return_inverse=True)
                at_row = lo + keys["row"]
                n1 = np.bincount(at, (toxic * copies)[at_row], len(key)).astype(np.int64)
                n = np.bincount(at, copies[at_row], len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n1), pa.array(n - n1)], ["key", "n1", "n0"])

    counts = labelled.mapInArrow(count, "key long, n1 long, n0 long").groupBy("key").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") >= max(3, least_share * total[1]))
    odds = F.log((F.col("n1") + 0.5) / (total[1] + 1.0)) - F.log((F.col("n0") + 0.5) / (total[0] + 1.0))
    top = counts.withColumn("w", odds).where("w > 2.0").orderBy((-F.col("w") * F.col("n1")), "key").limit(most_features).collect()
    keys = np.array([r["key"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, weights = keys[order], np.array([r["w"] for r in top])[order]

    def histogram(batches):
        restorer = Restorer(trigrams)
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.round(_evidence(data, offsets, restorer, keys, weights) * 4) / 4), batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo)], ["s", "toxic", "copies"])

    bins = labelled.mapInArrow(histogram, "s double, toxic long, copies long").groupBy("s", "toxic").agg(F.sum("copies").alias("n")).orderBy("s", "toxic").collect()
    return Model(trigrams, keys, weights, *_logistic(np.array([[r["s"], r["toxic"], r["n"]] for r in bins], float)))


def _logistic(bins: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and bias of a weighted logistic regression on one feature, by Newton's method."""
    s, y, n = bins.T
    x = np.stack([s, np.ones_like(s)], axis=1)
    w = np.array([0.1, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag([ridge, 1e-3])
        step = np.linalg.solve(hessian, x.T @ (n * (y - p)) - np.array([ridge, 1e-3]) * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score(model: Model, text: str | Column = "text") -> Column:
    """The probability that a text is toxic, as a column."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        restorer = _restorer(model)
        out = np.zeros(len(texts))
        for lo, hi, data, offsets in blocks(texts):
            z = np.clip(model.slope * _evidence(data, offsets, restorer, model.keys, model.weights) + model.bias, -700, 700)
            out[lo:hi] = 1 / (1 + np.exp(-z))
        return pa.array(out)

    return run(text)


_restorers: dict[int, Restorer] = {}


def _restorer(model: Model) -> Restorer:
    """One for each model in a worker, so that restored words are kept from batch to batch."""
    key = hash(model.trigrams.tobytes())
    if key not in _restorers:
        _restorers.clear()
        _restorers[key] = Restorer(model.trigrams)
    return _restorers[key]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model that the labels outside the held-out fifth give."""
    return learn(docs, docs, labels.where(~held_out()))
