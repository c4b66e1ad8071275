"""Language identification by rank-order profiles of character n-grams.

A profile ranks the most frequent 1- to 3-grams of a language's texts. A text's own most frequent n-grams are compared
to each profile: every n-gram costs the distance between its two ranks, or the most possible if the profile lacks it.
The language with the least total wins. N-grams are taken from lower-cased words, padded with a blank on both sides.

A text that is null or has no letter is ``und`` with score 0. A text whose n-grams are in no profile gets the first
language in order, with score 0. If there is nothing to learn from, every text is ``und``. Ties go to the
alphabetically first language. Very long texts are counted whole, in a block of their own. Ids must be numbers. Repeated
rows are judged alike, empty tables give empty ones; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import blocks

#: N-grams in a language's profile, and n-grams of a text that are compared.
PROFILE, OWN = 400, 150
#: N-grams that wait until they are merged into a task's counts of a language.
MERGE = 500_000
_CODE = 18  # bits of a character's code in an n-gram: all letters are below U+40000


def _letter_table() -> np.ndarray:
    """Code of each character: 0 for what isn't a letter, else the lower-case letter's code point."""
    table = np.zeros(1 << _CODE, np.int64)
    for point in range(1 << _CODE):
        c = chr(point)
        if c.isalpha():
            table[point] = ord(c.lower()[0])
    return table


_letters: list[np.ndarray] = []


def letter_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of every character and the byte at which it starts."""
    if not _letters:
        _letters.append(_letter_table())
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int64)
    padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
    one, two = padded[at + 1] & 63, padded[at + 2] & 63
    point = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 31) << 6 | one, (lead & 15) << 12 | one << 6 | two))
    far = np.flatnonzero(lead >= 0xF0)
    point[far] = (lead[far] & 7) << 18 | one[far] << 12 | two[far] << 6 | padded[at[far] + 3] & 63
    return np.where(point < 1 << _CODE, _letters[0][np.minimum(point, (1 << _CODE) - 1)], 0), at


def gram_counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group, n-gram and count, sorted by group and n-gram, and which rows have a letter. ``group``: of each row; itself if none."""
    codes, at = letter_codes(data)
    row = np.searchsorted(offsets, at, "right") - 1
    n = len(codes)
    has = np.zeros(len(offsets) - 1, bool)
    has[row[codes > 0]] = True
    # the block's letters by number, in order, so that group and n-gram share one key
    seen = np.zeros(1 << _CODE, bool)
    seen[codes] = seen[0] = True
    letters = np.flatnonzero(seen)
    number = np.zeros(1 << _CODE, np.int64)
    number[letters] = np.arange(len(letters))
    codes = number[codes]
    bits = max(1, int(len(letters) - 1).bit_length())
    code = np.concatenate((codes, [0, 0, 0]))
    owner = np.concatenate((row, [-1, -1, -1]))
    previous = np.concatenate(([0], codes))[:-1]
    previous[1:][row[1:] != row[:-1]] = 0
    a, b, c = (np.where(owner[k : n + k] == row, code[k : n + k], 0) for k in range(3))
    kind = 3 * bits
    letter = a > 0
    begins = letter & (previous == 0)
    parts = [
        (letter, a),
        (letter, 1 << kind | a << bits | b),
        (begins, 1 << kind | a),  # blank before a word
        (letter & (b > 0), 2 << kind | a << 2 * bits | b << bits | c),
        (begins, 2 << kind | a << bits | b),
    ]
    mine = row if group is None else group[row]
    gram, high = np.concatenate([g[w] for w, g in parts]), np.concatenate([mine[w] for w, _ in parts])
    width, names = kind + 2, None
    if width + int(high.max(initial=0)).bit_length() > 62:  # very many letters: the n-grams by number
        names, gram = np.unique(gram, return_inverse=True)
        width = max(1, int(len(names)).bit_length())
    keys, count = _counted(high << width | gram)
    gram = keys & (1 << width) - 1
    gram = gram if names is None else names[gram]
    one = (1 << bits) - 1
    wide = gram >> kind << 3 * _CODE
    for k in range(3):
        wide |= letters[gram >> k * bits & one] << k * _CODE
    return keys >> width, wide, count, has


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.concatenate((first, [len(keys)])))


def learn(docs: DataFrame, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's grams in order of rank, from all rows of ``docs`` (text, lang).

    Counts are summed per partition, then by Spark. The rank limit goes below the shuffle (WindowGroupLimit): a task
    sends its best ``profile`` grams of each language, and as many a language come to the driver.
    """

    def count(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def summed(name: str) -> None:
            parts = held.pop(name) + ([total[name]] if name in total else [])
            grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            total[name] = grams, np.bincount(at, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lo, hi, data, offsets in blocks(batch.column(0)):
                names, number = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                group, grams, n, _ = gram_counts(data, offsets, number)
                for i, name in enumerate(names):
                    mine = group == i
                    held.setdefault(name, []).append((grams[mine], n[mine]))
                    if sum(len(g) for g, _ in held[name]) > MERGE:
                        summed(name)
        for name in list(held):
            summed(name)
        for name, (grams, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(n)), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    counts = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    found: dict[str, list[int]] = {}
    for lang, gram in counts.withColumn("rank", rank).where(F.col("rank") <= profile).orderBy("lang", "rank").select("lang", "gram").collect():
        found.setdefault(lang, []).append(gram)
    return {x: np.array(grams, np.int64) for x, grams in found.items()}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], own: int = OWN) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs`` (doc_id, text). Score: how far the best is ahead, 0 to 1."""
    langs = sorted(profiles)
    known = np.unique(np.concatenate([profiles[x] for x in langs])) if langs else np.empty(0, np.int64)
    absent = max((len(p) for p in profiles.values()), default=0)
    ranks = np.full((len(langs), len(known) + 1), absent, np.int64)
    for i, x in enumerate(langs):
        ranks[i, np.searchsorted(known, profiles[x])] = np.arange(len(profiles[x]))

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                rows = hi - lo
                row, gram, n, has = gram_counts(data, offsets)
                order = np.argsort(row << 40 | (1 << 40) - 1 - n, kind="stable")
                row, gram = row[order], gram[order]
                place = np.arange(len(row)) - np.searchsorted(row, np.arange(rows))[row]
                top = place < own
                row, gram, place = row[top], gram[top], place[top]
                if langs:
                    spot = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                    spot = np.where(known[spot] == gram, spot, len(known))
                    cost = np.array([np.bincount(row, np.where(r[spot] == absent, absent, np.abs(r[spot] - place)), rows) for r in ranks])
                    best = cost.argmin(axis=0)
                    least = cost.min(axis=0)
                    second = np.partition(cost, 1, axis=0)[1] if len(langs) > 1 else absent * np.bincount(row, minlength=rows)
                    score = np.where(has, (second - least) / np.maximum(second, 1), 0.0)
                    names = np.where(has, np.array(langs, object)[best], "und")
                else:
                    names, score = np.full(rows, "und", object), np.zeros(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
