"""Quality rules as a short-circuit cascade.

Each rule is an integer test on features of a text. The cost and the rejection rate of every rule are measured by tasks
on a sample of whole texts that a hash chooses; the rules then run in descending order of rejections per cost, each on the
texts that still stand. A feature is computed once for a block: those that the result shows for all rows, the others
only for rows that still stand when a rule first needs them. The order changes the work, never the verdict: a text is
kept if no rule rejects it; ``rejected_by`` names the first rule in that order, so it can differ between runs.

A null or blank text has no words, fails the base test and isn't kept. Repeated rows are judged alike. Rules with equal
rates keep their listed order. Very long texts form blocks of their own. An empty table gives an empty one. Ids must be
numbers. Extra columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as T
from tidemark.llm.common import blocks

#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


class Block:
    """Rows of texts as bytes, with words found once and other features on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        self.start, self.end, self.bounds = T.words(data, offsets)
        self.n_words = np.diff(self.bounds)
        self._prefix = None
        self._have: dict[str, np.ndarray] = {"n_words": self.n_words}

    def has(self, names: tuple[str, ...]) -> bool:
        return all(x in self._have for x in names)

    def of(self, name: str) -> np.ndarray:
        """A feature of all rows, computed once."""
        if name not in self._have:
            self._have[name] = getattr(self, name)()
        return self._have[name]

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = T.prefix_sums(self.data)
        return self._prefix

    def word_chars(self) -> np.ndarray:
        return self.sums(~T.is_space(self.data) & ((self.data & 0xC0) != 0x80))

    def n_symbols(self) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(SYMBOLS)] = True
        return self.sums(table[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of every \\n-split line that has a word."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate((self.offsets[:-1], breaks + 1)), kind="stable")
        ends = np.sort(np.concatenate((self.offsets[1:], breaks)), kind="stable")
        words = np.searchsorted(self.start, ends) > np.searchsorted(self.start, start)
        start, ends = start[words], ends[words]
        return start, ends, np.searchsorted(self.offsets, start, "right") - 1

    def n_lines(self) -> np.ndarray:
        """Lines with a word of each row."""
        return np.bincount(self.lines()[2], minlength=self.rows)

    def n_dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier one, of each row."""
        start, end, row = self.lines()
        keys = np.empty(len(start), [("row", np.int64), ("hash", np.uint64)])
        keys["row"], keys["hash"] = row, T.range_hashes(self.prefix, start, end)
        n = np.bincount(row, minlength=self.rows)
        self._have.setdefault("n_lines", n)
        return n - np.bincount(np.unique(keys)["row"], minlength=self.rows)

    def n_repeat_words(self) -> np.ndarray:
        """Words inside 5-word windows that occur twice or more in the row."""
        hashes = T.range_hashes(self.prefix, self.start, self.end)
        found, first, bounds = T.windows(hashes, self.bounds, WINDOW)
        covered = np.zeros(len(hashes) + 1, np.int64)
        for i in np.flatnonzero(np.diff(bounds) > 1):
            lo, hi = bounds[i], bounds[i + 1]
            own = found[lo:hi]
            ordered = np.sort(own)
            again = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(again):
                again = np.unique(again)
                spot = np.minimum(np.searchsorted(again, own), len(again) - 1)
                begin = first[lo:hi][again[spot] == own]
                np.add.at(covered, begin, 1)
                np.add.at(covered, begin + WINDOW, -1)
        total = np.concatenate(([0], np.cumsum(np.cumsum(covered)[:-1] > 0)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def upper_ascii(self) -> np.ndarray:
        return self.sums((self.data >= 65) & (self.data <= 90))

    def letters(self) -> np.ndarray:
        """ASCII letters and bytes of other scripts' first code units."""
        lower = self.data | 32
        return self.sums(((lower >= 97) & (lower <= 122)) | (self.data >= 0xC0))


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    test: Callable[..., np.ndarray]

    def rejects(self, block: Block) -> np.ndarray:
        return self.test(*(block.of(x) for x in self.needs))


RULES = (
    Rule("symbols", ("n_symbols", "n_words"), lambda symbols, words: 100 * symbols > 40 * words),
    Rule("word_length", ("word_chars", "n_words"), lambda chars, words: (chars < 2 * words) | (chars > 15 * words)),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda dup, lines: 100 * dup > 50 * lines),
    Rule("shouting", ("upper_ascii", "letters"), lambda upper, letters: 100 * upper > 60 * letters),
    Rule("few_letters", ("letters", "word_chars"), lambda letters, chars: 100 * letters < 50 * chars),
)
#: The features that a result with counts shows of every row; rules on them cost nothing more.
COUNTS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

VERDICT = "base_failed boolean, kept boolean, rejected_by string"
SCHEMA = f"doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, {VERDICT}"


def subset(block: Block, alive: np.ndarray) -> Block:
    sizes = np.diff(block.offsets)
    return Block(block.data[np.repeat(alive, sizes)], np.concatenate(([0], np.cumsum(sizes[alive]))))


def base_failed(block: Block) -> np.ndarray:
    """Fewer than ten words, or over a fifth of them in repeated windows; the second is only looked at where the first passes."""
    failed = block.n_words < 10
    if block.has(("n_repeat_words",)):
        return failed | (100 * block.of("n_repeat_words") > 20 * block.n_words)
    at = np.flatnonzero(~failed)
    if len(at):
        part = subset(block, ~failed)
        failed[at] = 100 * part.of("n_repeat_words") > 20 * part.n_words
    return failed


def cascade(block: Block, alive: np.ndarray, rules: tuple[Rule, ...], work: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows stand after the rules, and the rule that rejected each of the others. ``work``: rows whose features a rule had computed."""
    by = np.full(block.rows, None, object)
    part, at = block, np.arange(block.rows)  # the rows that further features are computed for
    for rule in rules:
        standing = alive[at]
        if not standing.any():
            break
        if block.has(rule.needs):
            out = np.flatnonzero(alive & rule.rejects(block))
        else:
            if part is block or 2 * standing.sum() < len(at):
                at = np.flatnonzero(alive)
                part, standing = subset(block, alive) if len(at) < block.rows else block, np.ones(len(at), bool)
            if work is not None and not part.has(rule.needs):
                work[rule.name] = work.get(rule.name, 0) + len(at)
            out = at[standing & rule.rejects(part)]
        alive[out] = False
        by[out] = rule.name
    return alive, by


def _costs(block: Block, rules: tuple[Rule, ...], counts: bool) -> list[tuple[str, float, int, int]]:
    """(rule, seconds, rows, rejected) of each rule on its own."""
    found = []
    for rule in rules:
        took = []
        for _ in range(3):
            fresh = Block(block.data, block.offsets)
            for name in COUNTS if counts else ():
                fresh._have[name] = block.of(name)
            if counts:
                fresh._have["n_lines"] = block.of("n_lines")
            began = time.perf_counter()
            rejected = rule.rejects(fresh)
            took.append(time.perf_counter() - began)
        found.append((rule.name, min(took), block.rows, int(rejected.sum())))
    return found


def _ordered(found: list[tuple[str, float, int, int]], rules: tuple[Rule, ...]) -> list[tuple[Rule, float, float]]:
    by_name = {r.name: r for r in rules}
    rates = [(by_name[name], max(seconds, 1e-9) / rows, rejected / rows) for name, seconds, rows, rejected in found if rows]
    return sorted(rates, key=lambda x: -(x[2] + 1e-6) / x[1])


def measured(texts: list[str], rules: tuple[Rule, ...] = RULES, counts: bool = False) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a text, share rejected) on some texts, in descending order of rejections per cost."""
    _, _, data, offsets = next(blocks(pa.array(texts, pa.string()), 1 << 40))
    return _ordered(_costs(Block(data, offsets), rules, counts), rules)


def estimated(docs: DataFrame, sample_rows: int, rules: tuple[Rule, ...], counts: bool, seed: int) -> list[tuple[Rule, float, float]]:
    """As ``measured``, by tasks, on about ``sample_rows`` whole texts of ``docs`` (doc_id, text) that a hash chooses."""
    share = sample_rows / max(1, docs.count())
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1_000_000)) < min(1_000_000, int(share * 1_000_000) + 1))

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                rows = list(zip(*_costs(Block(data, offsets), rules, counts), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.float64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64())], ["rule", "seconds", "n", "rejected"])

    sums = some.select("text").mapInArrow(run, "rule string, seconds double, n long, rejected long").groupBy("rule").agg(F.sum("seconds"), F.sum("n"), F.sum("rejected"))
    found = {r[0]: tuple(r) for r in sums.collect()}
    return _ordered([found[r.name] for r in rules if r.name in found], rules)


def quality(docs: DataFrame, sample_rows: int = 400, rules: tuple[Rule, ...] = RULES, seed: int = 7, counts: bool = True) -> DataFrame:
    """The cascade's verdict for each row of ``docs`` (doc_id, text), with the base counts unless ``counts`` is false.

    ``sample_rows`` bounds the sample on which costs and rejection rates are measured; it sets only the order.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [rules.index(rule) for rule, _, _ in estimated(docs, sample_rows, rules, counts, seed)] or list(range(len(rules)))
    schema = SCHEMA if counts else f"doc_id long, {VERDICT}"

    def run(batches):
        ordered = tuple(rules[i] for i in order)
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                b = Block(data, offsets)
                longs = [b.n_words, *(b.of(x) for x in COUNTS)] if counts else []
                failed = base_failed(b)
                kept, by = cascade(b, ~failed, ordered)
                by[failed] = "base"
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in longs), pa.array(failed), pa.array(kept), pa.array(list(by), pa.string())], [f.split()[0] for f in schema.split(", ")])

    return docs.mapInArrow(run, schema)
