"""Removal of long repeated byte strings: suffix arrays, by threshold-bounded interval expansion.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Every string of that length has an
anchor: its leftmost ``GRAM``-byte piece of least hash. Equal strings have equal anchors at equal places, so it is enough to
compare what stands around equal pieces:

1. Equal texts become one, with a weight. Each text is cut into segments: an anchor and all strings that choose it.
2. Spark counts the anchors' pieces. Segments whose piece occurs once hold nothing that repeats. Of the others each
   different segment is taken once, with the number of its occurrences. Where all segments with a piece are equal,
   so that nothing is left to compare, all their strings repeat.
3. Segments with equal pieces meet in a block. A block's suffix array and Burrows-Wheeler transform are built, and
   breadth-first backward extension over its intervals derives the longest common prefixes by increasing value. It
   stops at ``LENGTH``: wherever it hasn't set a value by then, neighbours in the suffix array share that many bytes.
4. Strings in such runs, or in segments that occur more than once, are marked; the marks return to the texts.

Blocks hold ``BLOCK`` bytes or so. A piece with more than ``CROWD`` different segments isn't put into one block: its strings
are dealt by their distance to the anchor, in halves, and by the bytes that all strings of a half have around it. Equal
strings stay together, groups get smaller, and the same expansion runs on them; what is still crowded is halved again, to
one distance at last, where all strings of a group are equal. So no group is ever gathered, and nothing is capped.

Null texts count as empty. Rows with a null or repeated id are texts of their own. Texts shorter than ``LENGTH`` keep all.
Very long texts are cut into segments in a block of their own. An empty table gives an empty one. Ids must be numbers.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as T
from tidemark.llm.common import blocks, stored

LENGTH, GRAM = 200, 64
BLOCK = 1 << 20
#: A group with more different segments than this is dealt by finer pieces.
CROWD = 2000
_REACH = LENGTH - GRAM + 1  # pieces in a string
_PLACE = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours."""
    n = len(x) - w + 1
    pad = -len(x) % w
    cells = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    left = np.minimum.accumulate(cells, axis=1).ravel()
    right = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first string's start (in the row), last string's start, anchor's place, hashes of its piece and of the
    whole segment, of all segments of all rows."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none
    prefix = T.prefix_sums(data)
    inverse = T.inverse_powers(len(data) + 1)
    at = np.arange(len(data) - GRAM + 1)
    grams = T.mix((prefix[GRAM:] - prefix[:-GRAM]) * inverse[: len(at)])
    least = _sliding_min((grams & ~_PLACE) | (at.astype(np.uint64) & _PLACE), _REACH)
    starts = np.arange(n)
    anchor = starts + ((least & _PLACE).astype(np.int64) - starts) % (1 << 24)
    row = np.searchsorted(offsets, starts, "right") - 1
    valid = starts + LENGTH <= offsets[row + 1]
    anchor, row, starts = anchor[valid], row[valid], starts[valid]
    if not len(starts):
        return none
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])) + 1
    first = np.concatenate(([0], change))
    last = np.concatenate((change - 1, [len(starts) - 1]))
    a, b, own = starts[first], starts[last], anchor[first]
    whole = T.range_hashes(prefix, a, b + LENGTH) ^ T.mix((own - a).astype(np.uint64) + np.uint64(1))
    base = offsets[row[first]]
    return row[first], a - base, b - base, own - base, grams[own], whole


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffix array of a block to the depth of LENGTH bytes at least, by doubling; equal prefixes stay in any order."""
    n = len(x)
    padded = np.concatenate((x, np.zeros(8, x.dtype))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(7):  # symbols have 9 bits
        key = key << np.uint64(9) | padded[k : n + k]
    depth = 7
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if depth >= LENGTH or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        if depth < n:
            after[: n - depth] = rank[depth:] + 1
        key = rank.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
        depth *= 2


def open_prefixes(x: np.ndarray, order: np.ndarray, stop: int = LENGTH) -> np.ndarray:
    """Whether suffixes i - 1 and i of the suffix array share ``stop`` symbols, by interval expansion.

    The queue holds the intervals of the suffixes that begin with each string of the current length. Extending them by a
    symbol to the left gives intervals one longer; where such an interval ends, the common prefix with what follows has
    just the length before, unless a shorter one was found there already. The work is in proportion to the values set.
    """
    n = len(x)
    bwt = x[order - 1]  # the symbol before each suffix; the first suffix's is the last symbol, a separator
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)  # where the suffix one longer stands
    step[by_symbol] = np.arange(n)
    is_open = np.ones(n + 1, bool)
    is_open[0] = is_open[n] = False
    lo, hi = np.array([0]), np.array([n])  # half-open intervals
    for length in range(stop):
        if not len(lo):
            break
        size = hi - lo
        total = int(size.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        group = np.repeat(np.arange(len(lo)), size)
        symbol = bwt[inside]
        # neighbours with one symbol in one interval move together
        key = group * 512 + symbol
        by = np.argsort(key, kind="stable")
        key, target = key[by], step[inside[by]]
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        lo = target[cut]
        hi = lo + np.diff(np.concatenate((cut, [total])))
        fresh = is_open[hi] & ((key[cut] % 512 > 0) | (length == 0))  # a separator can only end a string
        lo, hi = lo[fresh], hi[fresh]
        is_open[hi] = False
    return is_open[:n]


def repeated(pieces: list[bytes], weights: np.ndarray) -> list[np.ndarray]:
    """For each piece of a block, the starts of its strings of LENGTH bytes that occur more than once, weights counted."""
    sizes = np.array([len(x) for x in pieces])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    x = np.zeros(begin[-1], np.uint16)
    inside = np.ones(len(x), bool)
    inside[begin[1:] - 1] = False
    x[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + np.uint16(1)
    order = suffix_array(x)
    run = np.cumsum(~open_prefixes(x, order))
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)[order]
    start = order - begin[owner]
    whole = start + LENGTH <= sizes[owner]
    run, owner, start = run[whole], owner[whole], start[whole]
    total = np.bincount(run, weights[owner], minlength=1)
    many = total[run] > 1
    owner, start = owner[many], start[many]
    by = np.lexsort((start, owner))
    owner, start = owner[by], start[by]
    return np.split(start, np.searchsorted(owner, np.arange(1, len(pieces))))


def ranges(starts: np.ndarray) -> np.ndarray:
    """Begin and end, in turn, of the maximal runs of bytes that strings at the (sorted) starts cover."""
    if not len(starts):
        return np.empty(0, np.int64)
    gap = np.flatnonzero(np.diff(starts) > LENGTH)
    return np.stack([starts[np.concatenate(([0], gap + 1))], starts[np.concatenate((gap, [len(starts) - 1]))] + LENGTH], axis=1).ravel()


_KEY = ["id", "h"]
_ANCHORS = "id long, h long, at int, meta int, kh long, sh long"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64("text").alias("h"), "text")


def _grams(batches):
    for batch in batches:
        for _, _, data, offsets in blocks(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(segments(data, offsets)[4].view(np.int64))], ["kh"])


def _anchors(batches):
    for batch in batches:
        ids, hs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for lo, _, data, offsets in blocks(batch.column(2)):
            row, a, b, anchor, kh, sh = segments(data, offsets)
            meta = (anchor - a) << 16 | (b - a)
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo + row]), pa.array(hs[lo + row]), pa.array(a.astype(np.int32)), pa.array(meta.astype(np.int32)), pa.array(kh.view(np.int64)), pa.array(sh.view(np.int64))], ["id", "h", "at", "meta", "kh", "sh"])


def _wanted(batch: pa.RecordBatch):
    """(kh, sh, n, kinds, anchor's place, bytes) of the segments that a joined batch (text, wanted) asks for."""
    lists = batch.column(1)
    flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 6)
    bounds = lists.offsets.to_numpy() // 6
    bounds = bounds - bounds[0]
    for i, text in enumerate(batch.column(0)):
        raw = text.as_buffer()
        view = memoryview(raw)
        for kh, sh, n, kinds, at, meta in flat[bounds[i] : bounds[i + 1]].tolist():
            yield kh, sh, n, kinds, meta >> 16, bytes(view[at : at + (meta & 0xFFFF) + LENGTH])


def _cut(batches):
    for batch in batches:
        rows = list(_wanted(batch))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["kh", "sh", "n", "kinds", "anchor", "piece"])


_PART = "kh long, sh long, off int, g long, b long, n long, lo int, hi int, anchor int, piece binary"


def _halved(batches):
    """Both halves of the distances lo..hi of each part (kh, sh, off, g, n, lo, hi, anchor, piece), as parts of new groups."""
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    names = [f.split()[0] for f in _PART.split(", ")]
    for batch in batches:
        out = []
        for kh, sh, off, g, n, lo, hi, anchor, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            prefix = T.prefix_sums(np.frombuffer(piece, np.uint8))
            mid, strings = (lo + hi) // 2, len(piece) - LENGTH + 1
            for p, q in ((lo, mid), (mid + 1, hi)):
                first, last = max(0, anchor - q), min(strings - 1, anchor - p)
                if first > last or p > q:
                    continue
                ends = np.array([[anchor - p, anchor - q + LENGTH], [first, last + LENGTH]])  # what all strings of the half share, and the part
                core, own = T.range_hashes(prefix, ends[:, 0], ends[:, 1])
                group = T.mix(core + np.array([g], np.int64).view(np.uint64) * np.uint64(3) + np.uint64(p << 8 | q))
                own = own ^ T.mix(np.array([anchor - first + 1], np.uint64))
                out.append((kh, sh, off + first, int(group.view(np.int64)[0]), int(own.view(np.int64)[0]), n, p, q, anchor - first, piece[first : last + LENGTH]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)


def _uncrowded(crowded: DataFrame) -> DataFrame:
    """kh, sh, marks of segments (kh, sh, n, anchor, piece) of crowded pieces: by halves of distances until no group is crowded."""
    now = crowded.dropDuplicates(["kh", "sh"]).select("kh", "sh", F.lit(0).alias("off"), F.col("kh").alias("g"), "n", F.lit(0).alias("lo"), F.lit(LENGTH - GRAM).alias("hi"), "anchor", "piece")
    found = None
    while True:
        parts = stored(now.mapInArrow(_halved, _PART))
        kinds = parts.groupBy("g", "b").agg(F.sum("n").alias("n"), F.first("piece").alias("piece"))
        groups = stored(parts.select("g", "b").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("kinds")))
        few = kinds.join(groups.where(F.col("kinds") <= CROWD), "g", "left_semi").select(F.col("g").alias("kh"), F.col("b").alias("sh"), "n", "piece")
        marks = _expanded(few).select(F.col("kh").alias("g"), F.col("sh").alias("b"), "marks")
        marks = parts.select("kh", "sh", "off", "g", "b").join(marks, ["g", "b"]).select("kh", "sh", F.transform("marks", lambda m: m + F.col("off")).alias("marks"))
        found = marks if found is None else found.unionByName(marks)
        many = groups.where(F.col("kinds") > CROWD)
        if many.isEmpty():
            return found
        now = parts.join(many, "g", "left_semi").select("kh", "sh", "off", "g", "n", "lo", "hi", "anchor", "piece")


def _solved(batches):
    """Blocks of whole groups from rows sorted by kh and sh: the marked ranges of each segment."""

    def flush(held):
        if len(held) > 1 or held and held[0][2] > 1:
            marks = [ranges(x) for x in repeated([r[3] for r in held], np.array([r[2] for r in held], float))]
            out = [(r[0], r[1], m.astype(np.int32)) for r, m in zip(held, marks, strict=True) if len(m)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.list_(pa.int32())))], ["kh", "sh", "marks"])

    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= BLOCK and held[-1][0] != row[0]:
                yield from flush(held)
                held, size = [], 0
            if held and held[-1][:2] == row[:2]:  # the same segment from a row that repeats id and text
                continue
            held.append(row)
            size += len(row[3]) + 1
    yield from flush(held)


def _expanded(pieces: DataFrame) -> DataFrame:
    """kh, sh, marks from whole groups of (kh, sh, n, piece), by interval expansion in blocks."""
    return pieces.repartition("kh").sortWithinPartitions("kh", "sh").mapInArrow(_solved, "kh long, sh long, marks array<int>")


def _kept(keep: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for text, marks in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                spans = np.array(marks or [], np.int64).reshape(-1, 2)
                parts, at, removed, n = [], 0, 0, 0
                end = -1
                for p, q in spans[np.argsort(spans[:, 0], kind="stable")].tolist():
                    if p > end:  # touching runs are one
                        parts.append(raw[at:p])
                        n += 1
                        removed += q - p
                    elif q > end:
                        removed += q - end
                    end = max(end, q)
                    at = end
                parts.append(raw[at:])
                rest = b"".join(parts)
                rows.append((len(raw), removed, n, hashlib.sha256(rest).hexdigest(), rest if keep else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def deduplicated(docs: DataFrame, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (if ``keep``) the kept bytes of each row of ``docs``."""
    keyed = _keyed(docs)
    shared = keyed.select("text").mapInArrow(_grams, "kh long").groupBy("kh").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("kh")
    shared = stored(shared)  # so that a very common piece's rows can be split in the join
    anchors = stored(keyed.mapInArrow(_anchors, _ANCHORS).join(shared, "kh", "left_semi"))
    one = F.min(F.struct("id", "h", "at", "meta")).alias("one")
    kinds = anchors.groupBy("kh", "sh").agg(F.count(F.lit(1)).alias("n"), one)
    kinds = stored(kinds.join(kinds.groupBy("kh").agg(F.count(F.lit(1)).alias("kinds")), "kh"))

    # the bytes of one segment of each kind that has others to compare with: the texts move once for them
    wanted = kinds.where("kinds > 1").select("one.id", "one.h", F.array("kh", "sh", "n", "kinds", F.col("one.at").cast("long"), F.col("one.meta").cast("long")).alias("w"))
    wanted = wanted.groupBy("id", "h").agg(F.flatten(F.collect_list("w")).alias("wanted"))
    cut = keyed.join(wanted, _KEY).select("text", "wanted").mapInArrow(_cut, "kh long, sh long, n long, kinds long, anchor int, piece binary")
    cut = stored(cut)  # more than once for rows that repeat id and text

    solved = _expanded(cut.where(F.col("kinds") <= CROWD).select("kh", "sh", "n", "piece"))
    length = F.col("one.meta").bitwiseAND(F.lit(0xFFFF)) + LENGTH
    solved = solved.unionByName(kinds.where("kinds = 1").select("kh", "sh", F.array(F.lit(0), length).alias("marks")))
    crowded = cut.where(F.col("kinds") > CROWD)
    if not crowded.isEmpty():
        solved = solved.unionByName(_uncrowded(crowded))
    marks = anchors.join(solved, ["kh", "sh"]).select("id", "h", F.transform("marks", lambda m: m + F.col("at")).alias("marks"))
    marks = marks.groupBy("id", "h").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64("text").alias("h"), "text")
    out = rows.join(marks, _KEY, "left").select("doc_id", "text", "marks").mapInArrow(_kept(keep), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep else out.drop("kept")
