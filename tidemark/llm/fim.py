"""Fill-in-the-middle transformation: texts cut in three and put together anew, with a sparse index of exceptions.

A text is cut into units (lines, or characters); two cuts drawn by a hash of its id part it into prefix, middle and
suffix, which are written with sentinels in one of two orders. Bytes are what is cut, code points what is counted. Each
converts into the other by an index of the exceptions alone: where a block's multibyte characters stand and how many bytes
they have beyond one, summed up. A binary search in it converts any number of cuts at once; between exceptions positions
differ by a constant, so ASCII text has an empty index and needs no table at all.

A text that has no characters, or one of the sentinels in it, stays as it is (``plain``). Null texts count as empty, a
null id as ''. Very long texts are a block of their own and cost their own length in memory. Rows with the same id are
cut by the same hash; repeated rows give repeated rows. Empty tables give empty ones. Other columns are left out,
whatever their names. Ids are of any type that casts to a string, and come back as they were.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blocks

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
NEWLINE = 10


class Exceptions:
    """The multibyte characters of a run of UTF-8 bytes: byte and code point of each, bytes beyond one up to each."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.excess = np.concatenate(([0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0)))).astype(np.int64)
        self.char = self.at - self.excess[:-1]

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Code points before byte positions, each of which is a character's first."""
        return at - self.excess[np.searchsorted(self.at, at)]

    def bytes(self, chars: np.ndarray) -> np.ndarray:
        """Bytes before code points."""
        return chars + self.excess[np.searchsorted(self.char, chars)]


def _drawn(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smaller and the larger of two cuts among 0 .. n."""
    a, b = hashes[:, 0] % (n + 1), hashes[:, 1] % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def cut_lines(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, byte of the first cut, byte of the second) for each row; a last line needs no line feed."""
    ends = np.flatnonzero(data == NEWLINE) + 1
    start, end = offsets[:-1], offsets[1:]
    first, after = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "right")
    whole = after - first
    closed = np.zeros(len(start), bool)
    closed[whole > 0] = ends[after[whole > 0] - 1] == end[whole > 0]
    n = whole + ((end > start) & ~closed)
    ends = np.append(ends, len(data))

    def at(k: np.ndarray) -> np.ndarray:
        return np.where(k == 0, start, np.where(k >= n, end, ends[np.minimum(first + np.maximum(k, 1) - 1, len(ends) - 1)]))

    low, high = _drawn(hashes, n)
    return n, at(low), at(high)


def cut_chars(index: Exceptions, offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with each code point a unit."""
    chars = index.chars(offsets)
    n = np.diff(chars)
    low, high = _drawn(hashes, n)
    return n, index.bytes(chars[:-1] + low), index.bytes(chars[:-1] + high)


def _check(sentinels: tuple[str, str, str]) -> None:
    for i, x in enumerate(sentinels):
        for j, y in enumerate(sentinels):
            if not x or i != j and y in x or any(x.endswith(y[:k]) for k in range(1, len(y))):
                raise ValueError(f"sentinels must not overlap: {x!r} and {y!r}")


def transformed(docs: DataFrame, seed: str = "7", rate: int = 100, spm: int = 50, unit: str = "lines", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output for each row of ``docs`` (doc_id, text).

    Of the texts ``rate`` per cent are transformed, ``spm`` per cent of these with the suffix first. The two cuts and both
    draws are the first four 32-bit numbers of the SHA-256 of seed, colon and id, so they depend on nothing but these.
    """
    _check(sentinels)
    if unit not in ("lines", "characters"):
        raise ValueError(f"unknown unit: {unit!r}")
    mark_p, mark_s, mark_m = (x.encode() for x in sentinels)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                hashes = np.frombuffer(b"".join(part.column(2).to_pylist()), ">u4").reshape(-1, 4).astype(np.int64)
                index = Exceptions(data)
                n, low, high = cut_lines(data, offsets, hashes) if unit == "lines" else cut_chars(index, offsets, hashes)
                plain = (np.diff(offsets) == 0) | (hashes[:, 2] % 100 >= rate)
                for x in sentinels:
                    plain |= pc.fill_null(pc.match_substring(part.column(1), x), False).to_numpy(zero_copy_only=False)
                first = hashes[:, 3] % 100 < spm
                raw, out = data.tobytes(), []
                for a, p, q, z, whole, suffix_first in zip(offsets[:-1].tolist(), low.tolist(), high.tolist(), offsets[1:].tolist(), plain.tolist(), first.tolist(), strict=True):
                    if whole:
                        out.append(raw[a:z])
                    elif suffix_first:
                        out.append(b"".join((mark_s, raw[q:z], mark_p, raw[a:p], mark_m, raw[p:q])))
                    else:
                        out.append(b"".join((mark_p, raw[a:p], mark_s, raw[q:z], mark_m, raw[p:q])))
                at_start, at_low, at_high = (index.chars(x) for x in (offsets[:-1], low, high))
                form = pc.if_else(pa.array(plain), "plain", pc.if_else(pa.array(first), "spm", "psm"))
                counts = [pa.array(x, pa.int64(), mask=plain) for x in (at_low - at_start, at_high - at_low)]
                columns = [part.column(0), pa.array(n, pa.int64()), form, *counts, pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    drawn = F.unhex(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 32))
    rows = docs.select("doc_id", "text", drawn.alias("drawn"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that was transformed, from its form and output: a transformed text has no sentinels of its own."""
    _check(sentinels)
    parts = F.split(output, "|".join(rf"\Q{x}\E" for x in sentinels), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
