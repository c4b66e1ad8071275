"""BPE encoding and decoding that reuses content-defined chunks.

Texts are cut where a rolling hash of the bytes says so, so that equal passages in different documents give equal
chunks. Each distinct chunk of a task is encoded once and kept; documents are then put together from chunks.
At each joint, the text around it is encoded anew, from some tokens before it to some after. If the result begins with
the tokens the left chunk has there and ends with those of the right, the joint takes the new tokens; if not, the
stretch is widened until both ends agree, at most to both neighbouring chunks whole, and then further.

A joint between a character that isn't a space and one that is falls between two pre-tokens of a byte-level BPE
whatever stands around it, so such joints agree at once; cuts prefer them. Others, in texts without spaces, are mended.

Documents that share chunks meet: each is dealt by the least hash of its chunks (a MinHash of its set of them), so
copies and documents with many common chunks come to one task, where a shared chunk is encoded once and then found in the
task's cache, which drops what was used longest ago. Encodings themselves aren't shuffled: the ids of a passage are no
smaller than its text. A hash that many documents have (a text that is copied very often) is dealt over several tasks
by document; a seeded sample tells which, and sets only where rows go. Memory is bounded by ``CACHE`` chunks and by runs of
texts of 256 KB; a longer text is encoded alone. Decoding maps the ids to bytes.

A null text counts as empty: no tokens, empty decoded text. Repeated rows get equal results. An empty table gives an
empty one. Ids are of any type. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm import textops as T
from tidemark.llm.common import stored, task_count, utf8_rows

#: A chunk ends where the low bits of the hash of the last WINDOW bytes are all 0: every 2 ** BITS bytes or so.
WINDOW, BITS, LEAST, MOST = 32, 10, 256, 8192
CACHE = 8_000
#: Bytes of text to a task (fewer where there are more cores than such tasks), and of the sample that looks for hot hashes.
TASK_BYTES, SAMPLE_BYTES = 32 << 20, 64 << 20
#: Characters that a joint's new encoding reaches to each side at first.
REACH = 24
ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "boolean": pa.bool_()}


def cuts(text: str) -> list[int]:
    """Character positions at which the text is cut, its end included, its start not."""
    raw = np.frombuffer(text.encode(), np.uint8)
    out = byte_cuts(raw)
    if len(raw) == len(text):
        return out
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    return [int(char_of[x]) if x < len(raw) else len(text) for x in out]


def byte_cuts(raw: np.ndarray) -> list[int]:
    """The same positions in bytes."""
    n = len(raw)
    if n <= LEAST:
        return [n]
    prefix = T.prefix_sums(raw)
    hashes = (prefix[WINDOW:] - prefix[:-WINDOW]) * T.inverse_powers(n + 1)[: n - WINDOW + 1]
    marks = np.flatnonzero((hashes >> np.uint64(40)) & np.uint64((1 << BITS) - 1) == 0) + WINDOW
    space = T.is_space(raw)
    good = np.flatnonzero(space[1:] & ~space[:-1]) + 1  # a space after something else
    start = np.flatnonzero((raw & 0xC0) != 0x80)
    out, at = [], 0
    marks = list(marks) + [n]
    i = 0
    while n - at > LEAST:
        while i < len(marks) and marks[i] < at + LEAST:
            i += 1
        end = min(marks[i] if i < len(marks) else n, at + MOST)
        if end >= n and n - at <= MOST:
            break
        j = np.searchsorted(good, end)
        if j < len(good) and good[j] <= end + 512:
            end = int(good[j])
        else:  # no space near: the next character's start
            j = np.searchsorted(start, end)
            end = int(start[j]) if j < len(start) else n
        if end >= n:
            break
        out.append(end)
        at = end
    out.append(n)
    return out


def least_chunk(raw: np.ndarray) -> int:
    """The least hash of a text's chunks."""
    if not len(raw):
        return 0
    ends = np.array(byte_cuts(raw))
    return int(T.range_hashes(T.prefix_sums(raw), np.concatenate(([0], ends[:-1])), ends).min())


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others in turn."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}


class Codec:
    """Encodes and decodes texts with a byte-level BPE, chunk by chunk.

    ``path``: the tokenizer's JSON. ``ranks``: the same vocabulary as ranks, if there is one; chunks of Latin letters
    are then encoded by the faster library, which gives the same ids. ``pattern``: how that one finds pre-tokens.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.kept: OrderedDict[str, np.ndarray] = OrderedDict()
        self.agreed: OrderedDict[str, bool] = OrderedDict()
        self.cache, self.asked, self.encoded, self.mended = cache, 0, 0, 0
        byte_of = _byte_of()
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            pieces[i] = name.encode() if name in self.added else bytes(byte_of[c] for c in name)
        self.sizes = np.array([len(x) for x in pieces], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def plain(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, characters up to each token's start) of whole strings."""
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [(np.array(x.ids, np.uint32), np.array([o[0] for o in x.offsets], np.int64)) for x in found]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole strings."""
        quick = [self.fast is not None and len(x) <= 2 * MOST and (x.isascii() or max(x) < "\u0250") and not any(t in x for t in self.added) for x in texts]
        slow = iter(self.tokenizer.encode_batch([x for x, q in zip(texts, quick, strict=True) if not q], add_special_tokens=False))
        return [np.array(self.fast.encode_ordinary(x) if q else next(slow).ids, np.uint32) for x, q in zip(texts, quick, strict=True)]

    def chunks(self, wanted: list[str]) -> dict[str, np.ndarray]:
        """Encodings of the chunks; each is made once and kept until ``cache`` others have been used since."""
        self.asked += len(wanted)
        distinct = dict.fromkeys(wanted)
        new = [x for x in distinct if x not in self.kept]
        self.encoded += len(new)
        for x in distinct:
            if x in self.kept:
                self.kept.move_to_end(x)
        self.kept.update(zip(new, self.ids(new), strict=True))
        found = {x: self.kept[x] for x in distinct}
        _trim(self.kept, self.cache)
        return found

    def joint(self, left: str, right: str) -> tuple[int, np.ndarray, int] | None:
        """(tokens of the left to keep, new tokens, tokens of the right to skip), or None if the whole chunks don't agree."""
        reach = REACH
        a, b = self.plain([left, right])
        while True:
            whole = reach >= len(left) and reach >= len(right)
            i = int(np.searchsorted(a[1], max(0, len(left) - reach)))
            i = min(i, len(a[0]) - 1)
            j = int(np.searchsorted(b[1], min(reach, len(right))))
            begin, end = int(a[1][i]), int(b[1][j]) if j < len(b[0]) else len(right)
            ids, at = self.plain([left[begin:] + right[:end]])[0]
            joint_at = len(left) - begin
            before = int(np.searchsorted(at, max(1, joint_at // 2)))
            after = len(ids) - int(np.searchsorted(at, joint_at + max(1, (end + 1) // 2)))
            # both ends must agree on some tokens: as many as lie in the outer halves
            if 0 < before <= len(a[0]) - i and 0 < after <= j and np.array_equal(ids[:before], a[0][i : i + before]) and np.array_equal(ids[len(ids) - after :], b[0][j - after : j]):
                return i, ids, j
            if whole:
                return None
            self.mended += 1
            reach *= 4

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as if each were encoded whole."""
        parts = []
        for text in texts:
            at = [0, *cuts(text)] if text else [0]
            parts.append([text[p:q] for p, q in zip(at, at[1:], strict=False)])
        kept = self.chunks([x for p in parts for x in p])
        return [self._joined(p, kept) for p in parts]

    def _joined(self, pieces: list[str], kept: dict[str, np.ndarray]) -> np.ndarray:
        out: list[np.ndarray] = []
        left = ""
        for piece in pieces:
            ids = kept[piece]
            if left and not (not left[-1].isspace() and piece[0] in " \t\n\x0b\x0c\r" and self._agrees(left, piece)):
                before = out.pop()
                found = self.joint(left, piece)
                if found is None:  # they don't agree anywhere: both become one chunk
                    size = len(kept[left]) if left in kept else len(self.ids([left])[0])
                    left += piece
                    ids = np.concatenate((before[: len(before) - size], self.ids([left])[0]))
                    out.append(ids)
                    continue
                keep, new, skip = found
                size = len(kept[left]) if left in kept else len(self.ids([left])[0])
                out.append(before[: len(before) - (size - keep)])
                ids = np.concatenate((new, ids[skip:]))
            out.append(ids)
            left = piece
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def _agrees(self, left: str, right: str) -> bool:
        """Whether the word before the joint and the one after it encode the same together as apart; kept as chunks are."""
        p = max(left.rfind(" "), left.rfind("\n"), len(left) - 64, 0)
        q = 1
        while q < min(len(right), 64) and not (right[q].isspace() and not right[q - 1].isspace()):
            q += 1
        key = f"{left[p:]}\x00{right[:q]}"
        if key not in self.agreed:
            whole, one, two = self.ids([left[p:] + right[:q], left[p:], right[:q]])
            self.agreed[key] = np.array_equal(whole, np.concatenate((one, two)))
            _trim(self.agreed, self.cache)
        self.agreed.move_to_end(key)
        return self.agreed[key]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each row of ids; bytes that form no character become U+FFFD."""
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        sizes = self.sizes[flat]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.bytes[np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(self.starts[flat], sizes)].tobytes()
        at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)]
        return [raw[p:q].decode("utf-8", "replace") for p, q in zip(at, at[1:], strict=False)]


def _trim(kept: OrderedDict, most: int) -> None:
    while len(kept) > most:
        kept.popitem(last=False)


_codecs: dict[str, Codec] = {}


def _codec(tokenizer: dict) -> Codec:
    """One for each tokenizer in a worker, so that tasks after the first neither load it again nor hold it twice."""
    key = repr(sorted(tokenizer.items()))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(**tokenizer)
    return _codecs[key]


def groups(sizes: list[int], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``limit`` bytes; a longer text is a run of its own or ends one."""
    lo = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


@F.arrow_udf(LongType())
def _least_chunks(texts: pa.Array) -> pa.Array:
    data, offsets = utf8_rows(texts)
    return pa.array(np.array([least_chunk(data[p:q]) for p, q in zip(offsets, offsets[1:], strict=False)], np.uint64).view(np.int64))


def gathered(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) dealt to tasks of about TASK_BYTES (see ``task_count``) so that rows which share chunks meet."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    total = docs.agg(F.sum(size)).first()[0] or 0
    tasks = task_count(docs.sparkSession, total, TASK_BYTES)
    fair = max(1, total // tasks)
    share = min(1.0, SAMPLE_BYTES / max(1, total))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000)).select(_least_chunks("text").alias("least"), size.alias("size"))
    hot = some.groupBy("least").agg((F.sum("size") / (share * fair)).cast("int").alias("spread")).where("spread > 0")
    hot = F.broadcast(stored(hot))  # a row for each task's share of bytes, so no more than there are tasks
    dealt = docs.withColumn("least", _least_chunks("text")).join(hot, "least", "left")
    salt = F.when(F.col("spread").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), 2 * F.col("spread")))
    return dealt.withColumn("salt", salt).repartition(tasks, "least", "salt").select("doc_id", "text")


def coded(docs: DataFrame, tokenizer: dict, schema: str, row: Callable) -> DataFrame:
    """doc_id and ``row(text, ids, decoded)`` for each row of ``docs`` (doc_id, text); ``tokenizer``: what Codec takes."""

    def run(batches):
        codec = _codec(tokenizer)
        for batch in batches:
            for lo, hi in groups(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                part = batch.slice(lo, hi - lo)
                texts = [x or "" for x in part.column(1).to_pylist()]
                ids = codec.encode(texts)
                rows = [row(*x) for x in zip(texts, ids, codec.decode(ids), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    names = ["doc_id", *(f.split()[0] for f in schema.split(", "))]
    types = [ARROW[f.split()[1]] for f in schema.split(", ")]
    return gathered(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {schema}")


def digests(docs: DataFrame, tokenizer: dict) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text."""

    def row(text, ids, decoded):
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return coded(docs, tokenizer, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def encoded(docs: DataFrame, tokenizer: dict) -> DataFrame:
    """doc_id, the ids themselves, and whether they decode to the text again."""
    return coded(docs, tokenizer, "ids array<int>, exact boolean", lambda text, ids, decoded: (ids.astype(np.int32), decoded == text))
