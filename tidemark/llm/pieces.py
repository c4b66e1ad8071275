"""SentencePiece encoding and decoding with a table of distinct chunks.

The library turns blanks into markers, sets one before the text, and merges pieces. Where no piece of a model has a marker
behind another character, no merge can cross the place before a run of markers, so a text may be cut there (and before a
run of line feeds, which no piece contains): what stands between two cuts, a marked word, is segmented alike wherever it
stands. Each task keeps a table of the distinct marked words it has met. A block's words are dictionary-encoded, the ones that
the table lacks are segmented by the library, once, and the ids of all are joined back by position, in arrays. Word
counts are so uneven that few words of a block are new; nothing needs a shuffle, and a lost task only fills its table anew.

The table is emptied when its words pass ``TABLE_BYTES``. A word without blanks (a script that has none, a long line of
code) is a chunk however long it is. ``Segmenter`` checks that a model meets the premise and refuses others.

Null texts count as empty: no ids, empty decoded text. Very long texts form a block of their own. Repeated rows get equal
results. Empty tables give empty ones. Other columns are left out, whatever their names. Ids of documents are of any type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import blocks

MARKER = "▁"
#: Bytes of words that a task's table holds at most, besides those of one block.
TABLE_BYTES = 16 << 20
BLANK, NEWLINE = 32, 10


class Segmenter:
    """Encodes and decodes texts with a SentencePiece BPE model, one distinct marked word at a time."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        self._check(proto)
        self.table_bytes, self.asked, self.segmented = table_bytes, 0, 0
        self._clear()

    def _check(self, proto) -> None:
        """Raises unless chunks can be segmented apart: the premise of the table."""
        how, kind = proto.normalizer_spec, proto.trainer_spec
        plain = not how.precompiled_charsmap and how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces
        if not (plain and kind.model_type == kind.BPE and kind.byte_fallback and not kind.treat_whitespace_as_suffix):
            raise ValueError("the model changes texts before it cuts them, or isn't a BPE with bytes")
        normal, own = 1, 4  # kinds of pieces
        for piece in proto.pieces:
            if piece.type == own or piece.type == normal and ("\n" in piece.piece or re.search(f"[^{MARKER}]{MARKER}", piece.piece)):
                raise ValueError(f"a piece can cross a marker: {piece.piece!r}")

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.size = 0
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _segment(self, words: list[str]) -> None:
        """Adds the ids of new words to the table. They are segmented behind a line feed, so that none gets a marker
        of its own; the marker and the line feed that come before are taken off."""
        found = [x[2:] for x in self.model.encode(["\n" + x for x in words], num_threads=1)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        fresh = np.fromiter((i for x in found for i in x), np.int32, int(counts.sum()))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(counts) - counts))
        self.counts, self.ids = np.concatenate((self.counts, counts)), np.concatenate((self.ids, fresh))
        for word in words:
            self.slots[word] = len(self.slots)
        self.size += sum(map(len, words))
        self.segmented += len(words)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of the rows among them) of texts given as ``marked`` bytes."""
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        if self.size > self.table_bytes:
            self._clear()
        starts = word_starts(data, offsets)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [x for x in distinct if x not in self.slots]
        if new:
            self._segment(new)
        self.asked += len(starts)
        slot = np.fromiter((self.slots[x] for x in distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        counts = self.counts[slot]
        ends = np.cumsum(counts)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[slot] - (ends - counts), counts)]
        return ids, np.concatenate(([0], ends))[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        flat = ids.tolist()
        return self.model.decode([flat[p:q] for p, q in zip(bounds, bounds[1:], strict=False)], num_threads=1)


def marked(texts: pa.Array) -> pa.Array:
    """The texts as the model takes them: a blank before each that isn't empty, markers written as blanks."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARKER, " ")
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes at which marked words start: each row, each run of blanks, each run of line feeds."""
    start = np.zeros(len(data) + 1, bool)
    for byte in (BLANK, NEWLINE):
        same = data == byte
        start[0] |= same[0]
        start[1:-1] |= same[1:] & ~same[:-1]
    start[offsets[:-1]] = True
    return np.flatnonzero(start[:-1])


_segmenters: dict[str, Segmenter] = {}


def _segmenter(path: str) -> Segmenter:
    """One for each model in a worker, with the table that earlier tasks have filled."""
    if path not in _segmenters:
        _segmenters.clear()
        _segmenters[path] = Segmenter(path)
    return _segmenters[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array) and what they decode to, for each row of ``docs`` (doc_id, text); ``path``: the model's file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(path)
        for batch in batches:
            texts = marked(batch.column(1))
            for lo, hi, data, offsets in blocks(texts):
                ids, bounds = segmenter.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, pa.array(segmenter.decode(ids, bounds), pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, decoded string")
