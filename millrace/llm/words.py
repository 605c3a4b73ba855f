"""Words of many texts at once, on the bytes of Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are split at once; a longer text is split whole.
SLICE_BYTES = 1 << 21
WORD, GAP, BREAK = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def byte_classes(gap: bytes, breaks: bytes = b"") -> np.ndarray:
    """Class of each byte: part of a word, between words, or between pieces.  UTF-8 keeps ASCII separators apart from all other characters."""
    table = np.zeros(256, np.uint8)
    table[list(gap)] = GAP
    table[list(breaks)] = BREAK
    return table


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of about SLICE_BYTES of text."""
    ends = np.cumsum([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()])
    begin = 0
    while begin < len(batch):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def split(texts: pa.Array, classes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words with A-Z in lower case, the row of each, and a number that differs between the pieces and between the rows.

    Rows and pieces ascend; null texts have no words.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = classes[raw]
    word = kind == WORD
    starts = offsets[:-1][offsets[:-1] < len(raw)]
    edge = word[1:] != word[:-1]
    first = word.copy()
    first[1:] &= edge
    first[starts] = word[starts]
    last = word.copy()
    last[:-1] &= edge
    last[starts[starts > 0] - 1] = word[starts[starts > 0] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    data = _LOWER[raw[word]]
    at = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=at[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(data)])
    row = np.searchsorted(offsets[1:], begin, "right")
    return words, row, np.searchsorted(np.flatnonzero(kind == BREAK), begin) + row
