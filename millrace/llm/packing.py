"""Sequence packing by non-negative least squares over shallow length combinations.

Whole windows of a document stand alone; its remainder is packed.  The histogram of remainders is small whatever the corpus, so the driver
enumerates combinations of a few lengths that fill a window (or end at a power of two, which needs no padding), solves how often to repeat each
against the histogram, rounds down, and lays the residual remainders end to end, longest first, cutting at window ends.  Every
document then finds its place from the number of remainders of its length before it.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .store import materialize

WINDOW = 2048
END_ID = 1
#: Three-part combinations are enumerated among this many of the most frequent lengths.  All other lengths still fit as pairs or in the residual
#: stream: the bound costs cuts (more pieces), never padding or a document.
TRIPLE_LENGTHS = 48
SOLVER_SWEEPS = 60
_WORDS_KEPT = 900_000
_MARKS = ".,;:!?"


class _Ids(dict):
    """Space-free piece of text to its ids as little-endian 16-bit bytes; starts anew when it has grown large.

    The tokenizer drops white space and never looks across it, so pieces can be encoded one by one.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer
        tokenizer.no_truncation()
        tokenizer.no_padding()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        body = piece.rstrip(_MARKS)
        if body != piece and body[-1:].isascii() and body[-1:].isalnum():
            # Marks never share a piece with letters or digits before them; any other character may be joined to them,
            # and letters beyond ASCII may end in a combining sign once they are normalized and in lower case.
            ids = self[body] + self[piece[len(body) :]]
        elif piece.isascii() and "<|" not in piece and (low := piece.lower()) != piece:  # special tokens are found before lower-casing
            ids = self[low]
        else:
            ids = array("H", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@cache
def _known(name: str) -> _Ids:
    return _Ids(Tokenizer.from_file(public_tokenizers.path(name)))


def encode16(text: str | None, name: str = "word_bpe_49k.json") -> bytes:
    """Ids of a whole text and the end id, as little-endian 16-bit bytes; null is empty."""
    known, text = _known(name), text or ""
    # str.split also splits at four control characters that are no white space to the tokenizer.
    pieces = [text] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
    return b"".join([known[p] for p in pieces]) + END_ID.to_bytes(2, "little")


def combinations(hist: np.ndarray, window: int = WINDOW) -> list[tuple[int, ...]]:
    """Lengths, at most three, whose sum is the window or a power of two; only lengths that occur."""
    have = {int(r) for r in np.flatnonzero(hist)}
    out = [(r,) for r in have if r & (r - 1) == 0]
    out += [(window - r, r) for r in have if window - r in have and r <= window - r]
    top = sorted(sorted(have, key=lambda r: (-hist[r], r))[:TRIPLE_LENGTHS])
    out += [(window - a - b, b, a) for i, a in enumerate(top) for b in top[i:] if window - a - b >= b and window - a - b in have]
    return sorted(set(out))


def solve(hist: np.ndarray, combos: list[tuple[int, ...]]) -> np.ndarray:
    """Repeat counts of the combinations: non-negative least squares against the histogram by coordinate descent."""
    x, rest = np.zeros(len(combos)), hist.astype(float).copy()
    parts = [np.unique(c, return_counts=True) for c in combos]
    for _ in range(SOLVER_SWEEPS):
        moved = 0.0
        for k, (r, m) in enumerate(parts):
            step = max(-x[k], float(rest[r] @ m) / float(m @ m))
            x[k] += step
            rest[r] -= step * m
            moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


class Plan:
    """Where the k-th remainder of each length goes: runs of ranks for each combination, then the residual stream."""

    def __init__(self, hist: np.ndarray, window: int = WINDOW) -> None:
        self.window, left = window, hist.astype(np.int64).copy()
        combos = combinations(hist, window)
        x = solve(hist, combos)
        begin: list[list[int]] = [[] for _ in range(window)]  # first rank, first sequence, repeats in one sequence, offset, of each run
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(window)]
        used, self.sequences = np.zeros(window, np.int64), 0
        for k in np.argsort(-x, kind="stable"):
            lengths, times = np.unique(combos[k], return_counts=True)
            n = int(min([int(x[k] + 1e-6), *(left[lengths] // times)]))
            if n <= 0:
                continue
            offset = 0
            for r, m in zip(lengths[::-1].tolist(), times[::-1].tolist(), strict=True):
                begin[r].append(int(used[r]))
                runs[r].append((self.sequences, m, offset))
                used[r] += n * m
                left[r] -= n * m
                offset += r * m
            self.sequences += n
        self.begin = [np.array(b, np.int64) for b in begin]
        self.runs, self.used = runs, used
        sizes = left * np.arange(window)
        self.stream = np.zeros(window, np.int64)  # where the residual of a length begins; the longest lie first
        self.stream[::-1] = np.cumsum(sizes[::-1]) - sizes[::-1]

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, tokens) of the pieces of the rank-th remainder of this length."""
        if rank < self.used[length]:
            k = int(np.searchsorted(self.begin[length], rank, "right")) - 1
            seq, m, offset = self.runs[length][k]
            q, slot = divmod(rank - int(self.begin[length][k]), m)
            return [(seq + q, offset + slot * length, length)]
        at = int(self.stream[length]) + (rank - int(self.used[length])) * length
        out = []
        while length:
            q, offset = divmod(at, self.window)
            n = min(length, self.window - offset)
            out.append((self.sequences + q, offset, n))
            at, length = at + n, length - n
        return out


def pack_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of every document.

    Null and empty texts are the end id alone.  Each row is packed, repeated ones too; a null doc_id stays null.  Other columns are not read, and
    an empty table gives an empty result.  Whole texts are encoded
    once and kept as 16-bit ids in the shared folder.  The driver holds the histogram of remainders (``window`` counts); the numbers of
    remainders before each input partition are summed per length in Spark.  Only the last sequence is padded.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, whole, part = np.zeros(window, np.int64), 0, TaskContext.get().partitionId()
        for b in batches:
            ids = [encode16(t) for t in b.column("text").to_pylist()]
            n = np.array([len(i) // 2 for i in ids], np.int64)
            rest, rank = n % window, np.zeros(len(n), np.int64)
            for k, r in enumerate(rest):
                rank[k] = seen[r]
                seen[r] += 1
            full = n // window
            columns = [pa.array(np.full(len(n), part, np.int32)), b.column("doc_id"), *map(pa.array, (n, rest, rank, whole + np.cumsum(full) - full)), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "n", "rest", "rank", "chunk", "ids"])
            whole += int(full.sum())

    schema = "part int, doc_id bigint, n bigint, rest bigint, rank bigint, chunk bigint, ids binary"
    # Arrow batches carry the ids through as they are: pandas would make them floats beside a null.
    coded = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokens, schema))
    counts = materialize(coded.groupBy("part", "rest").agg(F.count("*").alias("rows"), F.sum(F.floor(F.col("n") / window)).alias("chunks")))
    hist = np.zeros(window, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("rows").alias("rows")).collect():  # one row per length
        hist[r["rest"]] = r["rows"]
    hist[0] = 0
    plan = Plan(hist, window)
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each input partition, ordered as one.
    chunks = counts.groupBy("part").agg(F.sum("chunks").alias("c"))
    first = chunks.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("chunk0"))
    n_chunks = chunks.agg(F.sum("c")).first()[0] or 0
    offsets = materialize(counts.select("part", "rest", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rank0")).join(first, "part"))
    placed = coded.join(offsets, ["part", "rest"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            out = []
            cols = (b.column(c).to_pylist() for c in ("n", "rest", "rank", "rank0", "chunk", "chunk0", "ids"))
            for k, (n, rest, rank, rank0, chunk, chunk0, ids) in enumerate(zip(*cols, strict=True)):
                ids = np.frombuffer(ids, "<u2").astype("<u4")
                spots = [(chunk0 + chunk + i, 0, window) for i in range(n // window)]
                spots += [(n_chunks + s, o, m) for s, o, m in plan.place(rest, rank0 + rank)] if rest else []
                at = 0
                for seq, offset, m in spots:
                    out.append((k, at, m, zlib.crc32(ids[at : at + m].tobytes()), n, seq, offset))
                    at += m
            table = np.array(out, np.int64).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(table[:, 0])), *(pa.array(table[:, i + 1]) for i in range(6))], ["doc_id", *names])

    return placed.select("doc_id", "n", "rest", "rank", "rank0", "chunk", "chunk0", "ids").mapInArrow(pieces, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
