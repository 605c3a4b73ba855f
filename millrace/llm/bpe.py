"""Byte-level BPE by tree concatenation.

A long text is cut in halves down to leaves, the leaves are encoded in parallel, and neighbours are joined up the
tree: the bytes around a join are encoded again in a growing window until its tokens agree with both sides.  Agreement counts only where it
proves the whole (``Window.proves``), in text of any script.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF_CHARS = 1 << 14
#: Texts longer than this are cut into leaves that Spark deals out to other tasks.
SPREAD_CHARS = 1 << 16
WINDOW_BYTES = 128
END_OF_TEXT = "<|endoftext|>"


@cache
def encoding(name: str = "byte_bpe_50k.tiktoken") -> tiktoken.Encoding:
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


@cache
def token_bytes() -> list[bytes]:
    e = encoding()
    return [e.decode_single_token_bytes(i) for i in range(e.n_vocab)]


@cache
def token_sizes() -> np.ndarray:
    return np.array([len(b) for b in token_bytes()], np.int64)


def encode_leaf(text: str) -> list[int]:
    return encoding().encode(text, allowed_special="all")


class _Classes(dict):
    """Kind of a character to the split pattern: letter, number, white space, other; ``?`` where libraries may differ."""

    def __missing__(self, c: str) -> str:
        k = unicodedata.category(c)
        self[c] = k = "?" if c in "\x1c\x1d\x1e\x1f" or k == "Cn" else "W" if c.isspace() else k[0] if k[0] in "LN" else "O"
        return k


_CLASS = _Classes()


class Window:
    """The text around a join, encoded on its own.

    ``begin`` and ``end`` are its place in the joined text's raw bytes, ``first`` and ``last`` say that it reaches that text's ends.
    """

    def __init__(self, raw: bytes, first: bool, last: bool) -> None:
        cut, stop = 0, len(raw)
        while cut < stop and raw[cut] & 0xC0 == 0x80:  # a token may begin or end inside a character
            cut += 1
        while stop > cut and raw[stop - 1] & 0xC0 == 0x80:
            stop -= 1
        if stop > cut and raw[stop - 1] >= 0xC0:
            stop -= 1
        stop = len(raw) if _whole(raw[stop:]) else stop
        self.text, self.first, self.last = raw[cut:stop].decode(), first, last
        self.tokens = encode_leaf(self.text)
        self.begin = cut + np.concatenate([[0], np.cumsum(token_sizes()[self.tokens])]).astype(np.int64)
        self.where = {int(p): k for k, p in enumerate(self.begin)}
        self.chars = cut + np.concatenate([[0], np.cumsum([len(c.encode()) for c in self.text])]).astype(np.int64)

    def proves(self, w: int) -> bool:
        """Whether a cut before token ``w`` is sure, if a side agrees that a token ends here (in a run: on the token before it as well).

        Sure is where the split pattern ends a piece whatever lies around: between unlike kinds of characters, but for white space
        before and an apostrophe, which may begin a contraction.  So is a cut inside a long run of one kind, which is one piece: tokens that are right pair
        by pair are right as a sequence.
        """
        p, t = int(self.begin[w]), self.text
        k = int(np.searchsorted(self.chars, p))
        around = t[max(0, k - len(END_OF_TEXT) + 1) : k + len(END_OF_TEXT) - 1]
        if END_OF_TEXT in around or (k < len(END_OF_TEXT) and not self.first) or (k > len(t) - len(END_OF_TEXT) and not self.last):
            return False
        if self.chars[k] == p and 0 < k < len(t):
            x, y = _CLASS[t[k - 1]], _CLASS[t[k]]
            if "?" not in (x, y) and x != "W" and x != y and (y == "W" or t[k - 1] != "'"):
                return True
        if w == 0:
            return False
        begins = int(np.searchsorted(self.chars, self.begin[w - 1], "right")) - 1
        run = t[max(0, begins - 3) : k + 2]
        return begins >= 3 and k + 2 <= len(t) and len(kinds := {_CLASS[c] for c in run}) == 1 and "?" not in kinds


def _whole(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def join_tokens(left: list[int], right: list[int]) -> list[int]:
    """The encoding of the joined text, from the encodings of its two parts."""
    if not left or not right:
        return left or right
    sizes, names = token_sizes(), token_bytes()
    i, j, n_l, n_r, width = len(left), 0, 0, 0, WINDOW_BYTES
    while True:
        while i > 0 and n_l < width:
            i -= 1
            n_l += int(sizes[left[i]])
        while j < len(right) and n_r < width:
            n_r += int(sizes[right[j]])
            j += 1
        window = Window(b"".join([names[t] for t in left[i:]] + [names[t] for t in right[:j]]), i == 0, j == len(right))
        head = (0, 0) if i == 0 else _agree(left, i, len(left), 0, window, False)
        tail = (len(right), len(window.tokens)) if j == len(right) else _agree(right, 0, j, n_l, window, True)
        if head and tail and head[1] <= tail[1]:
            return left[: head[0]] + window.tokens[head[1] : tail[1]] + right[tail[0] :]
        width *= 2


def _agree(side: list[int], begin: int, end: int, at: int, window: Window, backwards: bool) -> tuple[int, int] | None:
    """(token of the side, token of the window) at a place where both cut the text and the cut is sure: far from the join first."""
    places = at + np.concatenate([[0], np.cumsum(token_sizes()[side[begin:end]])])
    steps = range(1, end - begin)
    for s in reversed(steps) if backwards else steps:
        w = window.where.get(int(places[s]))
        if w and side[begin + s - 1] == window.tokens[w - 1] and window.begin[w - 1] == places[s - 1] and window.proves(w):
            return begin + s, w
    return None


def leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    """Halves of halves, none longer than ``size``."""
    if len(text) <= size:
        return [text]
    half = len(text) // 2
    return leaves(text[:half], size) + leaves(text[half:], size)


def join_tree(parts: list[list[int]]) -> list[int]:
    """Join neighbours, level by level."""
    while len(parts) > 1:
        parts = [join_tokens(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def encode(text: str | None) -> list[int]:
    """Token ids of a whole text; null is empty."""
    return join_tree([encode_leaf(t) for t in leaves(text or "")])


def decode(ids: list[int]) -> bytes:
    return encoding().decode_bytes(ids)


@cache
def _decimal() -> list[str]:
    return [str(i) for i in range(encoding().n_vocab)]


_DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _digest(doc_ids: pa.Array, ids: list[list[int]]) -> list[pa.Array]:
    name = _decimal()
    text = [decode(i).decode("utf-8", "replace").encode() for i in ids]
    shas = [hashlib.sha256(",".join([name[t] for t in i]).encode()).hexdigest() for i in ids]
    return [doc_ids, pa.array([len(i) for i in ids], pa.int64()), pa.array(shas, pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in text], pa.string())]


_NAMES = [c.split()[0] for c in _DIGEST.split(", ")]


def bpe_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text.

    Null and empty texts have no tokens.  Texts up to SPREAD_CHARS are encoded where they are read; leaves of longer ones are
    dealt out, and come together as token ids for one join tree per row.  Repeated rows and doc_ids each give their own row, a null doc_id stays
    null.  Other columns are not read, and an empty table gives an empty result.
    """

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                b = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays(_digest(b.column("doc_id"), [encode(t) for t in b.column("text").to_pylist()]), _NAMES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column("text").to_pylist()):
                parts = leaves(text)
                same = pa.array([i] * len(parts))
                yield pa.RecordBatch.from_arrays([b.column("row").take(same), b.column("doc_id").take(same), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())], ["row", "doc_id", "leaf", "text"])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([np.array(encode_leaf(t), "<u2").tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("leaf"), ids], ["row", "doc_id", "leaf", "ids"])

    def tree(g: pa.Table) -> pa.Table:
        g = g.sort_by("leaf")
        parts = [np.frombuffer(x, "<u2").tolist() for x in g.column("ids").to_pylist()]
        return pa.Table.from_arrays(_digest(g.column("doc_id").slice(0, 1).combine_chunks(), [join_tree(parts)]), _NAMES)

    # Arrow batches carry the ids through as they are: pandas would make them floats beside a null.
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    near = slim.where(size <= SPREAD_CHARS).mapInArrow(short, _DIGEST)
    far = slim.where(size > SPREAD_CHARS).withColumn("row", F.monotonically_increasing_id())
    dealt = far.mapInArrow(cut, "row bigint, doc_id bigint, leaf bigint, text string").repartition("row", "leaf")
    joined = dealt.mapInArrow(leaf, "row bigint, doc_id bigint, leaf bigint, ids binary").groupBy("row").applyInArrow(tree, _DIGEST)
    return near.unionByName(joined)
