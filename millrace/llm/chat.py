"""Chat formatting at token level.

Segments (role, text) are encoded on their own, reserved ids are spliced between them, and the loss mask is the running sum of +1 where an
assistant text begins and -1 where it ends.  Control strings inside texts are escaped: one backslash more after ``<|``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoding

#: Reserved names; their ids follow the vocabulary.
RESERVED = ("im_start", "im_end", "im_role")
_ESCAPE = re.compile(r"<\|(\\*)(im_start|im_end|im_role|endoftext)\|>")
_UNESCAPE = re.compile(r"<\|\\(\\*)(im_start|im_end|im_role|endoftext)\|>")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<|\\\1\2|>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<|\1\2|>", text)


@cache
def _encoding(name: str) -> tuple[tiktoken.Encoding, dict[str, int]]:
    e = encoding(name)
    return e, {r: e.n_vocab + i for i, r in enumerate(RESERVED)}


class _Roles(dict):
    """Ids of the roles met before; starts anew when it has grown large."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __missing__(self, role: str) -> list[int]:
        if len(self) >= 10_000:
            self.clear()
        ids = _encoding(self.name)[0].encode_ordinary(escape(role))
        if len(role) <= 64:
            self[role] = ids
        return ids


_roles = cache(_Roles)


def assemble(turns: list[tuple[str, str]], name: str = "byte_bpe_50k.tiktoken") -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of turns (role, text): start, role, role end, text, end."""
    e, own = _encoding(name)
    ids, edges, known = [], [], _roles(name)
    for role, text in turns:
        ids += [own["im_start"], *known[role], own["im_role"]]
        begin = len(ids)
        ids += e.encode_ordinary(escape(text))  # control strings in a text are ordinary text
        if role == "assistant":
            edges += [(begin, 1), (len(ids), -1)]
        ids.append(own["im_end"])
    steps = np.zeros(len(ids) + 1, np.int64)
    for at, d in edges:
        steps[at] += d
    return np.array(ids, np.int64), np.cumsum(steps)[:-1] == 1


def read_back(ids: np.ndarray, mask: np.ndarray, name: str = "byte_bpe_50k.tiktoken") -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the mask) of each turn, from the output alone."""
    e, own = _encoding(name)
    decode = lambda x: unescape(e.decode_bytes(x.tolist()).decode()) if len(x) else ""
    starts, roles, ends = (np.flatnonzero(ids == own[r]) for r in ("im_start", "im_role", "im_end"))
    for s, r, e_ in zip(starts, roles, ends, strict=True):
        text, under = ids[r + 1 : e_], mask[r + 1 : e_]
        whole = decode(text)
        yield decode(ids[s + 1 : r]), whole, whole if under.all() else decode(text[under])


def render(ids: np.ndarray, name: str = "byte_bpe_50k.tiktoken") -> str:
    """The formatted text: that of the ids, with the names of reserved ones."""
    e, _ = _encoding(name)
    cuts = np.concatenate([[-1], np.flatnonzero(ids >= e.n_vocab), [len(ids)]])
    runs = [e.decode_bytes(ids[i + 1 : j].tolist()).decode() for i, j in zip(cuts, cuts[1:], strict=False)]
    return runs[0] + "".join(f"<|{RESERVED[ids[i] - e.n_vocab]}|>{run}" for i, run in zip(cuts[1:-1], runs[1:], strict=True))


@cache
def _letters(name: str) -> np.ndarray:
    """Characters that begin in each token, reserved ones by their names."""
    e, _ = _encoding(name)
    return np.array([*(sum(c & 0xC0 != 0x80 for c in e.decode_single_token_bytes(i)) for i in range(e.n_vocab)), *(len(f"<|{r}|>") for r in RESERVED)], np.int64)


def rendered_chars(ids: np.ndarray, name: str = "byte_bpe_50k.tiktoken") -> int:
    """The length of ``render(ids)``, without making it."""
    return int(_letters(name)[ids].sum())


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, ids, mask: one row per turn, made where the turn is read.

    A conversation is its turns' ids and masks end to end in the order of ``turn``: the template carries nothing over from one turn to
    the next.  Null texts and roles are empty; repeated rows stay; other columns are not read; an empty table gives an empty result.
    """

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns = list(zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True))
            made = [assemble([t]) for t in turns]
            ids, mask = [i.astype("<u4").tobytes() for i, _ in made], [m.astype("u1").tobytes() for _, m in made]
            columns = [b.column("conv_id"), b.column("turn"), pa.array(ids, pa.binary()), pa.array(mask, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "ids", "mask"])

    long = lambda c: F.col(c).cast("long").alias(c)
    rows = conversations.select(long("conv_id"), long("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(turn, "conv_id bigint, turn bigint, ids binary, mask binary")


def read_turns(formatted: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, loss, formatted_chars of each turn, read back from its ids and mask; ``loss`` is null where it is the text."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for k, (ids, mask) in enumerate(zip(*(b.column(c).to_pylist() for c in ("ids", "mask")), strict=True)):
                ids = np.frombuffer(ids, "<u4")
                turns, chars = list(read_back(ids, np.frombuffer(mask, "u1") == 1)), rendered_chars(ids)
                at += [k] * len(turns)
                out += [(role, said, None if loss == said else loss, 0 if i else chars) for i, (role, said, loss) in enumerate(turns)]
            at = pa.array(at, pa.int64())
            columns = [b.column("conv_id").take(at), b.column("turn").take(at), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "text", "loss", "formatted_chars"])

    return formatted.mapInArrow(back, "conv_id bigint, turn bigint, role string, text string, loss string, formatted_chars bigint")


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted output: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are formatted and read back where they are read; only finished turns meet, in order, for running hashes: no conversation is
    held whole.  Rows that share conv_id and turn follow role, then text.  Rows with a null conv_id are one conversation.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, out = object(), None, []

        def close() -> None:
            if state:
                n, turns, chars, loss, formatted = state
                out.append((last, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

        def flush() -> pa.RecordBatch:
            rows = out[:]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for b in batches:
            for conv, role, text, loss, formatted in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "formatted_chars")), strict=True):
                if conv != last:
                    close()
                    last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                said = text if loss is None else loss
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(said)
                state[3].update(said.encode())
                state[4] += formatted
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    turns = read_turns(format_conversations(conversations))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
