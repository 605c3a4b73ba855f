"""SimHash near duplicates by anchor-point covering.

Anchors are the words of the binary Golay code over 23 fingerprint bits (or its square over 46): every
fingerprint lies within the covering radius of exactly one anchor, its home, and visits every anchor within
covering radius plus threshold.  Two fingerprints within the threshold so meet at the home of the smaller one,
whatever their other bits are; there whole fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import Forest, components, deal, segments
from .near import near_components, row_key
from .store import materialize

#: The generator polynomial of the [23, 12] Golay code, its length, check bits and covering radius.
GOLAY = 0b110001110101
BITS, CHECK, RADIUS = 23, 11, 3
#: More distinct fingerprints than this are covered by two blocks of anchors (4096 squared) and not by one (4096).
ONE_BLOCK_UP_TO = 1 << 24
HOMES_PER_TASK = 4096
_STEP = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    if not n:
        return 0
    joined = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), 42) for s in joined), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _STEP):
        ones += np.unpackbits(hashes[i : i + _STEP].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(column: str) -> Column:
    @F.pandas_udf("bigint")
    def prints(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in text], np.uint64).view(np.int64))

    return prints(column)


def syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder modulo the generator polynomial of each 23-bit word."""
    x = x.astype(np.int64).copy()
    for b in range(BITS - 1, CHECK - 1, -1):
        x ^= np.where(x >> b & 1, GOLAY << (b - CHECK), 0)
    return x


@cache
def coset_words(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of weight up to radius + threshold, sorted by (syndrome, weight); where each syndrome begins; their weights.

    The first word of each syndrome leads to the home anchor: the code is perfect, so it is the only one within the radius.
    """
    x = np.arange(1 << BITS)
    w = np.bitwise_count(x).astype(np.int64)
    x, w = x[w <= RADIUS + threshold], w[w <= RADIUS + threshold]
    s = syndrome(x)
    order = np.lexsort((w, s))
    return x[order], np.searchsorted(s[order], np.arange((1 << CHECK) + 1)), w[order]


def visits(fp: np.ndarray, blocks: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is_home) for each fingerprint and anchor within radius plus threshold, excess summed over blocks."""
    words, begin, weight = coset_words(threshold)
    rows, anchor = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    excess, home = np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
    for b in range(blocks):
        part = (fp[rows] >> np.uint64(BITS * b) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        s = syndrome(part)
        n = begin[s + 1] - begin[s]
        r = np.repeat(np.arange(len(rows)), n)
        at = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) + begin[s][r]
        more = excess[r] + np.maximum(0, weight[at] - RADIUS)
        ok = more <= threshold
        r, at = r[ok], at[ok]
        word = part[r] ^ words[at]
        rows, excess, home = rows[r], more[ok], home[r] & (weight[at] <= RADIUS)
        anchor = anchor[r] << 12 | word >> CHECK  # the message part names the code word
    return rows, anchor, home


def fingerprint_links(prints: DataFrame, threshold: int = 3, blocks: int = 1) -> DataFrame:
    """(a, b) links that join up all of ``prints`` (fp, node) that differ in at most ``threshold`` bits, a spanning part of them."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 2048):
                part = b.iloc[i : i + 2048]
                fp, node = part["fp"].to_numpy(np.int64), part["node"].to_numpy(np.int64)
                r, anchor, home = visits(fp.view(np.uint64), blocks, threshold)
                yield pd.DataFrame({"anchor": anchor, "kind": np.where(home, 0, 2).astype(np.int32), "fp": fp[r], "node": node[r]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, fps, nodes, forest = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), Forest()
        for key, seg in segments(batches, ["anchor", "salt"]):
            if key != last:
                last, fps, nodes, forest = key, np.zeros(0, np.uint64), np.zeros(0, np.int64), Forest()
            a, b = [], []
            kind, fp, node = seg["kind"].to_numpy(), seg["fp"].to_numpy(np.int64).view(np.uint64), seg["node"].to_numpy(np.int64)
            if (own := kind == 0).any():
                old = len(fps)
                fps, nodes = np.concatenate([fps, fp[own]]), np.concatenate([nodes, node[own]])
                forest.grow(len(fps) - old)
            if len(fps):
                for i in range(0, len(fp), wide := max(1, (1 << 21) // len(fps))):
                    f, n, k = fp[i : i + wide], node[i : i + wide], kind[i : i + wide]
                    near = np.bitwise_count(f[:, None] ^ fps[None, :]) <= threshold
                    near &= fps.view(np.int64)[None, :] < f.view(np.int64)[:, None]  # as the rows are sorted
                    v, h = np.nonzero(near)
                    first = np.ones(len(v), bool)
                    first[1:] = v[1:] != v[:-1]
                    # A visitor is linked to its first home here; that home to the visitor's others.
                    a += n[v[first]].tolist()
                    b += nodes[h[first]].tolist()
                    lead = h[np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))] if len(v) else h
                    for x, y in np.unique(np.stack([lead[~first], h[~first]], axis=1), axis=0) if (~first).any() else ():
                        if forest.union(x, y):
                            a.append(nodes[x])
                            b.append(nodes[y])
            if a:
                yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    placed = prints.select("fp", "node").mapInPandas(place, "anchor bigint, kind int, fp bigint, node bigint")
    return deal(placed, ["anchor"], "fp", HOMES_PER_TASK).mapInPandas(compare, "a bigint, b bigint")


def simhash_components(docs: DataFrame, threshold: int = 3, blocks: int | None = None) -> DataFrame:
    """doc_id, fp (signed 64 bit), component_id for each row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other.  Equal fingerprints are one node, so copies and repeated rows are
    never compared with each other, and a doc_id may be on several rows.  Rows with a null doc_id take part; component_id is null where no
    row of the component has a doc_id.  An empty table gives an empty result.  Whole texts are read once; afterwards only (doc_id, fingerprint)
    moves, and other columns are not read.
    """
    rows = materialize(docs.select("doc_id", _fingerprints("text").alias("fp")))
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    if blocks is None:
        blocks = 1 if prints.count() <= ONE_BLOCK_UP_TO else 2
    links = fingerprint_links(prints.select("fp", F.col("fp").alias("node")).repartition("fp"), threshold, blocks)
    named = prints.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = materialize(named)
    heads = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(heads, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    out = simhash_components(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each near-duplicate group (``near``): that with the smallest doc_id, every column as it was.

    Rows without a doc_id come last in a group, so one of them stays only where no other row of the group has one.  Of rows that share the
    doc_id the smallest row key stays, of rows that share the text too the smallest hash of the row; texts that are no near copy stay, whatever their doc_id.
    """
    c = materialize(near_components(docs))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("head")
    heads = c.groupBy("group_id").agg(head).select("head.doc_id", "head.row_key")
    repeated = c.groupBy("row_key").count().where("count > 1").select("row_key")
    heads = materialize(heads.join(repeated.withColumn("again", F.lit(True)), "row_key", "left"))
    # The list of heads grows with the documents, so this join is one by shuffle at every size.
    rows = docs.select(F.struct("*").alias("doc"), row_key(docs).alias("row_key")).hint("merge").join(heads.select("row_key", "again"), "row_key")
    # Only rows that are there more than once are grouped.
    order = F.xxhash64(*[F.col("doc").getField(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    one = rows.where("again").groupBy("row_key").agg(F.min_by("doc", order).alias("doc"))
    return rows.where("again IS NULL").select("doc.*").unionByName(one.select("doc.*"))
