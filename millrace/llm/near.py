"""Near duplicates by word shingles: groups of texts joined by pairs with Jaccard similarity 0.8 or more.

SimHash anchors (``simhash``) propose the sets whose fingerprints differ in three bits or fewer.  Similarity 0.8 is some ten bits away, so MinHash bands propose
the pairs beyond the anchors, where a loose estimate from the signatures joins them; both kinds of links make clusters, and inside each cluster whole shingle
sets are compared: two sets can only be alike if they share one of their rarest shingles (a fifth of each set), so only such pairs
are.  Every link is exact; a pair at similarity 0.8 is never proposed with a chance of about 3 in a million.  Bands and clusters of any size are
dealt out: no task holds more than a bounded part of one.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import components
from .store import materialize

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 4
#: Equal minima, of 96, that join two texts loosely; a pair at 0.8 has fewer with a chance below one in a million.
LOOSE = 56
#: Bits in which the fingerprints of two sets may differ that anchors propose.
BITS_APART = 3
#: Bands up to this many rows are compared all at once.
SMALL = 48
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 9
#: Rows of one band, and bytes of one cluster's sets, that a task holds.
BAND_CAP, CLUSTER_CAP = 1024, 64 << 20


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of five words; of all words where they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), 42) for i in range(n)), np.uint64, n))


def set_id(s: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(s.tobytes(), 7)], np.uint64).view(np.int64)[0])


def set_fingerprint(s: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set: a bit is set if it is set in over half of the shingles; zero for an empty set."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(s), 1 << 15):
        ones += np.unpackbits(s[i : i + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<i8")[0])


def minima(s: np.ndarray) -> np.ndarray:
    """Minimum of the shingles under each of 96 mixes; an empty set has the largest value."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(s), _STEP):
        x = s[i : i + _STEP, None] * _FACTORS
        x ^= x >> np.uint64(32)
        x *= _MIX
        low = np.minimum(low, x.min(axis=0))
    return low


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


class _Trees:
    """The homes of one bucket in trees; trees are named by the component that their rows came with."""

    def __init__(self) -> None:
        self.roots, self.head, self.n, self.up = np.zeros(64, np.int64), np.zeros(64, bool), 0, {}

    def root(self, c: int) -> int:
        while c in self.up:
            c = self.up[c]
        return c

    def others(self, root: int) -> np.ndarray:
        """Homes in other trees; the first of every tree is before the rest of it."""
        other = self.roots[: self.n] != root
        return np.concatenate([np.flatnonzero(other & self.head[: self.n]), np.flatnonzero(other & ~self.head[: self.n])])

    def add(self, root: int) -> None:
        if self.n == len(self.roots):
            self.roots, self.head = np.resize(self.roots, 2 * self.n), np.resize(self.head, 2 * self.n)
        self.head[self.n] = not (self.roots[: self.n] == root).any()
        self.roots[self.n] = root
        self.n += 1

    def union(self, x: int, y: int) -> int:
        low, high = min(x, y), max(x, y)
        self.up[high] = low
        self.roots[: self.n][self.roots[: self.n] == high] = low
        return low


class _Marks:
    """Loose comparison of signatures held as bytes."""

    def __init__(self, homes: list[bytes]) -> None:
        self.rows = np.frombuffer(b"".join(homes), np.uint8).reshape(len(homes), -1)

    def add(self, i: int) -> None:
        pass

    def candidates(self, v: bytes, trees: _Trees, root: int) -> np.ndarray:
        return trees.others(root)

    def like(self, v: bytes, at: np.ndarray) -> np.ndarray:
        return (self.rows[at] == np.frombuffer(v, np.uint8)).sum(axis=1) >= LOOSE


class _Sets:
    """Exact comparison of shingle sets held as bytes, by an index over the rarest shingles of each home."""

    def __init__(self, homes: list[bytes]) -> None:
        self.sets = [np.frombuffer(v, np.uint64) for v in homes]
        self.known, self.often = np.unique(np.concatenate(self.sets), return_counts=True)
        self.holders: dict[int, array] = {}

    def rarest(self, s: np.ndarray) -> list[int]:
        """All but a strict 0.8 of the set's shingles and one more, rare ones first: alike sets share one of them."""
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        often = np.where(self.known[at] == s, self.often[at], 0)
        return s[np.lexsort((s, often))[: len(s) - int(np.ceil(SIMILAR * len(s) - 1e-9)) + 1]].tolist()

    def add(self, i: int) -> None:
        for x in self.rarest(self.sets[i]):
            self.holders.setdefault(x, array("q")).append(i)

    def candidates(self, v: bytes, trees: _Trees, root: int) -> np.ndarray:
        found = [np.array(self.holders[x]) for x in self.rarest(np.frombuffer(v, np.uint64)) if x in self.holders]
        found = [f[trees.roots[f] != root] for f in found]
        at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return at[np.argsort(~trees.head[at], kind="stable")]

    def like(self, v: bytes, at: np.ndarray) -> np.ndarray:
        s, out = np.frombuffer(v, np.uint64), np.zeros(len(at), bool)
        for k, i in enumerate(at):
            few, many = sorted((len(s), len(self.sets[i])))
            out[k] = few >= SIMILAR * many and similarity(s, self.sets[i]) >= SIMILAR
        return out


def joined(batches: Iterator[pd.DataFrame], key: list[str], value: str, kind: type) -> Iterator[pd.DataFrame]:
    """(a, b) links that join up what is alike among the rows of each bucket ``key``; rows of one tree are not compared.

    Rows come homes (``visitor`` false) first: homes are held and compared with each other, visitors are streamed past them.
    """

    def link(v: bytes, node: int, comp: int) -> int:
        root = trees.root(comp)
        at = bucket.candidates(v, trees, root)
        while len(at):
            some, at = at[:1024], at[1024:]
            for h in some[bucket.like(v, some)].tolist():
                if (x := int(trees.roots[h])) != root:
                    root = trees.union(x, root)
                    a.append(node)
                    b.append(nodes[h])
            if len(at):
                at = at[trees.roots[at] != root]
        return root

    def close() -> None:
        nonlocal bucket, trees
        if kind is _Marks and len(values) <= SMALL and len(set(comps)) == len(comps):
            # Most bands hold a few rows: all pairs at once.
            m = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)
            up = list(range(len(m)))
            for x, y in np.argwhere(np.triu((m[:, None] == m[None]).sum(axis=2) >= LOOSE, 1)).tolist():
                if up[x] != up[y]:
                    up = [min(up[x], up[y]) if u in (up[x], up[y]) else u for u in up]
                    a.append(nodes[y])
                    b.append(nodes[x])
            if not visitors:
                return
        bucket, trees = kind(values), _Trees()
        for i, v in enumerate(values):
            trees.add(link(v, nodes[i], comps[i]))
            bucket.add(i)

    last, values, nodes, comps, bucket, trees, visitors, a, b = None, [], [], [], None, None, False, [], []
    for batch in (x for x in batches if len(x)):
        names = [batch[k].to_numpy() for k in key]
        cut = np.any([k[1:] != k[:-1] for k in names], axis=0)
        columns = [batch[c].tolist() for c in (value, "node", "comp", "visitor")]
        edges = [0, *(np.flatnonzero(cut) + 1).tolist(), len(batch)]
        for i, j in zip(edges, edges[1:], strict=False):
            if (k := tuple(n[i] for n in names)) != last:
                if bucket is None and values:
                    close()
                last, values, nodes, comps, bucket, trees, visitors = k, [], [], [], None, None, False
            for v, n, c, visits in zip(*(x[i:j] for x in columns), strict=True):
                if not visits:
                    values.append(v)
                    nodes.append(n)
                    comps.append(c)
                elif values:  # a part without homes has nothing to visit
                    visitors = True
                    if bucket is None:
                        close()
                    link(v, n, c)
        if a:
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})
            a, b = [], []
    if bucket is None and values:
        close()
    if a:
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def bucket_links(rows: DataFrame, sizes: DataFrame, key: str, value: str, kind: type, cap: int) -> DataFrame:
    """(a, b) links that join up what is alike among the rows (``key``, node, ``value``) of each key, whatever its size.

    A key whose size (``sizes``: key, size) passes ``cap`` is hot.  Its rows are dealt out twice by different hashes into parts under the cap, and
    joined up inside them; copies of one text so nearly always meet in one tree.  Only hot keys that still hold several trees are dealt out again, each
    part's homes against all rows of the key that stream past: no pair of trees is missed, and no task holds more than its part.
    """
    none = F.lit(False)
    hot = materialize(sizes.where(F.col("size") > cap).select(key, F.ceil(F.col("size") / cap).cast("int").alias("salts")))
    run = lambda dealt: dealt.repartition(key, "salt").sortWithinPartitions(key, "salt", "visitor", "node").mapInPandas(lambda x: joined(x, [key, "salt"], value, kind), "a bigint, b bigint")
    salt = lambda seed: F.pmod(F.xxhash64("node", key, F.lit(seed)), F.col("salts")).cast("int")
    base = [key, "node", value, F.col("node").alias("comp"), none.alias("visitor")]
    if hot.isEmpty():
        return run(rows.select(*base, F.lit(0).alias("salt")))
    rows = materialize(rows)
    warm = rows.join(hot, key)
    first = rows.join(hot, key, "left_anti").select(*base, F.lit(0).alias("salt")).unionByName(warm.select(*base, F.explode(F.array(salt(0), F.col("salts") + salt(1))).alias("salt")))
    links = materialize(run(first))
    named = warm.join(components(links), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    named = materialize(named)
    split = named.groupBy(key).agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select(key)
    dealt = named.join(split, key, "left_semi").withColumn("own", salt(2)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    again = run(dealt.select(key, "node", value, "comp", (F.col("salt") != F.col("own")).alias("visitor"), "salt"))
    return links.unionByName(again)


def anchor_links(nodes: DataFrame) -> DataFrame:
    """(a, b) links that join up all of ``nodes`` (node, fp) whose fingerprints differ in at most BITS_APART bits, a spanning part of them."""
    from . import simhash  # which imports this module

    prints = materialize(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    blocks = 1 if prints.count() <= simhash.ONE_BLOCK_UP_TO else 2
    links = simhash.fingerprint_links(prints.repartition("fp"), BITS_APART, blocks)
    equal = nodes.select("fp", F.col("node").alias("b")).join(prints.withColumnRenamed("node", "a"), "fp").where("a <> b")
    return links.unionByName(equal.select("a", "b"))


def row_key(docs: DataFrame) -> Column:
    """A row's name from its doc_id and text: equal rows share it."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.col("text").isNull(), F.col("doc_id").isNull())


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, set_id, group_id, component_id (the smallest doc_id of the group) for each row of ``docs``.

    Equal shingle sets are one node: copies and repeated rows are never compared.  Null and empty texts have the empty set.  Rows with
    a null doc_id take part; component_id is null where no row of the group has a doc_id.  An empty table gives an empty result.  Other columns are not read.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            marks = [(minima(s) & np.uint64(255)).astype(np.uint8).tobytes() for s in sets]
            columns = [b.column("doc_id"), b.column("row_key"), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([8 * len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array([set_fingerprint(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "node", "size", "marks", "fp"])

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles(t) for t in b["text"]]
            yield pd.DataFrame({"node": np.array([set_id(s) for s in found], np.int64), "shingles": [s.tobytes() for s in found]})

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row_key"), "text")
    rows = materialize(named.mapInArrow(sketch, "doc_id bigint, row_key bigint, node bigint, size bigint, marks binary, fp bigint"))
    # ``holder`` names one row that has the set: its text is read again for the exact comparison.
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row_key").alias("holder"), F.min("size").alias("size"), F.min("marks").alias("marks"), F.min("fp").alias("fp")))
    # A band is its number and its four marks: the table of nodes needs no more than the marks.
    bands = [F.lit(k << 32) + F.conv(F.hex(F.substring("marks", k * ROWS + 1, ROWS)), 16, 10).cast("long") for k in range(BANDS)]
    keys = nodes.select("node", F.explode(F.array(*bands)).alias("band"))
    often = materialize(keys.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"))
    shared = keys.join(often.select("band"), "band", "left_semi")
    placed = shared.join(nodes.select("node", "marks"), "node")
    loose = components(anchor_links(nodes).unionByName(bucket_links(placed, often, "band", "marks", _Marks, BAND_CAP)))
    loose = materialize(loose.join(nodes.select("node", "holder", "size"), "node").withColumnRenamed("component", "cluster"))
    # The list of candidates grows with the documents, so this join is one by shuffle at every size.
    texts = named.hint("merge").join(loose.select(F.col("holder").alias("row_key")), "row_key", "left_semi").dropDuplicates(["row_key"]).select("text")
    whole = texts.mapInPandas(sets, "node bigint, shingles binary").join(loose.select("node", "cluster"), "node")
    sizes = loose.groupBy("cluster").agg(F.sum(F.greatest("size", F.lit(CLUSTER_CAP // BAND_CAP))).alias("size"))
    same = components(bucket_links(whole, sizes, "cluster", "shingles", _Sets, CLUSTER_CAP))
    groups = nodes.select("node", "first").join(same, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    heads = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    known = materialize(groups.join(heads, "component").select("node", F.col("component").alias("group_id"), "component_id"))
    return rows.select("doc_id", "row_key", "node").join(known, "node", "left").select("doc_id", "row_key", F.col("node").alias("set_id"), "group_id", "component_id")
