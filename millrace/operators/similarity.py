"""Near copies of DNA sequences: candidates by keys that near copies share, confirmed by an alignment that covers both."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialize
from .alignment import Alignments, Scoring, align_pairs
from .graph import components

#: Near copies are equal in 95% of the aligned columns, and the alignment covers 90% of each.
IDENTITY, COVERAGE = 0.95, 0.9
SCORING = Scoring(1, 3, 3, 3)
GRAM, BANDS, SHORT = 11, 128, 128


_OTHER_STRAND = bytes.maketrans(b"ACGT", b"TGCA")


def canonical_rows(df: DataFrame, sequence: str, digest: str) -> DataFrame:
    """``df`` with the lesser of ``sequence`` and its reverse complement, and the SHA-256 of that as ``digest``; one Arrow pass, as column functions make both strands again for each use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [None if s is None else min(s.encode(), s.encode().translate(_OTHER_STRAND)[::-1]) for s in b.column(sequence).to_pylist()]
            at = b.schema.get_field_index(sequence)
            columns = [*b.columns[:at], pa.array([None if s is None else s.decode() for s in both], pa.string()), *b.columns[at + 1 :], pa.array([None if s is None else sha256(s).digest() for s in both], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, digest])

    return df.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, `{digest}` binary")


def edits_of(n: int) -> int:
    """The most edits in an alignment that covers at most ``n`` letters of one sequence: a twentieth of its columns."""
    return n // 19


@cache
def segments_of(n: int) -> tuple[int, int]:
    """(number, length) of the fewest even segments of ``n`` letters of which one survives whole in every near copy.

    Edits destroy a segment each; so do ends that are not aligned, up to a tenth of the letters on both sides together.
    """
    loose = n // 10
    for parts in range(1, n + 1):
        size = n // parts
        rest = n - parts * size  # letters after the last segment
        lost = max(-(-p // size) + max(0, -(-(loose - p - rest) // size)) for p in range(loose + 1))
        if parts > edits_of(n) + lost:
            return parts, size
    return n, 1


def may_pair(m: int, n: int) -> bool:
    """Whether lengths ``m`` and ``n`` leave room for a near copy."""
    return 10 * max(m, n) * 9 <= 100 * (min(m, n) + edits_of(min(m, n)))


@cache
def _found_sizes(m: int) -> tuple[int, ...]:
    return tuple(sorted({segments_of(n)[1] for n in range(max(1, m * 7 // 10), min(SHORT, m * 13 // 10 + 2) + 1) if may_pair(m, n)}))


def _short_keys(s: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """(key, place): segments under which a short sequence lies, and the pieces that find it in any near copy."""
    lies = []
    if len(s) <= SHORT:
        parts, size = segments_of(len(s))
        lies = [(f"{size}|{s[i * size : (i + 1) * size]}", i * size) for i in range(parts)]
    return lies, [(f"{size}|{s[i : i + size]}", i) for size in _found_sizes(len(s)) for i in range(len(s) - size + 1)]


def _marks() -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(11)
    return rnd.integers(0, 2**31, (2 * BANDS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1), rnd.integers(0, 2**32, (2 * BANDS, 1), dtype=np.uint32)


#: Grams that pass all marks together.
_AT_ONCE = 512


#: Longs of a sketch, four bits for each mark; pairs with fewer equal marks are no near copies.
SKETCH, ALIKE = BANDS // 8, 40


def _least_marks(grams: np.ndarray, factors: np.ndarray, adds: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The least of each mark over ``grams``; ``room`` (marks, _AT_ONCE) is written over."""
    mixed = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 2**32 - 1, np.uint32)
    for i in range(0, len(mixed), _AT_ONCE):
        part = mixed[i : i + _AT_ONCE]
        x = room[:, : len(part)]
        np.multiply(factors, part, out=x)
        x += adds
        np.minimum(least, x.min(axis=1), out=least)
    return least


def _band_keys(s: bytes, factors: np.ndarray, adds: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two MinHash marks of the letter grams in each band, mixed to a 64-bit key; four bits of every mark of the grams numbered by their occurrence, so that each repeat is one of its own."""
    grams = _gram_numbers(s).view(np.uint64)
    least = _least_marks(grams, factors, adds, room)
    keys = (least[::2].astype(np.uint64) << np.uint64(32) | least[1::2]) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    order = np.sort(grams)
    first = np.concatenate([[True], order[1:] != order[:-1]])
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    repeats = order[~first] + nth[~first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    fours = ((np.minimum(least, _least_marks(repeats, factors, adds, room)) * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8)
    return (keys ^ (keys >> np.uint64(31))).view(np.int64), (fours[::2] << 4 | fours[1::2]).view(np.int64)


def _may_be_alike(x: str, y: str) -> Column:
    """Whether two sketches agree in as many marks as those of near copies, or one is null.

    Near copies of over SHORT letters share 39 of 119 grams at the least, repeats counted (``likely_band``): 0.19 of both together where edits lie at the worst places, about 0.34 where they are
    scattered.  ALIKE of 256 marks of four bits are 3 and 8 standard deviations under what these give.
    """
    unlike = F.lit(0)
    for i in range(SKETCH):
        d = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        unlike = unlike + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x1111111111111111)))
    return F.coalesce(unlike <= 2 * BANDS - ALIKE, F.lit(True))


def _short_key(key: str) -> int:
    return int.from_bytes(blake2b(key.encode(), digest_size=8).digest(), "little", signed=True)


def sequence_marks(df: DataFrame, node: str, sequence: str) -> DataFrame:
    """(node, size, keys, sketch): 64-bit keys (key, place, finds); two sequences may be near copies if one lies under a key that finds the other, or both have it with null, and if their sketches agree."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, adds = _marks()
        room = np.empty((len(factors), _AT_ONCE), np.uint32)
        longest = max(m for m in range(SHORT, 2 * SHORT) if _found_sizes(m))
        for batch in batches:
            sizes, ends, values, places, finds, sketches = [], [0], [np.zeros(0, np.int64)], [], [], []
            for s in batch.column("sequence").to_pylist():
                lies, found = _short_keys(s) if 0 < len(s) <= longest else ([], [])
                bands, sketch = _band_keys(s.encode(), factors, adds, room) if len(s) > SHORT else (np.zeros(0, np.int64), None)
                values += [np.array([_short_key(k) for k, _ in lies + found], np.int64), bands]
                places += [at for _, at in lies + found] + [None] * len(bands)
                finds += [False] * len(lies) + [True] * len(found) + [None] * len(bands)
                sizes.append(len(s))
                ends.append(len(places))
                sketches.append(sketch)
            keys = pa.StructArray.from_arrays([pa.array(np.concatenate(values)), pa.array(places, pa.int32()), pa.array(finds, pa.bool_())], ["key", "place", "finds"])
            columns = [batch.column("node"), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "size", "keys", "sketch"])

    x = _dealt(df.select(F.col(node).alias("node"), F.col(sequence).alias("sequence")))
    return x.mapInArrow(marks, f"node {x.schema['node'].dataType.simpleString()}, size int, keys array<struct<key: bigint, place: int, finds: boolean>>, sketch array<bigint>")


def _dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out to a fixed number of tasks that is not coalesced: the work lies in the letters and not in bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")


def _meet(keyed: DataFrame, extra: list[str] = [], apart: str = "true") -> DataFrame:  # noqa: B006
    """(a, b) with a < b of the keyed nodes that meet under a key, each pair once, where the places and sizes leave room for a near copy."""
    x, y = (keyed.select("key", *(F.col(c).alias(f"{c}{i}") for c in ("node", "size", "place", "finds", *extra))) for i in (0, 1))
    bands = x.where("finds0 IS NULL").join(y.where("finds1 IS NULL"), "key").where("node0 < node1")
    short = x.where("finds0").join(y.where("NOT finds1"), "key").where("node0 <> node1")
    less, more = F.least("size0", "size1"), F.greatest("size0", "size1")
    edits = F.floor(less / 19)
    room = 9 * more <= 10 * (less + edits)
    # What lies before a segment is aligned but for a tenth of the letters, and shifted by no more than the edits.
    shift = F.abs(F.col("place0") - F.col("place1")) <= F.floor(more / 10) + edits + 1
    met = bands.where(room).where(apart).unionByName(short.where(room & shift).where(apart))
    return met.select(F.least("node0", "node1").alias("a"), F.greatest("node0", "node1").alias("b")).distinct()


def _keyed(marked: DataFrame) -> DataFrame:
    return marked.select("node", "size", F.inline("keys"))


def _alike(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose lengths and sketches leave room for a near copy, each looked at without its sequences."""
    x, y = (marked.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in ("a", "b"))
    less, more = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    return pairs.join(x, "a").join(y, "b").where(9 * more <= 10 * (less + F.floor(less / 19))).where(_may_be_alike("sketch_a", "sketch_b")).select("a", "b")


#: Pairs over this length are first aligned around the diagonal of their shared grams.
LONG, NARROW = 512, 64


def _gram_numbers(s: bytes) -> np.ndarray:
    codes = np.frombuffer(s, np.uint8).astype(np.int64)
    out = np.zeros(len(codes) - GRAM + 1, np.int64)
    for i in range(GRAM):
        out = out * 131 + codes[i : len(out) + i]
    return out


def _profile(s: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams in order, first place, times) of a sequence."""
    grams, at, times = np.unique(_gram_numbers(s), return_index=True, return_counts=True)
    return grams, at.astype(np.int32), times.astype(np.int32)


_kept_profile = lru_cache(2048)(_profile)


def _grams_of(s: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _kept_profile(s) if len(s) <= 2048 else _profile(s)


#: Up to so many letters grams are first counted without their places; over so many, edits are counted before an alignment.
_FEW, _MANY = 256, 1024


def _fewer_shared(q: bytes, t: bytes, least: int) -> bool:
    """Whether two short sequences share fewer than ``least`` grams, repeats of either counted as shared."""
    a, b = ({s[i : i + GRAM] for i in range(len(s) - GRAM + 1)} for s in (q, t))
    return len(a & b) + min(len(q) - GRAM + 1 - len(a), len(t) - GRAM + 1 - len(b)) < least


def too_many_edits(q: bytes, t: bytes, low: int, high: int) -> bool:
    """Whether every alignment over diagonals ``low`` to ``high`` that covers nine tenths of ``q`` has more edits than that of a near copy.

    ``q`` is cut into the shortest blocks that lie nowhere in ``t`` on these diagonals: an alignment has an edit in each block that it covers.  Up to a tenth of the letters before and after it
    may be left out, and an edit is allowed for 19 letters that are not.
    """
    n, m, ends, i = len(q), len(t), [0], 0
    while i < n:
        at = max(0, i + low)
        has, size = 0, 8
        while i + size <= n and t.find(q[i : i + size], at, min(m, i + high + size)) >= 0:
            has, size = size, 2 * size
        lacks = min(size, n - i + 1)
        while lacks - has > 1:
            size = (has + lacks) // 2
            if t.find(q[i : i + size], at, max(0, min(m, i + high + size))) >= 0:
                has = size
            else:
                lacks = size
        if i + lacks > n:
            break
        i += lacks
        ends.append(i)
    ends = np.array(ends)
    # Ends left out by steps: blocks are counted for the longer, edits are allowed for the shorter.
    step = max(1, n // 160)
    before, after = (x * step for x in np.meshgrid(np.arange(n // 10 // step + 1), np.arange(n // 10 // step + 1)))
    before, after = before[before + after <= n // 10], after[before + after <= n // 10]
    blocks = np.searchsorted(ends, n - after - step, "right") - 1 - np.searchsorted(ends, before + step, "left")
    return bool((blocks > (n - before - after) // 19).all())


def likely_band(q: bytes, t: bytes) -> tuple[int, ...] | None:
    """(low, high) around the diagonal that most shared grams of a long pair lie on, and (low, high) of all diagonals that a near copy can touch; (1, 0) where there can be none.

    An alignment of a near copy has nine tenths of the longer sequence's letters and an edit for 19 of them at most, each of which destroys at most GRAM grams: 8 / 19 of the aligned letters less
    GRAM - 1 begin a gram that both have.  Its gaps are edits, so all of these grams lie on diagonals no further apart than the edits; those that a sequence has twice may lie on any.
    """
    n, longer = min(len(q), len(t)), max(len(q), len(t))
    if n < GRAM:
        return None
    least = -(-(72 * longer - 190 * (GRAM - 1)) // 190)
    if longer <= _FEW and _fewer_shared(q, t, least):
        return 1, 0
    (a, i, x), (b, j, y) = _grams_of(q), _grams_of(t)
    r = np.minimum(np.searchsorted(b, a), len(b) - 1)
    p = np.flatnonzero(b[r] == a)
    r = r[p]
    shared = np.minimum(x[p], y[r])
    if shared.sum() < least:
        return 1, 0
    if n <= LONG:
        return None
    once = (x[p] == 1) & (y[r] == 1)
    if not once.any():
        return None
    diagonals = np.sort(j[r][once] - i[p][once])
    edits, wide = edits_of(n), ()
    if (least := least - shared[~once].sum()) > 0:
        begins = diagonals[np.searchsorted(diagonals, diagonals + edits, "right") - np.arange(len(diagonals)) >= least]
        if not len(begins):
            return 1, 0
        wide = int(begins[0]) - edits, int(begins[-1]) + edits
    if n > _MANY:
        left_out = len(q) // 10 + edits, len(t) // 10 + edits
        low, high = max(-left_out[0], wide[0] if wide else -left_out[0]), min(left_out[1], wide[1] if wide else left_out[1])
        if low > high or too_many_edits(q, t, low, high):
            return 1, 0
    values, times = np.unique(diagonals // NARROW, return_counts=True)
    middle = int(values[times.argmax()]) * NARROW
    return middle - NARROW, middle + 2 * NARROW, *wide


def near(found: Alignments, query: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Which alignments are those of near copies, from the lengths of both."""
    return (found.score > 0) & (20 * found.matches >= 19 * found.columns) & (10 * (found.query_end - found.query_begin) >= 9 * query) & (10 * (found.target_end - found.target_begin) >= 9 * target)


def least_score(query: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The least score of a near copy: nine tenths of the longer sequence's letters, 19 of 20 columns equal, 3 taken for each other one."""
    return -(-18 * np.maximum(query, target) // 25)


def confirmed(pairs: DataFrame, df: DataFrame, node: str, sequence: str) -> DataFrame:
    """(a, b, identity, coverage_a, coverage_b) of the pairs whose best local alignment is equal in IDENTITY of its columns and covers COVERAGE of both.

    The alignment is sought over all diagonals that such an alignment can touch: those of a tenth of the letters left out before it, and of its gaps.  A pair costs the product of its
    lengths, times 0.3; long pairs are first aligned around their main diagonal (``likely_band``), where most near copies are found in proportion to their length.
    """
    s = df.select(F.col(node).alias("a"), F.col(sequence).alias("query"))
    x = pairs.join(s, "a").join(s.select(F.col("a").alias("b"), F.col("query").alias("target")), "b")
    n, m = F.length("query"), F.length("target")
    edits = F.floor(F.least(n, m) / 19)
    x = x.select("a", "b", n.alias("n"), m.alias("m"), "query", "target", (-F.floor(n / 10) - edits).alias("low"), (F.floor(m / 10) + edits).alias("high"))
    found = align_pairs(x, ["a", "b", "n", "m"], SCORING, likely_band, near, least_score).where("score > 0")
    share = lambda end, of: (F.col(f"{end}_end") - F.col(f"{end}_begin")) / F.col(of)
    found = found.select("a", "b", (F.col("matches") / F.col("columns")).alias("identity"), share("query", "n").alias("coverage_a"), share("target", "m").alias("coverage_b"))
    return found.where((F.col("identity") >= IDENTITY) & (F.col("coverage_a") >= COVERAGE) & (F.col("coverage_b") >= COVERAGE))


def near_pairs(df: DataFrame, node: str, sequence: str) -> DataFrame:
    """(a, b, identity, coverage_a, coverage_b): every confirmed pair of different sequences; ``df`` has each sequence once.

    A pair with one of up to 128 letters is found exactly, by surviving segments.  Longer ones by 128 bands of two MinHash marks over 11-letter grams: the worst pair, with a tenth of
    each left out and scattered edits in a twentieth of the rest, keeps a similarity near 0.34 and is missed with a chance of 2 in 10 million; edits placed so as to
    destroy the most grams, more often.  Null and empty sequences and empty tables give no pair.
    """
    marked = materialize(sequence_marks(df.where(F.col(sequence).isNotNull()), node, sequence))
    return confirmed(_alike(_meet(_keyed(marked)), marked), df, node, sequence)


def near_clusters(df: DataFrame, node: str, sequence: str) -> DataFrame:
    """(node, component) of the nodes with a near copy, as components of ``near_pairs`` without making all pairs of a large group.

    First each node is compared with the smallest node of its keys only.  Then pairs that meet under a key are compared
    where those links left them apart and the first step did not compare them; keys whose nodes are all in one component are done.
    """
    marked = materialize(sequence_marks(df.where(F.col(sequence).isNotNull()), node, sequence))
    keyed = _keyed(marked)
    heads = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("_z")).where("a <> _z").drop("_z")
    first = keyed.select("key", F.col("node").alias("b")).join(heads, "key").where("a <> b").select("a", "b").distinct()
    first = materialize(first)
    links = materialize(confirmed(_alike(first, marked), df, node, sequence).select("a", "b"))
    parts = components(links)
    known = keyed.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    open_keys = known.groupBy("key").agg(F.min("part").alias("_a"), F.max("part").alias("_z")).where("_a <> _z").select("key")
    rest = _meet(known.join(open_keys, "key", "left_semi"), ["part"], "part0 <> part1").join(first, ["a", "b"], "left_anti")
    return components(links.unionByName(confirmed(_alike(rest, marked), df, node, sequence).select("a", "b")))
