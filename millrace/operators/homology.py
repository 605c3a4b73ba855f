"""Similarity search of held-out sequences against the others: shared seeds, then gapped local alignment, then the best hit of each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialize
from .alignment import Scoring, align_pairs

IDENTITY, COVERAGE = 0.80, 0.80
# The scores of nucleotide searches, and lambda and K of their extreme value distribution.
SCORING, LAMBDA, K = Scoring(2, 3, 5, 2), 0.625, 0.41
#: Letters of a seed, for queries below SHORT and for all others.
SEED, SHORT, SHORT_SEED = 10, 48, 4
#: A seed in more targets than this is used only where it is among a query's RAREST seeds.
HOT, RAREST = 256, 24
#: Diagonals are counted in stripes of this width.
STRIPE = 32
#: A candidate shares a seed for this many letters of the query, and two at least: at identity 0.8 a tenth of the seeds survive.
LETTERS_PER_HIT = 50
#: Queries over this length are first aligned around their best diagonals.
LONG = 512
_CODES = np.full(256, 4, np.uint8)
_CODES[[ord(c) for c in "ACGT"]] = range(4)


def _seed_numbers(sequence: str, k: int) -> np.ndarray:
    codes = _CODES[np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)]
    seed = np.zeros(max(0, len(codes) - k + 1), np.int64)
    for j in range(k):
        seed = seed * 5 + codes[j : j + len(seed)]
    return seed


def _seed_rows(df: DataFrame, k: int, wanted: np.ndarray | None = None) -> DataFrame:
    """(node, size, seed, pos): every ``k`` letters of ``sequence`` as a number in base 5; only those in the bitmap ``wanted``, if it is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, rows = [], 0
            for i, s in enumerate(b.column("sequence").to_pylist()):
                seed = _seed_numbers(s or "", k)
                pos = np.arange(len(seed))
                if wanted is not None:
                    pos = pos[wanted[seed >> 3] >> (seed & 7) & 1 == 1]
                held.append((np.full(len(pos), i), np.full(len(pos), len(s or "")), seed[pos], pos))
                rows += len(pos)
                if rows > 1 << 18 or i + 1 == len(b):
                    row, *columns = map(np.concatenate, zip(*held, strict=True))
                    yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(row)), *map(pa.array, columns)], ["node", "size", "seed", "pos"])
                    held, rows = [], 0

    return df.select("node", "sequence").mapInArrow(run, f"node {df.schema['node'].dataType.simpleString()}, size bigint, seed bigint, pos bigint")


def _seed_counts(df: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """(seed, in_targets): in how many rows each seed of the bitmap ``wanted`` occurs; a task counts its rows in 5 ** k numbers, 39 MB for ten letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(5**k, np.int32)
        for b in batches:
            for s in b.column("sequence").to_pylist():
                counts[np.unique(_seed_numbers(s or "", k))] += 1
        seed = np.flatnonzero(counts)
        seed = seed[wanted[seed >> 3] >> (seed & 7) & 1 == 1]
        for i in range(0, len(seed), 1 << 18):
            part = seed[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part].astype(np.int64))], ["seed", "n"])

    return df.select("sequence").mapInArrow(run, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("in_targets"))


def _shares_seeds(k: int) -> Callable[[bytes, bytes], tuple[int, int] | None]:
    """Whether a pair shares as many seeds along its best diagonals as a candidate must, of all its seeds and not of the rarest; (1, 0) where it doesn't, and for a long pair the diagonals around the best."""

    def look(q: bytes, t: bytes) -> tuple[int, int] | None:
        if len(q) < SHORT:
            return None
        a, b = _seed_numbers(q.decode(), k), _seed_numbers(t.decode(), k)
        order = np.argsort(b, kind="stable")
        low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
        n = high - low
        if n.sum() > 1 << 20:  # repeats: aligned at once
            return None
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        stripe, hits = np.unique((order[at] - np.repeat(np.arange(len(a)), n)) // STRIPE, return_counts=True)
        if not len(stripe):
            return 1, 0
        reach = int(len(q) * (1 - IDENTITY)) + STRIPE
        close = hits[np.abs(stripe - stripe[hits.argmax()]) * STRIPE <= reach].sum()
        if close < max(2, len(q) // LETTERS_PER_HIT):
            return 1, 0
        at = int(stripe[hits.argmax()]) * STRIPE
        return None if len(q) <= LONG else (at - 2 * STRIPE, at + 3 * STRIPE)

    return look


def _bitmap(seeds: DataFrame, k: int) -> np.ndarray:
    """Which of the 5 ** k seeds occur: at most 5 ** k bits reach the driver, 1.2 MB for ten letters."""
    out = np.zeros(-(-(5**k) // 64), np.uint64)
    for part in seeds.groupBy(F.shiftright("seed", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(seed & 63 AS INT))")).alias("bits")).toLocalIterator():
        out[part["word"]] = np.int64(part["bits"]).view(np.uint64)
    return out.view(np.uint8)


def _distinct(df: DataFrame, ident: str, sequence: str) -> tuple[DataFrame, DataFrame]:
    """(node, sequence) of each distinct sequence, ``node`` its smallest id, and (id, node) of every row."""
    x = df.where(F.length(sequence) > 0).select(F.col(ident).alias("id"), F.sha2(sequence, 256).alias("whole"))
    rows = materialize(x.join(x.groupBy("whole").agg(F.min("id").alias("node")), "whole").select("id", "node"))
    firsts = df.select(F.col(ident).alias("node"), F.col(sequence).alias("sequence")).join(rows.select("node").distinct(), "node", "left_semi")
    return materialize(firsts.dropDuplicates(["node"])), rows


def candidates(queries: DataFrame, targets: DataFrame, k: int = SEED) -> DataFrame:
    """(query, target, low, high): pairs of nodes that share enough seeds, and the diagonals to align over.

    Seeds of all targets are counted where they are read, and only those that some query looks up leave the task.  Lengths must leave room for identity and coverage on both sides.
    """
    small, large = queries.where(F.length("sequence") < SHORT), queries.where(F.length("sequence") >= SHORT)
    fits = (F.col("n") >= F.floor(F.col("m") * COVERAGE * IDENTITY)) & (F.col("n") <= F.ceil(F.col("m") / (COVERAGE * IDENTITY)))

    def met(asked: DataFrame, seeds: DataFrame) -> DataFrame:
        found = seeds.select(F.col("node").alias("target"), F.col("size").alias("n"), "seed", F.col("pos").alias("t"))
        return asked.select(F.col("node").alias("query"), F.col("size").alias("m"), "seed", F.col("pos").alias("q")).join(found, "seed").where(fits)

    # Short queries meet every short target that shares a few letters, over all diagonals.
    asked = _seed_rows(small, SHORT_SEED)
    near = met(asked, _seed_rows(targets.where(F.length("sequence") <= SHORT / (COVERAGE * IDENTITY)), SHORT_SEED))
    short = near.groupBy("query", "target").agg((-F.max("m")).alias("low"), F.max("n").alias("high"))
    asked = materialize(_seed_rows(large, k))
    counts = _seed_counts(targets, k, _bitmap(asked, k))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("in_targets", "pos"))
    asked = asked.join(counts, "seed", "left").withColumn("in_targets", F.coalesce("in_targets", F.lit(0))).withColumn("rank", rank)
    asked = materialize(asked.where((F.col("in_targets") <= HOT) | (F.col("rank") <= RAREST)))
    # Only seeds that are looked up leave the targets' tasks.
    seeds = materialize(_seed_rows(targets, k, _bitmap(asked.where("in_targets > 0"), k)))
    stripes = met(asked, seeds).groupBy("query", "target", "m", F.floor((F.col("t") - F.col("q")) / STRIPE).alias("stripe")).agg(F.count("*").alias("hits"))
    pairs = stripes.groupBy("query", "target", "m").agg(F.collect_list(F.struct("stripe", "hits")).alias("all"), F.max_by("stripe", F.struct("hits", -F.abs("stripe"), "stripe")).alias("stripe"))
    reach = F.floor(F.col("m") * (1 - IDENTITY)) + STRIPE
    # Only hits that one alignment can hold count: those within reach of the stripe with the most.
    close = F.filter("all", lambda x: F.abs(x["stripe"] - F.col("stripe")) * STRIPE <= reach)
    pairs = pairs.select("query", "target", "m", "stripe", F.aggregate(close, F.lit(0).cast("long"), lambda t, x: t + x["hits"]).alias("hits"))
    # Where only the rarest seeds were looked up, fewer hits can be asked for.
    asked_for = asked.groupBy(F.col("node").alias("query")).agg(F.count("*").alias("seeds"))
    pairs = pairs.join(asked_for, "query").where(F.col("hits") >= F.greatest(F.lit(2), F.floor(F.least("m", "seeds") / LETTERS_PER_HIT)))
    long = pairs.select("query", "target", (F.col("stripe") * STRIPE - reach).alias("low"), ((F.col("stripe") + 1) * STRIPE + reach).alias("high"))
    return short.unionByName(long)


def least_score(target_coverage: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The least score of a hit, by lengths of queries and targets: IDENTITY of its columns are equal and each other one costs what opens a gap, over the letters that it covers."""
    worst = max(SCORING.first, SCORING.mismatch)
    column = (SCORING.match + worst) * IDENTITY - worst
    return lambda query, target: np.floor(column * np.maximum(COVERAGE * query, target_coverage * target)).astype(np.int64)


def similarity_join(queries: DataFrame, targets: DataFrame, ident: str, sequence: str, target_coverage: float = COVERAGE, k: int = SEED, itself: bool = True) -> DataFrame:
    """(query, target, identity, query_coverage, target_coverage, bits): the best hit of each row of ``queries`` that has one.

    A hit is a local alignment equal in IDENTITY of its columns that covers COVERAGE of the query and ``target_coverage`` of the target; the best has the most bits, then
    the smallest target.  Rows with one sequence are searched once.  Letters are compared as they are, so an N equals an N.  The search is a heuristic: a hit that shares too few runs of ``k`` letters is not
    found.  Null and empty sequences have no hit; ids must be numbers or strings, and a null id takes no part.  Without ``itself`` the queries are rows of the
    targets, and a row (by its id) is no hit of its own; other rows with its sequence are.
    """
    own, rows = _distinct(queries.where(F.col(ident).isNotNull()), ident, sequence)
    others, _ = _distinct(targets.where(F.col(ident).isNotNull()), ident, sequence)
    x = candidates(own, others, k).join(own.select(F.col("node").alias("query"), F.col("sequence").alias("_q")), "query").join(others.select(F.col("node").alias("target"), F.col("sequence").alias("_t")), "target")
    m, n = F.length("_q"), F.length("_t")
    x = x.select(F.col("query").alias("query_node"), F.col("target").alias("target_node"), m.alias("m"), n.alias("n"), F.col("_q").alias("query"), F.col("_t").alias("target"), F.greatest("low", -m).alias("low"), F.least("high", n).alias("high"))
    alike = F.col("query") == F.col("target")
    x = x.where("low <= high") if itself else x.where("low <= high").where(~alike)
    hits = align_pairs(x, ["query_node", "target_node", "m", "n"], SCORING, _shares_seeds(k), lambda found, m, n: found.score < 0, least_score(target_coverage)).where("score > 0")
    bits = (LAMBDA * F.col("score") - float(np.log(K))) / float(np.log(2))
    share = lambda side, of: (F.col(f"{side}_end") - F.col(f"{side}_begin")) / F.col(of)
    hits = hits.select(F.col("query_node").alias("node"), F.col("target_node").alias("target"), (F.col("matches") / F.col("columns")).alias("identity"), share("query", "m").alias("query_coverage"), share("target", "n").alias("target_coverage"), bits.alias("bits"))
    hits = hits.where((F.col("identity") >= IDENTITY) & (F.col("query_coverage") >= COVERAGE) & (F.col("target_coverage") >= target_coverage))
    best = hits.groupBy("node").agg(F.min_by(F.struct("target", "identity", "query_coverage", "target_coverage", "bits"), F.struct(-F.col("bits"), "target")).alias("x"))
    found = rows.join(best, "node").select(F.col("id").alias("query"), "x.*")
    if itself:
        return found
    whole = F.sha2(sequence, 256).alias("whole")
    asked = queries.where(F.col(ident).isNotNull() & (F.length(sequence) > 0)).select(F.col(ident).alias("query"), whole, (F.lit(SCORING.match).cast("long") * F.length(sequence)).alias("score"))
    same = targets.where(F.col(ident).isNotNull()).select(F.col(ident).alias("target"), whole).join(asked.select("whole").distinct(), "whole", "left_semi")
    same = materialize(same)
    first = same.groupBy("whole").agg(F.min("target").alias("first"))
    second = same.join(first, "whole").where("target <> first").groupBy("whole").agg(F.min("target").alias("second"))
    other = F.when(F.col("first") != F.col("query"), F.col("first")).otherwise(F.col("second"))
    copies = asked.join(first, "whole").join(second, "whole", "left").select("query", other.alias("target"), *(F.lit(1.0).alias(c) for c in ("identity", "query_coverage", "target_coverage")), bits.alias("bits"))
    both = found.unionByName(copies.where("target IS NOT NULL"))
    best = F.min_by(F.struct("target", "identity", "query_coverage", "target_coverage", "bits"), F.struct(-F.col("bits"), "target"))
    return both.groupBy("query").agg(best.alias("x")).select("query", "x.*")


def low_homology(samples: DataFrame, hits: DataFrame, ident: str) -> DataFrame:
    """(``ident``, low): whether a held-out sample has no hit among ``hits`` (query, ...).

    Samples with a ``group_id`` are taken or left as a group: it is low if all its samples with ``label`` 1 are, and a group without one is an error.
    """
    x = samples.join(hits.select(F.col("query").alias(ident), F.lit(False).alias("_low")), ident, "left").withColumn("_low", F.coalesce("_low", F.lit(True)))
    if "group_id" not in samples.columns:
        return x.select(ident, F.col("_low").alias("low"))
    grouped = F.col("group_id").isNotNull() & (F.col("group_id").cast("string") != "")
    positive = F.col("label").cast("double") == 1
    groups = x.where(grouped).groupBy("group_id").agg(F.min(F.when(positive, F.col("_low"))).alias("_group"))
    groups = groups.withColumn("_group", F.when(F.col("_group").isNull(), F.raise_error(F.concat(F.lit("no positive sample in group "), F.col("group_id").cast("string")))).otherwise(F.col("_group")))
    return x.join(groups, "group_id", "left").select(ident, F.coalesce("_group", "_low").alias("low"))
