"""Draws from weighted pools: the slots of each pool, and a keyed order of its windows, by arithmetic alone.

Slot numbers, rounds and places follow from the number of draws so far, so a plan of any part of the sequence is made without a sort, a shuffle or a pass over the windows.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

# Shares of the tokens in per cent, of window lengths and of regions within a length.
LENGTH_SHARES = {4096: 5, 8192: 15, 16384: 5, 32768: 5, 65536: 70}
REGION_SHARES = {"coding": 32, "splice": 21, "promoter": 14, "UTR": 11, "TES": 8, "gene_body": 10, "background": 4}


def draw_weights(lengths: dict[int, int], regions: dict) -> dict[tuple, int]:
    """Whole weights of the draws of each (length, region) pool whose tokens then have these shares: a long window takes fewer draws."""
    longest = max(lengths)
    if any(longest % n for n in lengths):
        raise ValueError("every length must divide the longest")
    return {(n, r): s * t * (longest // n) for n, s in lengths.items() for r, t in regions.items()}


@dataclass(frozen=True)
class Pool:
    """A pool's name, weight and number of windows."""

    name: str
    weight: int
    size: int


def slot_of(pools: list[Pool], p: int, k: int) -> int:
    """The slot of draw ``k`` of pool ``p``.

    Draw k of a pool is due at k / weight, and due draws come in order, of equal ones that of the earlier pool: the pool that is furthest behind its share is next.  The slot is the number
    of draws before it: ceil(k w / weight) of a later pool, one more than floor(k w / weight) of an earlier one.
    """
    own = pools[p].weight
    return k + sum(k * q.weight // own + 1 if i < p else -(-k * q.weight // own) for i, q in enumerate(pools) if i != p)


def draws_before(pools: list[Pool], slot: int) -> list[int]:
    """How many draws each pool has in the slots before ``slot``: a bisection for each pool."""
    out = []
    for p in range(len(pools)):
        low, high = 0, slot
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if slot_of(pools, p, middle) < slot else (low, middle)
        out.append(low)
    return out


_ROUNDS = 6


def permuted_places(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A bijection of 0 to ``size`` - 1 for each key: six Feistel rounds over the next even number of bits, again while the value lies beyond the size."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask, value, open_ = (np.uint64(1) << half) - np.uint64(1), index.astype(np.uint64), np.ones(len(index), bool)
    with np.errstate(over="ignore"):
        while open_.any():
            left, right = value[open_] >> half[open_], value[open_] & mask[open_]
            for r in range(_ROUNDS):
                x = (right + key[open_].astype(np.int64).view(np.uint64) + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & mask[open_])
            value[open_] = left << half[open_] | right
            open_[open_] = value[open_] >= size[open_].astype(np.uint64)
    return value.astype(np.int64)


def permuted(index: Column, size: Column, key: Column) -> Column:
    """``permuted_places`` over columns; no row may be null."""

    @F.pandas_udf("bigint")
    def places(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted_places(index.to_numpy(np.int64), size.to_numpy(np.int64), key.to_numpy(np.int64)))

    return places(index, size, key)


@dataclass(frozen=True)
class State:
    """Where a sequence of draws stands: the pools it was begun with, its seed, and the next slot.  All else follows."""

    pools: tuple[Pool, ...]
    seed: int
    slot: int = 0

    def table(self, spark: SparkSession) -> DataFrame:
        """(pool, size, draws, round, cursor, exposure, left_in_round, deficit) of each pool; ``deficit`` is its share of the slots less its draws."""
        total = sum(p.weight for p in self.pools)
        rows = [(p.name, p.size, n, n // p.size, n % p.size, n / p.size, p.size - n % p.size, self.slot * p.weight / total - n) for p, n in zip(self.pools, draws_before(list(self.pools), self.slot), strict=True)]
        return spark.createDataFrame(rows, "pool string, size bigint, draws bigint, round bigint, cursor bigint, exposure double, left_in_round bigint, deficit double")

    def save(self, spark: SparkSession, path: str) -> None:
        """A new version below ``path``: written beside it and moved, so a reader sees it whole.  A version that is there already is an error."""
        target, staged = f"{path}/slot={self.slot:020d}", files.staging_of(f"{path}/x")
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.text(staged)
        if files.is_filled(spark, target):
            files.remove(spark, staged)
            raise FileExistsError(target)
        files.move(spark, staged, target)

    @staticmethod
    def load(spark: SparkSession, path: str, pools: list[Pool], seed: int) -> State:
        """The last version below ``path``, or the beginning where there is none; other pools or another seed than it was begun with are an error."""
        if not files.is_filled(spark, path):
            return State(tuple(pools), seed)
        last = max((json.loads(r["value"]) for r in spark.read.text(f"{path}/slot=*").collect()), key=lambda x: x["slot"])
        if last["seed"] != seed or [Pool(**p) for p in last["pools"]] != list(pools):
            raise ValueError(f"{path} was begun with other pools or another seed")
        return State(tuple(pools), seed, last["slot"])


def draw(spark: SparkSession, state: State, count: int) -> tuple[DataFrame, State]:
    """(slot, pool, round, cursor, place) of the next ``count`` draws, and the state after them.

    ``place`` is the number of the drawn window in its pool, 0 to size - 1.  A round takes each window of a pool once, in an order of its own that pool, round and seed decide, and the next begins only when it is over.
    Each pool's draws are a range of numbers; Spark makes the rows.  Draws times weights must stay below 2**63.
    """
    pools = list(state.pools)
    if any(p.size < 1 or p.weight < 1 for p in pools):
        raise ValueError("every pool needs a window and a weight")
    begin, end = draws_before(pools, state.slot), draws_before(pools, state.slot + count)
    starts = np.cumsum([0, *(j - i for i, j in zip(begin, end, strict=True))])[:-1].tolist()
    listed = lambda values: F.array(*map(F.lit, values))
    at = lambda values: F.get(listed(values), F.col("p"))
    rows = spark.range(count).withColumn("p", F.size(F.filter(listed(starts), lambda x: x <= F.col("id"))) - 1)
    rows = rows.select("p", (F.col("id") - at(starts) + at(begin)).alias("k"), at([p.name for p in pools]).alias("pool"), at([p.size for p in pools]).cast("long").alias("n"), at([p.weight for p in pools]).cast("long").alias("own"), listed([p.weight for p in pools]).cast("array<bigint>").alias("w"))
    slot = F.expr("aggregate(sequence(0, size(w) - 1), k, (t, j) -> t + CASE WHEN j < p THEN (k * w[j]) div own + 1 WHEN j > p THEN (k * w[j] + own - 1) div own ELSE 0L END)")
    rows = rows.select(slot.alias("slot"), "pool", "n", F.expr("k div n").alias("round"), F.expr("k % n").alias("cursor"))
    place = permuted(F.col("cursor"), F.col("n"), F.xxhash64(F.lit(state.seed), "pool", "round"))
    return rows.select("slot", "pool", "round", "cursor", place.alias("place")), State(state.pools, state.seed, state.slot + count)
