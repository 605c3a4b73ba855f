"""Parts shared by the similarity joins: dealing buckets out evenly and comparing them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .store import materialize

__all__ = ["Forest", "components", "deal", "segments"]


def deal(rows: DataFrame, key: list[str], ident: str, cap: int) -> DataFrame:
    """Deal ``rows`` (``key``, ``kind``, ...) out by (key, salt), homes (kind 0) before visitors.

    A bucket with more than ``cap`` homes is cut into salts by the homes' hash; its visitors go to every
    salt, and its homes visit the other salts (kind 1).  So no group in a task holds more than about ``cap`` homes,
    and the visitors are only streamed past them.
    """
    hot = materialize(rows.where("kind = 0").groupBy(*key).count().where(F.col("count") > cap).select(*key, F.ceil(F.col("count") / cap).cast("int").alias("salts")))
    own = F.pmod(F.xxhash64(ident), F.coalesce("salts", F.lit(1))).cast("int")
    salts = F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)
    dealt = rows.join(hot, key, "left").withColumn("own", own).withColumn("salt", F.explode(salts)).drop("salts")
    dealt = dealt.withColumn("kind", F.when((F.col("kind") == 0) & (F.col("salt") != F.col("own")), 1).otherwise(F.col("kind"))).drop("own")
    return dealt.repartition(*key, "salt").sortWithinPartitions(*key, "salt", "kind", ident)


def segments(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of rows with an equal key inside each batch; a run may go on in the next batch."""
    for b in batches:
        if len(b):
            cut = np.zeros(len(b), bool)
            for k in key:
                v = b[k].to_numpy()
                cut[1:] |= v[1:] != v[:-1]
            at = [0, *np.flatnonzero(cut), len(b)]
            for i, j in zip(at, at[1:], strict=False):
                yield tuple(b[k].iloc[i] for k in key), b.iloc[i:j]


class Forest:
    """Union-find over the homes of one bucket; only unions of different trees become links."""

    def __init__(self) -> None:
        self.up: list[int] = []

    def grow(self, n: int) -> None:
        self.up += range(len(self.up), len(self.up) + n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j
