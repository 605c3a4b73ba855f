"""Corpus construction over windows: coordinate and exact deduplication, pools and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import canonical
from .features import gram_counts, gram_letters
from .quality import CROSSING, key_groups, of_kind
from .sampling import hash_rank


def dedup_exact(df: DataFrame) -> DataFrame:
    """One representative (smallest sample_id) per canonical sequence, with occurrence count and sources; only hashes are grouped."""
    g = df.select(F.sha2(canonical(F.col("sequence")), 256).alias("signature"), "sample_id", "group_id").groupBy("signature")
    return g.agg(F.min("sample_id").alias("sample_id"), F.count("*").alias("occurrences"), F.array_join(F.array_sort(F.collect_set("group_id")), ",").alias("sources"))


def pool_sizes(windows: DataFrame) -> DataFrame:
    """Rows and bases of every (length, region) pool, empty ones included."""
    grid = windows.select("length").distinct().crossJoin(F.broadcast(windows.select("region").distinct()))  # one row per pool
    g = windows.groupBy("length", "region").agg(F.count("*").alias("n"), F.sum("length").alias("bases"))
    return grid.join(g, ["length", "region"], "left").select("length", "region", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bases", F.lit(0)).alias("bases"))


def batch_plan(windows: DataFrame, batch: int, seed: int, epoch: int) -> DataFrame:
    """Every window once per epoch: window_id, length, tail, batch_no, slot, batch_order.

    The windows of a length are shuffled over all shards by hash and cut into full batches of that length; what is left of each length is
    shuffled into mixed ``tail`` batches, so that no window is dropped.  Batches are read in the order of ``batch_order``, a hash.
    Places come from ``hash_rank``, so a length of any number of windows stays in many tasks; fewer than ``batch`` windows of each length reach the tail.
    """
    draw = f"{seed}|{epoch}"
    ranked = hash_rank(windows.select("length", "window_id"), ["length"], draw, "pos", "window_id").withColumn("pos", F.col("pos") - 1)
    totals = windows.groupBy("length").agg(F.count("*").alias("n"))  # one row per length
    placed = ranked.join(F.broadcast(totals), "length")
    whole = F.floor(F.col("n") / batch) * batch
    key = lambda name: F.sha2(F.concat_ws("|", F.lit(draw), name, F.col("batch_no").cast("string")), 256)
    numbered = lambda df, tail, name: df.select("window_id", "length", F.lit(tail).alias("tail"), F.floor(F.col("pos") / batch).alias("batch_no"), (F.col("pos") % batch).alias("slot")).withColumn("batch_order", key(name))
    left = placed.where(F.col("pos") >= whole).select("length", "window_id")
    left = hash_rank(left, [], draw, "pos", "window_id").withColumn("pos", F.col("pos") - 1)
    return numbered(placed.where(F.col("pos") < whole), False, F.col("length").cast("string")).unionByName(numbered(left, True, F.lit("tail")))


def dedup_coordinates(windows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per coordinate with its regions merged and the first as main channel."""
    return windows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(F.col("region").cast("string"))), ",").alias("regions"), F.min("region").alias("main_region"), F.count("*").alias("occurrences"))


def cluster_weights(df: DataFrame, cluster: str, power: float = 0.5) -> DataFrame:
    """Each member weighs size ** -power; sizes come from a partial aggregate, so a large cluster is no hot task."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("_n"))
    return df.join(sizes, cluster).withColumn("weight", F.pow(F.col("_n").cast("double"), F.lit(-power))).drop("_n")


def mix_quota(pools: DataFrame, length_share: dict[int, float], region_share: dict[int, float], tokens: int) -> DataFrame:
    """Windows to draw from each (length, region) pool for a token budget, and how many rounds of the pool that takes."""
    share = lambda m, c: F.coalesce(*[F.when(F.col(c) == k, v) for k, v in m.items()], F.lit(0.0))
    x = pools.withColumn("target", share(length_share, "length") * share(region_share, "region") * tokens)
    return x.select("length", "region", F.floor(F.col("target") / F.col("length")).alias("draws"), F.ceil(F.floor(F.col("target") / F.col("length")) / F.nullif(F.col("n"), F.lit(0))).alias("rounds"))


def next_bases(df: DataFrame, order: int = 2) -> DataFrame:
    """Markov counts: (context, base, n, p) with one added to each base; a row's grams are counted where it is read, and groups of them before the shuffle."""
    g = gram_counts(df, [], order + 1).groupBy("gram").agg(F.sum("n").alias("n")).withColumn("g", gram_letters(F.col("gram"), order + 1))
    g = g.select(F.substr("g", F.lit(1), F.lit(order)).alias("context"), F.substr("g", F.lit(order + 1), F.lit(1)).alias("base"), "n")
    w = Window.partitionBy("context")
    return g.withColumn("p", (F.col("n") + 1) / (F.sum("n").over(w) + 4))


def star_links(df: DataFrame, node: str, key: str) -> DataFrame:
    """(a, b): every node with the smallest node of its key; a key of many rows gives a link per row, not per pair."""
    low = df.groupBy(key).agg(F.min(node).alias("a"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.select(key, F.col(node).alias("b")).join(low, key).where("a <> b").select("a", "b")


def resolve_splits(df: DataFrame, cluster: str) -> DataFrame:
    """No cluster in two splits: rows of weaker splits than the cluster's strongest leave."""
    from .sampling import priority

    best = df.groupBy(cluster).agg(F.max(priority()).alias("_best"))
    return df.join(best, cluster).where(priority() == F.col("_best")).drop("_best")


def pool_cursor(quota: DataFrame) -> DataFrame:
    """From (pool columns, n, draws): full rounds, the cursor inside the next, mean exposure of a window and what the round lacks.

    Within a round nothing is drawn twice, so the state is arithmetic on the pool's size.
    """
    d, n = F.col("draws"), F.greatest(F.col("n"), F.lit(1))
    return quota.withColumns({"round": F.floor(d / n), "cursor": d % n, "exposure": d / n, "deficit": F.pmod(-d, n)})


def ready_report(df: DataFrame) -> DataFrame:
    """(check, rows, ok) over samples: repeated ids, repeated canonical sequences, groups in several splits, letters that are no base."""
    keys = {"sample_id": F.col("sample_id"), "signature": F.sha2(canonical(F.col("sequence")), 256), "group_id": F.col("group_id")}
    g = key_groups(df, keys, {"bad_letters": F.col("sequence").rlike("[^ACGTN]")})
    extra = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n") - 1))
    checks = {"repeated_id": extra("sample_id"), "repeated_sequence": extra("signature"), "group_crossing": of_kind("group_id", CROSSING), "bad_letters": F.sum(F.when(F.col("kind") == "bad_letters", F.col("n")))}
    one = g.agg(*[F.coalesce(c, F.lit(0)).alias(k) for k, c in checks.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("rows"), (F.col(k) == 0).alias("ok")) for k in checks])))
