"""Deterministic splits, samples and leakage removal.  Ranks are windows over keys of the data; ties end at ``sample_id``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import hash_bucket, signature

PRIORITY = {"test": 3, "validation": 2, "train": 1}


def order_hash(seed: int, *cols: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]), 256)


def hash_sample(df: DataFrame, cap: int | None, seed: int = 42, by: str = "split") -> DataFrame:
    """The ``cap`` rows of each group with the smallest hash; all rows if cap is None.  Spark limits each task's group before the shuffle."""
    if cap is not None and cap <= 0:
        raise ValueError("cap must be positive")
    if cap is None:
        return df
    w = Window.partitionBy(by).orderBy(order_hash(seed, "sample_id"), "sample_id")
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def hash_rank(df: DataFrame, by: list[str], seed: int | str, out: str, ident: str = "sample_id") -> DataFrame:
    """``df`` with the 1-based place ``out`` of each row in the order of its hash, then ``ident``, among the rows of its key ``by``.

    In two levels, so that one key of any number of rows stays in many tasks: rows are ordered among those that share the hash's first three digits,
    and the counts of these 4,096 ranges are summed up before each.  Rows with a null key are one key.
    """
    x = df.withColumn("_h", order_hash(seed, ident)).withColumn("_b", F.substring("_h", 1, 3))
    before = Window.partitionBy(*by, F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = x.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    starts = starts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_b").alias("_d"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], F.col("_b") == F.col("_d"))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", ident))
    return x.withColumn("_r", inside).join(starts, same).withColumn(out, F.col("_s") + F.col("_r")).drop("_h", "_b", "_r", "_s", "_d", *[f"_k{i}" for i in range(len(by))])


def derive_validation(df: DataFrame, frac: float = 0.1, seed: int = 42) -> DataFrame:
    """If no validation rows exist, the lowest-hash share of the training rows (half-even rounding, at least one) becomes validation."""
    n = df.agg(F.count_if(F.col("split") == "validation").alias("v"), F.count_if(F.col("split") == "train").alias("t")).first()
    if n["v"] or not n["t"]:
        return df
    k = max(1, round(frac * n["t"]))
    moved = hash_rank(df.where("split = 'train'").select("sample_id"), [], seed, "_k").where(F.col("_k") <= k).select("sample_id", F.lit(True).alias("_m"))
    return df.join(moved, "sample_id", "left").withColumn("split", F.when(F.col("_m"), "validation").otherwise(F.col("split"))).drop("_m")


def repartition_splits(df: DataFrame, seed: int = 42) -> DataFrame:
    b = hash_bucket(F.concat_ws("|", F.lit(str(seed)), F.col("sample_id")), 10)
    return df.withColumn("split", F.when(b < 2, "test").when(b < 4, "validation").otherwise("train"))


def priority(split: str = "split") -> Column:
    return F.coalesce(*[F.when(F.col(split) == s, p) for s, p in PRIORITY.items()], F.lit(0))


def decontaminate(df: DataFrame) -> DataFrame:
    """Per sequence only the rows of its strongest split (test, validation, train) stay.

    Only hashes are grouped, with partial aggregation: a sequence of many copies is no hot task, and no sequence is shuffled.
    """
    sig = signature(F.col("sequence"))
    best = df.select(sig.alias("_sig"), priority().alias("_p")).groupBy("_sig").agg(F.max("_p").alias("_best"), F.min("_p").alias("_least"))
    mixed = best.where("_best <> _least").select("_sig", "_best")
    return df.withColumn("_sig", sig).join(mixed, "_sig", "left").where(F.col("_best").isNull() | (F.col("_best") == priority())).drop("_sig", "_best")


def balanced_cap(df: DataFrame, cap: int, seed: int = 42, rule: str = "half") -> DataFrame:
    """Half positives, the rest negatives, by hash.  Rule ``bounded`` takes at least one and at most what there is of either."""
    pos = cap // 2 if rule == "half" else max(1, cap // 2)
    ranked = hash_rank(df.where("label IN (0, 1)"), ["label"], seed, "_rn")
    return ranked.where(F.col("_rn") <= F.when(F.col("label") == 1, pos).otherwise(cap - pos)).drop("_rn")


def stratified_cap(df: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """Training rows per label by largest remainder: floor of the share, one at least, all at most; other splits stay whole."""
    train = df.where("split = 'train'")
    sizes = train.groupBy("label").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    # One row per class: a small table.
    share = sizes.join(F.broadcast(total)).withColumn("q0", F.least(F.col("n"), F.greatest(F.lit(1), F.floor(cap * F.col("n") / F.col("total")))))
    share = share.withColumn("left", F.lit(cap) - F.sum("q0").over(Window.partitionBy("total")))
    order = Window.partitionBy("total").orderBy(F.desc(cap * F.col("n") / F.col("total") - F.floor(cap * F.col("n") / F.col("total"))), F.desc("n"), "label")
    quota = share.withColumn("k", F.row_number().over(order)).select("label", F.least(F.col("n"), F.col("q0") + F.when((F.col("k") <= F.col("left")), 1).otherwise(0)).alias("quota"))
    picked = hash_rank(train, ["label"], seed, "_rn").join(F.broadcast(quota), "label").where("_rn <= quota").select(df.columns)
    return picked.unionByName(df.where("split <> 'train'"))


def k_shot(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    w = Window.partitionBy("label").orderBy(order_hash(seed, "sample_id"), "sample_id")
    return df.where("split = 'train' AND label IS NOT NULL").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def stratified_pick(df: DataFrame, by: list[str], m: int, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order_hash(seed, "sample_id"), "sample_id")
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= m).drop("_rn")


def _folds(df: DataFrame, group: str) -> DataFrame:
    """(fold, held): each group, and the last other group by name, from the groups alone."""
    names = df.select(group).where(F.col(group).isNotNull()).distinct()
    ends = names.agg(F.max(group).alias("last"))
    prior = names.join(F.broadcast(ends)).where(F.col(group) < F.col("last")).agg(F.max(group).alias("prior"))
    # Two tables of one row.
    folds = names.withColumnRenamed(group, "fold").join(F.broadcast(ends)).join(F.broadcast(prior))
    return folds.select("fold", F.when(F.col("fold") == F.col("last"), F.col("prior")).otherwise(F.col("last")).alias("held"))


def _role(group: str) -> Column:
    return F.when(F.col(group) == F.col("fold"), "test").when(F.col(group) == F.col("held"), "validation").otherwise("train")


def logo_folds(df: DataFrame, group: str, only: tuple[str, ...]) -> DataFrame:
    """Every row once for each fold in ``only``: its group is the test, the last other group by name the validation, the rest train."""
    chosen = _folds(df, group).where(F.col("fold").isin(*only))  # one row per chosen fold
    return df.join(F.broadcast(chosen)).withColumn("role", _role(group)).drop("held")


def logo_sizes(df: DataFrame, group: str) -> DataFrame:
    """(fold, role, n_rows) of all folds, from the counts of the groups: no row is repeated."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    return sizes.crossJoin(_folds(df, group)).groupBy("fold", _role(group).alias("role")).agg(F.sum("n").alias("n_rows"))
