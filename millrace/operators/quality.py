"""Audits that return tables of findings instead of raising."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import signature


def split_bit() -> Column:
    return F.when(F.col("split") == "train", 1).when(F.col("split") == "validation", 2).when(F.col("split") == "test", 4).otherwise(8)


def cross_split_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys in more than one split, as a bit mask with partial aggregation: no distinct, no expand."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.bit_or(split_bit()).alias("mask"), F.count("*").alias("rows"))
    return g.withColumn("n_splits", F.bit_count("mask").cast("int")).where("n_splits > 1").select(key, "rows", "n_splits")


def key_groups(df: DataFrame, keys: dict[str, Column], flags: dict[str, Column] | None = None) -> DataFrame:
    """(kind, key, n, mask) of every value of several keys, with the splits as a bit mask, in one pass and one shuffle of partial counts.

    A row gives one pair for each key, and one of null key for each of ``flags`` that holds.
    """
    null = F.lit(None).cast("string")
    pairs = [F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in keys.items()]
    pairs += [F.struct(F.when(c, F.lit(k)).alias("kind"), null.alias("key")) for k, c in (flags or {}).items()]
    rows = df.select(split_bit().alias("bit"), F.inline(F.filter(F.array(*pairs), lambda x: x["kind"].isNotNull())))
    return rows.groupBy("kind", "key").agg(F.count("*").alias("n"), F.bit_or("bit").alias("mask"))


REPEATED, CROSSING = "n > 1", "key IS NOT NULL AND bit_count(mask) > 1"


def of_kind(kind: str, rule: str) -> Column:
    return F.count_if((F.col("kind") == kind) & F.expr(rule))


def validate_samples(df: DataFrame, required: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """(rule, rows) for each broken rule: ids, splits, symbols, labels, and sequences or groups that cross splits."""
    flags = {
        "missing_id": F.col("sample_id").isNull() | (F.col("sample_id") == ""),
        "bad_split": ~F.coalesce(F.col("split").isin(*required), F.lit(False)),
        "bad_symbol": ~F.coalesce(F.col("sequence").rlike("^[ACGTN]+$"), F.lit(False)),
        "bad_label": F.isnan("label") | (F.abs("label") == float("inf")),
        "missing_label": F.col("label").isNull(),
    }
    keys = {"sample_id": F.col("sample_id"), "signature": signature(F.col("sequence")), "group_id": F.col("group_id"), "split": F.col("split")}
    rules = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)) for k in flags}
    rules |= {f"no_{s}": (of_kind("split", f"key = '{s}'") == 0).cast("long") for s in required}
    rules |= {"duplicate_id": of_kind("sample_id", REPEATED), "cross_split_signature": of_kind("signature", CROSSING), "cross_split_group_id": of_kind("group_id", CROSSING)}
    one = key_groups(df, keys, flags).agg(*[c.alias(k) for k, c in rules.items()])
    found = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("rows")) for k in rules])
    return one.select(F.inline(found)).where("rows > 0")


def audit_dataset(df: DataFrame) -> DataFrame:
    """One row: counts of rows, ids, signatures, and of keys that leak between splits."""
    g = key_groups(df, {"sample_id": F.col("sample_id"), "signature": signature(F.col("sequence")), "group_id": F.col("group_id")})
    ids, none = F.col("kind") == "sample_id", F.lit(0)
    return g.agg(
        F.coalesce(F.sum(F.when(ids, F.col("n"))), none).alias("n_rows"),
        F.coalesce(F.sum(F.when(ids & F.col("key").isNull(), F.col("n"))), none).alias("missing_ids"),
        F.count_if(ids).alias("unique_ids"), of_kind("sample_id", REPEATED).alias("duplicate_ids"),
        of_kind("signature", CROSSING).alias("leaking_signatures"), of_kind("group_id", CROSSING).alias("leaking_groups"),
    )


def full_compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value differs between two tables or that only one of them has."""
    x, y = a.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l")), b.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    state = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").otherwise("differs")
    j = x.join(y, keys, "full_outer").where(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value")))
    return j.select(*keys, state.alias("state"))


def completeness(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many expected keys there are and how many are missing."""
    e = expected.select(*keys).distinct()
    missing = e.join(observed.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("missing"))
    total = e.agg(F.count("*").alias("expected"))
    return total.join(F.broadcast(missing)).withColumn("complete", F.col("missing") == 0)


def terminal_failures(attempts: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """Runs with at least ``most`` failed attempts."""
    return attempts.where("failed").groupBy(*keys).agg(F.count("*").alias("failures")).where(F.col("failures") >= most)


def check_constraints(df: DataFrame, unique: tuple[str, ...] = (), required: tuple[str, ...] = (), allowed: dict[str, tuple] | None = None, foreign: dict[str, DataFrame] | None = None) -> DataFrame:
    """(rule, rows): rules on single rows in one pass, keys by a pre-aggregated count, references by an anti join.

    ``foreign`` maps a column to a one-column table of what it may hold; a null is not a broken reference.
    """
    tests = {f"required:{c}": F.col(c).isNull() for c in required} | {f"allowed:{c}": F.col(c).isNotNull() & ~F.col(c).isin(*v) for c, v in (allowed or {}).items()}
    parts = [df.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1").agg(F.lit(f"unique:{c}").alias("rule"), F.count("*").alias("rows")) for c in unique]
    for c, known in (foreign or {}).items():
        other = known.toDF(c)
        parts.append(df.where(F.col(c).isNotNull()).select(c).join(other, c, "left_anti").agg(F.lit(f"foreign:{c}").alias("rule"), F.count("*").alias("rows")))
    if tests:
        one = df.agg(*[F.count_if(t).alias(f"_{i}") for i, t in enumerate(tests.values())])
        parts.append(one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("rows")) for i, n in enumerate(tests)])).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)


def verify_embeddings(samples: DataFrame, vectors: DataFrame, key: str, width: int) -> DataFrame:
    """(finding, rows) over a full outer join: missing and extra vectors, other labels, wrong widths, values that are not finite."""
    a, b = samples.select(key, F.col("label").alias("_l"), F.lit(True).alias("_a")), vectors.select(key, F.col("label").alias("_m"), "embedding", F.lit(True).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    tests = {
        "missing": F.col("_b").isNull(), "extra": F.col("_a").isNull(), "label": both & ~F.col("_l").eqNullSafe(F.col("_m")),
        "width": both & (F.coalesce(F.size("embedding"), F.lit(-1)) != width), "not_finite": both & ~F.coalesce(finite, F.lit(False)),
    }
    one = a.join(b, key, "full_outer").agg(*[F.count_if(t).alias(n) for n, t in tests.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("finding"), F.col(n).alias("rows")) for n in tests])).alias("x")).select("x.*")


def verify_artifacts(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, finding) of what differs between two tables (path, size_bytes, sha256): missing, unlisted, size or sha256."""
    f = found.select("path", F.col("size_bytes").alias("_n"), F.col("sha256").alias("_h"), F.lit(True).alias("_f"))
    j = manifest.select("path", "size_bytes", "sha256", F.lit(True).alias("_m")).join(f, "path", "full_outer")
    state = F.when(F.col("_f").isNull(), "missing").when(F.col("_m").isNull(), "unlisted").when(~F.col("size_bytes").eqNullSafe(F.col("_n")), "size").when(~F.col("sha256").eqNullSafe(F.col("_h")), "sha256")
    return j.select("path", state.alias("finding")).where("finding IS NOT NULL")


def verify_receipts(receipts: DataFrame, plan_sha256: str, found: DataFrame) -> DataFrame:
    """(run_key, state): the first of status, plan, self_hash, artifact that does not hold, else ok.

    ``found``: path, sha256 of what there is.  Artifacts are looked up one row each, so a receipt of many is no large row in the join.
    """
    f = found.select("path", F.col("sha256").alias("_h"))
    listed = receipts.select("run_key", F.explode("artifacts").alias("a")).select("run_key", "a.path", "a.sha256")
    bad = listed.join(f, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("_h"))).select("run_key").distinct().withColumn("_bad", F.lit(True))
    fails = [("status", ~F.col("status").eqNullSafe(F.lit("ok"))), ("plan", ~F.col("plan_sha256").eqNullSafe(F.lit(plan_sha256))), ("self_hash", ~F.col("receipt_sha256").eqNullSafe(F.col("own_sha256"))), ("artifact", F.col("_bad").isNotNull())]
    return receipts.join(bad, "run_key", "left").select("run_key", F.coalesce(*[F.when(c, n) for n, c in fails], F.lit("ok")).alias("state"))
