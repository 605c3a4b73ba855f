"""Bootstraps of whole groups with a support rule, and bootstrapped rank metrics of all replicates in one pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialize

TRIES = 100
REPLICATES = 1000


def group_bootstrap(df: DataFrame, group: str, support: Column, cells: DataFrame, cell: list[str], seed: int, tries: int = TRIES) -> DataFrame:
    """(``cell``, ``group``, times, attempt): for each row of ``cells`` as many draws of whole groups with replacement as there are groups.

    ``support`` is an array<string> of what a row stands for (its label, or each output with its value).  A draw counts only if it has everything that ``df`` has; a cell without one is drawn again, up to ``tries``
    times, and then is an error.  A round looks at open cells only, so it costs their number times the groups.  Draw k of attempt t takes group number hash(seed, t, cell, k) modulo the number of groups, in the
    order of their names.  Rows with a null or empty group take no part.  Fewer than two groups are an error: such rows are drawn by stratum.
    """
    rows = df.where(F.col(group).isNotNull() & (F.col(group).cast("string") != "")).select(F.col(group).alias("_g"), F.explode_outer(support).alias("_s"))
    has = materialize(rows.groupBy("_g").agg(F.collect_set("_s").alias("_has")))  # one row for each group
    numbered = materialize(has.withColumn("_k", F.row_number().over(Window.orderBy("_g")) - 1))
    size = numbered.count()
    if size < 2:
        raise ValueError(f"{size} groups can't be drawn with replacement")
    whole = numbered.select(F.explode("_has").alias("s")).agg(F.count_distinct("s")).first()[0]
    open_cells, done = materialize(cells.select(*cell).distinct()), None
    for attempt in range(1, tries + 1):
        u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(str(attempt)), *(F.col(c).cast("string") for c in cell), F.col("_draw").cast("string")), 256), 1, 12), 16, 10).cast("long")
        draws = open_cells.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).groupBy(*cell, (u % size).cast("int").alias("_k")).agg(F.count("*").alias("times"))
        draws = materialize(draws.join(numbered, "_k"))
        full = draws.select(*cell, F.explode("_has").alias("s")).groupBy(*cell).agg(F.count_distinct("s").alias("n")).where(F.col("n") == whole).select(*cell)
        full = materialize(full if whole else draws.select(*cell).distinct())
        kept = draws.join(full, cell, "left_semi").select(*cell, F.col("_g").alias(group), "times", F.lit(attempt).alias("attempt"))
        done = kept if done is None else done.unionByName(kept)
        open_cells = materialize(open_cells.join(full, cell, "left_anti"))
        if open_cells.isEmpty():
            return done
    raise ValueError(f"no draw of whole groups kept what the rows stand for after {tries} tries: {[tuple(r) for r in open_cells.limit(5).collect()]}")


def draw_audit(draws: DataFrame, by: list[str], row: str) -> DataFrame:
    """(``by``, rows, unique_rows, digest) of drawn rows (``row``, times).

    The digest sums a hash of each row times its count modulo two primes, so it does not depend on the order and partial sums go first; no list of draws is made.
    """
    part = lambda salt, prime: F.sum(F.pmod(F.xxhash64(F.lit(salt), F.col(row)), F.lit(prime)) * F.col("times") % prime) % prime
    one = draws.groupBy(*by).agg(F.sum("times").alias("rows"), F.count("*").alias("unique_rows"), part("a", 2147483647).alias("_a"), part("b", 2147483629).alias("_b"))
    return one.select(*by, "rows", "unique_rows", F.concat(F.lpad(F.hex("_a"), 8, "0"), F.lpad(F.hex("_b"), 8, "0")).alias("digest"))


_STEPS = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, k + 1))) for k in range(16)])


def replicate_times(row_hash: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """(rows, replicates): how often each replicate draws a row, Poisson of mean 1 by a hash of row, replicate and seed."""
    with np.errstate(over="ignore"):
        x = row_hash.view(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_STEPS, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53), "right").astype(np.float64)


def bootstrap_ranked(pred: DataFrame, by: list[str], row: str, label: str, score: str, seed: int, replicates: int = REPLICATES, buckets: int = 64) -> DataFrame:
    """(``by``, replicate, auroc, average_precision) of every bootstrap replicate of binary predictions, stratified by label.

    A replicate draws a row a Poisson number of times and weighs each class so that it keeps its size.  The draws are a hash of the row, so they are made where the row is and no table
    of rows times replicates exists: scores are dealt out by range, a task sorts its range and sums for all replicates at once, and what the ranges above it hold comes from one array of sums for each.
    Equal scores count as one step.  A replicate that lacks a class has null values; ``summarize_bootstrap`` makes that an error.  Null labels, scores and rows take no part.
    """
    x = pred.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score) & F.col(row).isNotNull())
    x = x.select(*by, F.col(score).cast("double").alias("_score"), (F.col(label) > 0).alias("_pos"), F.xxhash64(F.col(row)).alias("_h"))
    cuts = sorted({c for c in x.agg(F.percentile_approx("_score", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []})
    edges = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    x = materialize(x.withColumn("_bucket", F.size(F.filter(edges, lambda c: c < F.col("_score")))))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pred.select(*by).schema.fields)
    head = f"{kinds}, " if by else ""

    def times(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return t.column("_pos").to_numpy(zero_copy_only=False).astype(bool), t.column("_h").to_numpy()

    def sums(t: pa.Table) -> pa.Table:
        pos, h = times(t)
        out = np.zeros((2, replicates))
        for k in range(0, len(h), 4096):
            w = replicate_times(h[k : k + 4096], replicates, seed)
            out += np.stack([w[~pos[k : k + 4096]].sum(0), w[pos[k : k + 4096]].sum(0)])
        first = t.slice(0, 1)
        return pa.Table.from_arrays([*(first.column(c) for c in [*by, "_bucket"]), pa.array([out[0].tolist()]), pa.array([out[1].tolist()]), pa.array([int((~pos).sum())], pa.int64()), pa.array([int(pos.sum())], pa.int64())], [*by, "_bucket", "neg", "pos", "n_neg", "n_pos"])

    held = materialize(x.groupBy(*by, "_bucket").applyInArrow(sums, f"{head}_bucket int, neg array<double>, pos array<double>, n_neg bigint, n_pos bigint"))
    # One row for each range and key: as many as ranges, however many rows they hold.
    other = held.select(*by, F.col("_bucket").alias("_o"), "neg", "pos", "n_neg", "n_pos")
    add = lambda rows: F.aggregate(rows, F.array_repeat(F.lit(0.0), replicates), lambda t, v: F.zip_with(t, v, lambda a, b: a + b))
    spread = held.select(*by, "_bucket").join(other, by) if by else held.select("_bucket").join(F.broadcast(other))
    above = F.col("_o") > F.col("_bucket")
    pick = lambda c, when: add(F.filter(F.collect_list(F.when(when, F.col(c))), lambda v: v.isNotNull()))
    known = materialize(spread.groupBy(*by, "_bucket").agg(pick("neg", above).alias("neg_above"), pick("pos", above).alias("pos_above"), pick("neg", F.lit(True)).alias("neg_all"), pick("pos", F.lit(True)).alias("pos_all"), F.sum("n_neg").alias("n_neg"), F.sum("n_pos").alias("n_pos")))

    def ranked(t: pa.Table, k: pa.Table) -> pa.Table:
        if not len(t) or not len(k):
            return pa.Table.from_pylist([], schema)
        neg_above, pos_above, neg_all, pos_all = (np.array(k.column(c)[0].as_py()) for c in ("neg_above", "pos_above", "neg_all", "pos_all"))
        n_neg, n_pos = (k.column(c)[0].as_py() for c in ("n_neg", "n_pos"))
        with np.errstate(divide="ignore", invalid="ignore"):
            neg_scale, pos_scale = n_neg / neg_all, n_pos / pos_all
            (pos, h), s = times(t), t.column("_score").to_numpy()
            order = np.argsort(-s, kind="stable")
            pos, h, s = pos[order], h[order], s[order]
            step = np.flatnonzero(np.concatenate([s[1:] != s[:-1], [True]])) + 1
            auc, ap, fp, tp, begin = np.zeros(replicates), np.zeros(replicates), neg_above * neg_scale, pos_above * pos_scale, 0
            for end in step:
                w = replicate_times(h[begin:end], replicates, seed)
                own = pos[begin:end]
                dn, dp = w[~own].sum(0) * neg_scale, w[own].sum(0) * pos_scale
                auc += dn * (tp + dp / 2)
                fp, tp, begin = fp + dn, tp + dp, end
                ap += np.where(dp > 0, dp * tp / (tp + fp), 0.0)
        first = t.slice(0, 1)
        return pa.Table.from_arrays([*(pa.chunked_array([pa.array([first.column(c)[0].as_py()] * replicates, first.schema.field(c).type)]) for c in by), pa.array(np.arange(replicates)), pa.array(auc / (n_neg * n_pos) if n_neg and n_pos else auc * np.nan), pa.array(ap / n_pos if n_pos else ap * np.nan)], schema=schema)

    schema = pa.schema([*((f.name, _arrow(f.dataType.simpleString())) for f in pred.select(*by).schema.fields), ("replicate", pa.int64()), ("auroc", pa.float64()), ("average_precision", pa.float64())])
    parts = x.groupBy(*by, "_bucket").cogroup(known.groupBy(*by, "_bucket")).applyInArrow(ranked, f"{head}replicate bigint, auroc double, average_precision double")
    finite = lambda c: F.when(~F.isnan(F.sum(c)) & (F.abs(F.sum(c)) < float("inf")), F.sum(c)).alias(c)
    return parts.groupBy(*by, "replicate").agg(finite("auroc"), finite("average_precision"))


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[kind]


def summarize_bootstrap(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """(``by``, mean, low, high, replicates): mean and percentiles 2.5 and 97.5 of the replicates; a null or non-finite one is an error."""
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    x = values.withColumn(value, F.when(bad, F.raise_error(F.lit(f"non-finite bootstrap value of {value}"))).otherwise(F.col(value)))
    at = lambda q: F.percentile(value, F.lit(q))
    return x.groupBy(*by).agg(F.avg(value).alias("mean"), at(0.025).alias("low"), at(0.975).alias("high"), F.count("*").alias("replicates"))
