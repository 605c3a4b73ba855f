"""Result tables: plans against results, paired comparisons, coverage and roll-ups of audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_hit(hits: DataFrame, query: str, bits: str, row: str) -> DataFrame:
    """The hit with the most bits per query, the first row on ties, as one aggregation."""
    best = F.max_by(F.struct(*[c for c in hits.columns if c != query]), F.struct(F.col(bits), -F.col(row)))
    return hits.groupBy(query).agg(best.alias("_b")).select(query, "_b.*")


def group_flag(df: DataFrame, group: str, positive: str, flag: str) -> DataFrame:
    """Each row with whether all positives of its group carry ``flag``; null for a group without positives.

    An aggregation and a join, not a window, so that a group of any size stays in many tasks.
    """
    g = df.where(F.col(positive)).groupBy(group).agg(F.bool_and(flag).alias("group_flag"))
    return df.join(g, group, "left")


def shared_means(df: DataFrame, by: list[str], metric: str, seed: str, value: str) -> DataFrame:
    """Means over seeds of the metrics that every seed of a run has."""
    m = df.groupBy(*by, metric).agg(F.count_distinct(seed).alias("_n"), F.avg(value).alias("mean"))
    seeds = df.groupBy(*by).agg(F.count_distinct(seed).alias("_seeds"))
    return m.join(seeds, by).where("_n = _seeds").drop("_n", "_seeds")


def plan_status(plan: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Every planned row as complete, terminal_failed or missing; repeated results count once."""
    seen = done.select(key, F.lit(2).alias("s")).unionByName(failed.select(key, F.lit(1).alias("s"))).groupBy(key).agg(F.max("s").alias("_s"))
    state = F.when(F.col("_s") == 2, "complete").when(F.col("_s") == 1, "terminal_failed").otherwise("missing")
    return plan.join(seen, key, "left").withColumn("state", state).drop("_s")


def status_totals(status: DataFrame, by: list[str]) -> DataFrame:
    names = ("complete", "terminal_failed", "missing")
    return status.groupBy(*by).agg(F.count("*").alias("planned"), *[F.count_if(F.col("state") == n).alias(n) for n in names])


def paired_seeds(ours: DataFrame, theirs: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Deltas against each baseline ``name`` at equal seeds whose pairing tokens are equal and not null."""
    b = theirs.select(*by, name, "seed", "token", F.col(value).alias("_v"))
    return ours.join(b, [*by, "seed", "token"]).select(*by, name, "seed", (F.col(value) - F.col("_v")).alias("delta"))


def paired_replicates(ours: DataFrame, theirs: DataFrame, by: list[str], least: int = 100) -> DataFrame:
    """Deltas by replicate where both sides hold the same replicates of the same token, at least ``least`` of them."""
    keys = [*by, "token"]
    j = ours.select(*keys, "replicate", F.col("value").alias("_a")).join(theirs.select(*keys, "replicate", F.col("value").alias("_b")), [*keys, "replicate"], "full_outer")
    good = j.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("_both")).where(f"_n = _both AND _n >= {least}")
    return j.join(good, keys, "left_semi").select(*keys, "replicate", (F.col("_a") - F.col("_b")).alias("delta"))


def choose_method(seeds: DataFrame, boots: DataFrame, by: list[str], need: int = 5, least: int = 100) -> DataFrame:
    """Paired t where there are ``need`` seeds, else the bootstrap where there are replicates, else a description; winner by sign."""
    s = seeds.groupBy(*by).agg(F.count("*").alias("n_seeds"), F.avg("delta").alias("seed_delta"))
    b = boots.groupBy(*by).agg(F.count("*").alias("n_boot"), F.avg("delta").alias("boot_delta"))
    j = s.join(b, by, "full_outer").na.fill(0, ["n_seeds", "n_boot"])
    method = F.when(F.col("n_seeds") == need, "paired_t").when(F.col("n_boot") >= least, "paired_bootstrap").otherwise("descriptive")
    delta = F.when(F.col("method") == "paired_bootstrap", F.col("boot_delta")).otherwise(F.coalesce("seed_delta", "boot_delta"))
    winner = F.when(F.col("delta") > 0, "ours").when(F.col("delta") < 0, "baseline").otherwise("tie")
    return j.withColumn("method", method).withColumn("delta", delta).withColumn("winner", winner).select(*by, "method", "delta", "winner")


def pairing_token(draws: DataFrame, by: list[str], row: str) -> DataFrame:
    """Hash of the drawn rows and their counts in row order; one list per run and replicate, of an evaluation set's size."""
    item = F.struct(F.col(row).alias("r"), F.concat_ws(":", row, "times").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ",")
    return draws.groupBy(*by).agg(F.sha2(text, 256).alias("token"))


def bootstrap_accuracy(pred: DataFrame, draws: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Accuracy of each replicate, weighted by how often each row was drawn: no copied rows."""
    hit = F.when(F.col("hit"), F.col("times")).otherwise(0)
    return draws.join(pred, keys).groupBy(*by, "replicate").agg((F.sum(hit) / F.sum("times")).alias("value"))


def trajectory(results: DataFrame, model: str, by: list[str], step: str) -> DataFrame:
    """One model's values along its steps, numbered within each series."""
    own = results.where(F.col("model_id") == model)
    return own.withColumn("order_no", F.row_number().over(Window.partitionBy(*by).orderBy(step)))


def dataset_status(tasks: DataFrame, audits: DataFrame, cached: DataFrame) -> DataFrame:
    """Tasks (task_id, kind) as excluded, analysis_only, waiting, failed or ready, and whether a cached audit of the same hash serves.

    ``audits``: task_id, hash, errors.  ``cached``: task_id, hash.
    """
    j = tasks.join(audits, "task_id", "left").join(cached.select("task_id", F.col("hash").alias("_h")), "task_id", "left")
    state = F.when(F.col("kind").isin("excluded", "analysis_only"), F.col("kind")).when(F.col("errors").isNull(), "waiting").when(F.col("errors") > 0, "failed").otherwise("ready")
    return j.select("task_id", state.alias("status"), F.coalesce(F.col("hash") == F.col("_h"), F.lit(False)).alias("reused"))


def merge_coverage(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Per key the stronger profile (formal over smoke) and the union of patterns, in order."""
    p, c = previous.select(key, F.col("profile").alias("_p"), F.col("patterns").alias("_pp")), current.select(key, F.col("profile").alias("_c"), F.col("patterns").alias("_cp"))
    none = F.array().cast("array<string>")
    j = p.join(c, key, "full_outer")
    formal = (F.coalesce("_p", F.lit("")) == "formal") | (F.coalesce("_c", F.lit("")) == "formal")
    return j.select(key, F.when(formal, "formal").otherwise("smoke").alias("profile"), F.array_sort(F.array_union(F.coalesce("_pp", none), F.coalesce("_cp", none))).alias("patterns"))


def category_report(results: DataFrame, value: str, categories: int, tasks: int, seeds: int) -> DataFrame:
    """Per model: macro mean over categories, micro mean over results, mean rank among the models of a task and seed, best category, completeness.

    ``position`` orders the models by the macro mean (ties by name) and is null unless the model has every category, task and seed.
    Ranks run over the models of one task and seed, positions over one row per model.
    """
    rank = F.rank().over(Window.partitionBy("task_id", "seed").orderBy(F.desc(value)))
    same = F.count("*").over(Window.partitionBy("task_id", "seed", value))
    ranked = results.withColumn("_rank", rank + (same - 1) / 2)
    c = ranked.groupBy("model_id", "category").agg(F.avg(value).alias("_m"), F.sum(value).alias("_s"), F.count("*").alias("_n"), F.sum("_rank").alias("_r"))
    best = F.max_by("category", F.struct("_m", -F.col("category")))
    g = c.groupBy("model_id").agg(F.avg("_m").alias("macro"), (F.sum("_s") / F.sum("_n")).alias("micro"), (F.sum("_r") / F.sum("_n")).alias("mean_rank"), best.alias("best_category"), F.count("*").alias("_c"))
    full = results.groupBy("model_id").agg(F.count_distinct("task_id", "seed").alias("_cells"))
    g = g.join(full, "model_id").withColumn("complete", (F.col("_c") == categories) & (F.col("_cells") == tasks * seeds))
    place = F.row_number().over(Window.partitionBy("complete").orderBy(F.desc("macro"), "model_id"))
    return g.withColumn("position", F.when(F.col("complete"), place)).drop("_c", "_cells")


def retention_report(results: DataFrame, full: str, low: str, tasks: tuple[str, ...]) -> DataFrame:
    """(model_id, seed, n_tasks, mean, least) of low / full over the parent tasks, by seed, and over the seeds' means where seed is null.

    ``results`` holds both settings in ``setting``; a full value of zero has no retention and is not counted.
    """
    keys = ["model_id", "task_id", "seed"]
    own = results.where(F.col("task_id").isin(*tasks) & F.col("setting").isin(full, low))
    at = lambda s: F.avg(F.when(F.col("setting") == s, F.col("value")))
    r = own.groupBy(*keys).agg((at(low) / F.nullif(at(full), F.lit(0.0))).alias("_r")).where("_r IS NOT NULL")
    by_seed = r.groupBy("model_id", "seed").agg(F.count("*").alias("n_tasks"), F.avg("_r").alias("mean"), F.min("_r").alias("least"))
    over = by_seed.groupBy("model_id").agg(F.lit(None).cast("long").alias("seed"), F.sum("n_tasks").alias("n_tasks"), F.avg("mean").alias("mean"), F.min("least").alias("least"))
    return by_seed.select("model_id", F.col("seed").cast("long").alias("seed"), "n_tasks", "mean", "least").unionByName(over)


def matrix_rows(plan: DataFrame, status: DataFrame, intervals: DataFrame) -> DataFrame:
    """One row per planned cell (model_id, task_id): its state, its interval where it is complete, and why there is none elsewhere.

    ``status``: model_id, task_id, state.  ``intervals``: model_id, task_id, n, mean, low, high.
    """
    keys = ["model_id", "task_id"]
    x = plan.join(status, keys, "left").join(intervals, keys, "left").withColumn("state", F.coalesce("state", F.lit("not_applicable")))
    done = (F.col("state") == "complete") & F.col("n").isNotNull()
    limit = F.when(F.col("state") == "not_applicable", "model does not take the task").when(F.col("state") != "complete", F.col("state")).when(F.col("n").isNull(), "no value").when(F.col("n") < 2, "one seed: no interval")
    return x.select(*keys, "state", *[F.when(done, F.col(c)).alias(c) for c in ("n", "mean", "low", "high")], limit.alias("limitation"))
