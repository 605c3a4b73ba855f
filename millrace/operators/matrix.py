"""Execution matrices and run states: which task runs on which model, what is done, pending or failed for good."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def applicability(tasks: DataFrame, models: DataFrame) -> DataFrame:
    """Every task and model with the reason where they do not fit, and a row per context within capacity where they do.

    Both sides are registries of a fixed size; Spark broadcasts the smaller one.
    """
    reason = F.when(F.col("needs_strand") & ~F.col("has_strand"), "capability").when(F.size(F.filter("contexts", lambda c: c <= F.col("capacity"))) == 0, "capacity")
    x = tasks.crossJoin(models).withColumn("reason", reason)
    fit = F.when(F.col("reason").isNull(), F.filter("contexts", lambda c: c <= F.col("capacity")))
    return x.select("task_id", "model_id", "reason", F.explode_outer(fit).alias("context_bp"))


def expand_steps(rows: DataFrame, shared: DataFrame, steps: list[int]) -> DataFrame:
    """Template rows once per step with the step in their key, then the shared rows."""
    per = rows.withColumn("step", F.explode(F.array(*map(F.lit, steps)))).withColumn("run_key", F.concat_ws("@", "run_key", F.col("step").cast("string")))
    return per.unionByName(shared.withColumn("step", F.lit(None).cast("int")))


def closure_audit(plan: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Rows per state of a plan: complete, terminal_failed or missing."""
    x = plan.select(key).join(done.select(key, F.lit(True).alias("_d")).distinct(), key, "left").join(failed.select(key, F.lit(True).alias("_f")).distinct(), key, "left")
    state = F.when(F.col("_d"), "complete").when(F.col("_f"), "terminal_failed").otherwise("missing")
    return x.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def pending_rows(items: DataFrame, done: DataFrame, failed: DataFrame, active: DataFrame, key: str) -> DataFrame:
    for other in (done, failed, active):
        items = items.join(other.select(key), key, "left_anti")
    return items


def merge_logs(logs: DataFrame) -> DataFrame:
    """The last row wins per (split, step); a log that resumes drops rows of earlier logs from its first step on.

    ``logs``: log_no, line_no, split, step, value.  The first step of each log is a table of one row per log.
    """
    first = logs.groupBy("log_no").agg(F.min("step").alias("resume"))
    cut = first.withColumn("cut", F.min("resume").over(Window.orderBy(F.desc("log_no")).rowsBetween(Window.unboundedPreceding, -1))).select("log_no", "cut")
    kept = logs.join(F.broadcast(cut), "log_no").where(F.col("cut").isNull() | (F.col("step") < F.col("cut")))
    return kept.groupBy("split", "step").agg(F.max_by("value", F.struct("log_no", "line_no")).alias("value"))


def merge_entries(entries: DataFrame) -> DataFrame:
    """(split, step, metrics) of log entries (log, line, split, step, metrics): the last entry of a (split, step) wins, in the order of logs and lines.

    A log with a ``resume`` entry first takes away what earlier logs have beyond its step (the last such entry's, if it has several); the resume steps are a table of one row per log.
    """
    resumed = entries.groupBy("log").agg(F.max_by(F.when(F.col("split") == "resume", F.col("step")), F.when(F.col("split") == "resume", F.col("line"))).alias("resume"))
    cut = resumed.select("log", F.min("resume").over(Window.orderBy(F.desc("log")).rowsBetween(Window.unboundedPreceding, -1)).alias("cut"))
    kept = entries.where("split <> 'resume'").join(F.broadcast(cut), "log").where("cut IS NULL OR step <= cut")
    return kept.groupBy("split", "step").agg(F.max_by("metrics", F.struct("log", "line")).alias("metrics"))


def best_so_far(log: DataFrame, by: list[str]) -> DataFrame:
    """Running minimum of ``value`` by step, and how many steps ago it was set."""
    w = Window.partitionBy(*by).orderBy("step")
    before = F.min("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = log.withColumn("new", before.isNull() | (F.col("value") < before)).withColumns({"best": F.min("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(w)})
    return x.withColumn("stale", F.col("n") - F.max(F.when(F.col("new"), F.col("n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("n")


def rolling_median(log: DataFrame, by: list[str], width: int = 21) -> DataFrame:
    half = width // 2
    return log.withColumn("median", F.percentile("value", F.lit(0.5)).over(Window.partitionBy(*by).orderBy("step").rowsBetween(-half, half)))
