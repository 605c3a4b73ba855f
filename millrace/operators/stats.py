"""Paired statistics, rankings and summaries over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 97.5% quantiles of Student's t for 1 to 10 degrees of freedom.
T975 = (12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852)


def macro_micro(df: DataFrame, by: list[str], category: str, value: str) -> DataFrame:
    """Mean of category means, and mean over rows, in one pass over the category sums."""
    g = df.groupBy(*by, category).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return g.groupBy(*by).agg(F.avg("m").alias("macro"), (F.sum("s") / F.sum("n")).alias("micro"))


def task_difficulty(df: DataFrame, task: str, value: str, hard: float = 0.35, spread: float = 0.12) -> DataFrame:
    g = df.groupBy(task).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))
    return g.withColumns({"hard": F.col("mean") < hard, "high_variance": F.col("std") > spread})


def mean_ci(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean with a 95% t interval ; one value is its own interval. Beyond 10 degrees of freedom the quantile is the normal one with its expansion in 1/df."""
    g = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    free = F.greatest(F.lit(1), F.col("n") - 1)
    z = 1.959963984540054
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    wide = sum((F.lit(c) / F.pow(free, F.lit(k)) for k, c in enumerate(terms, 1)), F.lit(z))
    t = F.when(free > len(T975), wide).otherwise(F.element_at(F.array(*map(F.lit, T975)), F.least(F.lit(len(T975)), free).cast("int")))
    half = F.when(F.col("n") < 2, 0.0).otherwise(t * F.col("sd") / F.sqrt("n"))
    return g.select(*by, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def paired_t(df: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """Paired t over seeds for groups of five pairs: interval by the fixed quantile, p by the closed form of t with 4 degrees."""
    d = df.groupBy(*by).agg(F.avg(F.col(left) - F.col(right)).alias("mean"), F.stddev_samp(F.col(left) - F.col(right)).alias("sd"), F.count("*").alias("n")).where("n = 5")
    t = F.abs("mean") / F.nullif(F.col("sd") / F.sqrt(F.lit(5.0)), F.lit(0.0))
    x = 1 + t * t / 4
    cdf = 0.5 + 0.375 * (t / F.sqrt(x)) * (1 - t * t / (12 * x))
    p = F.when(F.col("sd") == 0, F.when(F.col("mean") == 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * (1 - cdf))))
    half = T975[3] * F.col("sd") / F.sqrt(F.lit(5.0))
    return d.select(*by, "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), p.alias("p"))


def holm(df: DataFrame, by: list[str], p: str, order: list[str]) -> DataFrame:
    """Holm adjustment inside each family; null p stays null and is not counted."""
    w = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last(), *order)
    m = F.count(p).over(Window.partitionBy(*by))
    step = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(w) + 1)))
    return df.withColumn("_s", step).withColumn("p_holm", F.when(F.col(p).isNotNull(), F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("_s")


def specialization(ranks: DataFrame, model: str, category: str, rank: str) -> DataFrame:
    """Mean rank outside each category minus inside; models without ranks on both sides are left out."""
    g = ranks.groupBy(model, category).agg(F.sum(rank).alias("s"), F.count(rank).alias("n"))
    w = Window.partitionBy(model)
    g = g.withColumns({"os": F.sum("s").over(w) - F.col("s"), "on": F.sum("n").over(w) - F.col("n")}).where("n > 0 AND on > 0")
    return g.select(model, category, (F.col("os") / F.col("on") - F.col("s") / F.col("n")).alias("specialization"))


def pair_models(results: DataFrame, ours: str) -> DataFrame:
    """Our value beside every other model's on equal task and seed."""
    a = results.where(F.col("model_id") == ours).select("task_id", "seed", F.col("value").alias("our_value"))
    b = results.where(F.col("model_id") != ours).select("task_id", "seed", F.col("model_id").alias("baseline"), F.col("value").alias("baseline_value"))
    return b.join(a, ["task_id", "seed"])


def boot_summary(boot: DataFrame, by: list[str], value: str) -> DataFrame:
    return boot.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"), F.count("*").alias("n"))


def poisson_times(text: Column) -> Column:
    """A draw from Poisson(1) by the hash of ``text``."""
    u = (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    # The Poisson(1) distribution function.
    return sum(((u > p).cast("int") for p in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)), F.lit(0))


def bootstrap_counts(df: DataFrame, replicates: int, seed: int, by: list[str], row: str) -> DataFrame:
    """(by, replicate, row, times): a Poisson bootstrap; each row decides from its own hash how often each replicate draws it.

    Nothing is collected, ranked or joined, so it holds at any size; rows drawn zero times are left out.
    """
    x = df.select(*by, row, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    times = poisson_times(F.concat_ws("|", F.lit(str(seed)), "replicate", row))
    return x.withColumn("times", times).where("times > 0")


def paired_bootstrap(pairs: DataFrame, by: list[str]) -> DataFrame:
    """From replicate deltas: mean, 2.5% and 97.5%, and p = min(1, 2 min tail) with one added to each count."""
    g = pairs.groupBy(*by).agg(F.avg("delta").alias("mean"), F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"), F.count_if(F.col("delta") <= 0).alias("le"), F.count_if(F.col("delta") >= 0).alias("ge"), F.count("*").alias("n"))
    return g.select(*by, "mean", "low", "high", F.least(F.lit(1.0), 2 * (F.least("le", "ge") + 1) / (F.col("n") + 1)).alias("p"))


def ensemble(pred: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    g = pred.groupBy(*by).agg(F.avg("score").alias("score"), F.max("label").alias("label"))
    return g.withColumn("pred", (F.col("score") >= threshold).cast("int"))


def weighted_metrics(df: DataFrame, by: list[str], metric: str, count: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(metric) * F.col(count)) / F.greatest(F.sum(count), F.lit(1))).alias("value"))
