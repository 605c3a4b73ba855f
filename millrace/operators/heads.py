"""Linear heads on embeddings with MLlib: the model is a driver object, each fit a distributed job."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialize
from .metrics import multiclass
from .sampling import k_shot


def _scaled(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    frames = [x.withColumn("raw", array_to_vector(F.col("embedding").cast("array<double>"))) for x in (train, *others)]
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(frames[0])
    return [scaler.transform(x) for x in frames]


def fit_logistic(train: DataFrame, test: DataFrame, c: float = 1.0, steps: int = 50) -> DataFrame:
    """Standardised, class-balanced logistic head; ``test`` with pred and score (probability of the last class)."""
    sizes = train.groupBy("label").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))  # one row per class
    weights = sizes.select("label", (F.sum("n").over(w) / (F.count("*").over(w) * F.col("n"))).alias("weight"))
    # Each step sends a gradient of every task to the driver: as many tasks as cores, whatever the rows.
    cores = train.sparkSession.sparkContext.defaultParallelism
    a, b = _scaled(train.join(weights, "label").coalesce(cores), test)
    # The scaler divides by the sample's deviation; the penalty is that of features of population deviation 1.
    n = max(1, train.count())
    model = LogisticRegression(weightCol="weight", regParam=(n - 1) / n / (c * n), elasticNetParam=0.0, maxIter=steps, standardization=False).fit(a)
    out = model.transform(b)
    return out.withColumn("pred", F.col("prediction").cast("long")).withColumn("score", F.element_at(vector_to_array("probability"), -1)).drop("raw", "features", "rawPrediction", "probability", "prediction")


def fit_ridge(train: DataFrame, test: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``test`` with pred of the least of squared errors plus ``alpha`` times the squared weights of standardised features."""
    a, b = _scaled(train, test)
    size = train.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("s")).first()
    # MLlib divides the penalty by the label's deviation.
    model = LinearRegression(regParam=alpha * (size["s"] or 0.0) / max(1, size["n"]), elasticNetParam=0.0, solver="normal").fit(a)
    return model.transform(b).withColumnRenamed("prediction", "pred").drop("raw", "features")


def select_param(trials: DataFrame, by: list[str], param: str, value: str) -> DataFrame:
    """The parameter with the best value; of equals the smallest."""
    return trials.groupBy(*by).agg(F.max_by(param, F.struct(F.col(value), -F.col(param))).alias(param))


def fit_multilabel(train: DataFrame, test: DataFrame, labels: str, width: int, c: float = 1.0) -> DataFrame:
    """One logistic head for each of ``width`` outputs of a label vector; rows of ``test`` once per output."""
    at = lambda df, i: df.withColumn("label", F.get(labels, F.lit(i)).cast("double"))
    return reduce(DataFrame.unionByName, [fit_logistic(at(train, i), at(test, i), c).withColumn("output", F.lit(i)) for i in range(width)])


def few_shot(train: DataFrame, test: DataFrame, k: int, seeds: tuple[int, ...]) -> DataFrame:
    """Per seed a head on ``k`` rows of each class, scored on the whole of ``test``."""
    return reduce(DataFrame.unionByName, [fit_logistic(k_shot(train, k, s), test).withColumn("seed", F.lit(s)) for s in seeds])


IGNORED = 255


def token_head(tokens: DataFrame, grid: tuple[int, ...] = (5, 20, 80)) -> DataFrame:
    """Rows (split, embedding, label) of tokens: the test tokens with pred and score of a class-balanced head.

    A grid of step counts stands for early stopping: the count with the best macro F1 on validation is taken, of equals the smallest.
    Tokens labelled 255 count nowhere, but those of the test split are scored.
    """
    train, validation = (tokens.where((F.col("split") == s) & (F.col("label") != IGNORED)) for s in ("train", "validation"))
    train = materialize(train)
    best = None
    for steps in sorted(grid):
        f1 = multiclass(fit_logistic(train, validation, steps=steps).withColumn("run", F.lit(0)), ["run"]).first()["macro_f1"]
        if best is None or f1 > best[0]:
            best = (f1, steps)
    return fit_logistic(train, tokens.where("split = 'test'"), steps=best[1]).withColumn("steps", F.lit(best[1]))
