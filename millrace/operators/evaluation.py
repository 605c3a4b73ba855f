"""Evaluation of ridge heads over splits, folds and bootstraps from one pass over the vectors, and scoring with a model of the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import poisson_times

REFIT = 1000003  # added to the seed for the bootstrap of the refit


def row_times(seed: int, row: str) -> Column:
    """How often the seed's bootstrap draws the row."""
    return poisson_times(F.concat_ws("|", F.lit(str(seed)), F.col(row).cast("string")))


def grams(df: DataFrame, key: str, vector: str, label: str, weights: list[Column]) -> DataFrame:
    """(key, gram): for each weight the flattened sum of z z' with z = (1, vector, label), one after the other.

    Each task sums its rows with one matrix product a batch; only sums are shuffled, (width + 2) squared numbers a key, weight and task.
    Rows with a null vector or label take no part; vectors of several widths are an error.
    """
    x = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    x = x.select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), F.array(*[w.cast("double") for w in weights]).alias("w"))

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for part in parts:
            for k, rows in part.groupby("key"):
                z = np.column_stack([np.ones(len(rows)), np.stack(rows["x"]), rows["y"]])
                g = np.stack([(z * w[:, None]).T @ z for w in np.stack(rows["w"]).T]).ravel()
                total[k] = total[k] + g if k in total else g
            if len(total) > 256:
                yield pd.DataFrame({"key": list(total), "g": list(total.values())})
                total = {}
        if total:
            yield pd.DataFrame({"key": list(total), "g": list(total.values())})

    s = x.mapInPandas(sums, "key string, g array<double>").select("key", F.posexplode("g").alias("i", "v")).groupBy("key", "i").agg(F.sum("v").alias("v"))
    return s.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("gram"))


def ridge_from_gram(g: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and coefficients of a ridge fit on standardised columns, for the vectors as they are; a constant column gets 0."""
    n, sums = g[0, 0], g[0, 1:]
    centred = g[1:, 1:] - np.outer(sums, sums) / n
    sd = np.sqrt(np.maximum(np.diag(centred)[:-1], 0) / n)
    scale = np.where(sd > 1e-12, 1 / np.maximum(sd, 1e-12), 0.0)
    a = centred[:-1, :-1] * np.outer(scale, scale) + alpha * np.eye(len(scale))
    beta = np.linalg.solve(a, centred[:-1, -1] * scale) * scale
    return np.concatenate([[(sums[-1] - sums[:-1] @ beta) / n], beta])


def squared_error(g: np.ndarray, coef: np.ndarray) -> float:
    v = np.concatenate([-coef, [1.0]])
    return float(v @ g @ v)


def _chosen(train: np.ndarray, valid: np.ndarray, alphas: tuple[float, ...]) -> float:
    """The penalty with the least error on the validation rows; of equals the smallest."""
    return min(sorted(alphas), key=lambda a: squared_error(valid, ridge_from_gram(train, a)))


def _matrices(flat: list[float], count: int) -> np.ndarray:
    side = round((len(flat) / count) ** 0.5)
    return np.asarray(flat).reshape(count, side, side)


def _predict(coef: Column, vector: str) -> Column:
    dot = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.slice(coef, 2, F.size(coef) - 1), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.get(coef, F.lit(0)) + dot


def fixed_split_ridge(df: DataFrame, row: str, vector: str, label: str, seeds: tuple[int, ...], alphas: tuple[float, ...]) -> DataFrame:
    """The test rows with ``pred``: per seed a head on a bootstrap of train, its penalty chosen on validation, refit on a bootstrap of both, scored; seeds averaged.

    One pass gives the sums of every seed's bootstraps, and fits and choices need the sums only: what reaches the driver is
    (2 seeds + 1) (width + 2)^2 numbers a split.  Without train, validation or test rows there is no result: an error for the first two.
    """
    weights = [row_times(s + more, row) for s in seeds for more in (0, REFIT)] + [F.lit(1)]
    flat = {r["key"]: _matrices(r["gram"], len(weights)) for r in grams(df.where("split IN ('train', 'validation')"), "split", vector, label, weights).collect()}
    if len(flat) < 2:
        raise ValueError("train and validation rows are needed")
    train, valid = flat["train"], flat["validation"]
    coefs = []
    for i in range(len(seeds)):
        alpha = _chosen(train[2 * i], valid[-1], alphas)
        coefs.append(ridge_from_gram(train[2 * i + 1] + valid[2 * i + 1], alpha))
    mean = np.mean(coefs, axis=0)  # the heads are linear, so the mean of their scores is the score of their mean
    return df.where("split = 'test'").withColumn("pred", _predict(F.array(*[F.lit(float(c)) for c in mean]), vector))


def logo_ridge(df: DataFrame, row: str, group: str, vector: str, label: str, seed: int, alphas: tuple[float, ...]) -> DataFrame:
    """Every row with ``pred`` from the fold that tests its group: validation is the last other group by name, train the rest; the penalty is
    chosen there and the head refit on both.  Rows with a null group are left out.

    Sums are made once per group; a fold's are the total less its own, so no row is repeated for a fold.  The bootstrap's draws are those
    of the row in every fold.  Fewer than three groups leave no fold with train rows: no rows then.
    """
    weights = [row_times(seed, row), row_times(seed + REFIT, row), F.lit(1)]
    known = df.where(F.col(group).isNotNull())
    per = grams(known, group, vector, label, weights)
    total = per.select(F.posexplode("gram").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("total"))
    ends = per.select("key").orderBy(F.desc("key")).limit(2).agg(F.sort_array(F.collect_list("key"), False).alias("ends"))
    held = per.join(F.broadcast(ends), F.array_contains("ends", F.col("key"))).select(F.col("key").alias("held"), F.col("gram").alias("held_gram"), "ends")  # two rows
    folds = per.join(F.broadcast(held), (F.col("key") != F.col("held")) & (F.col("held") == F.when(F.col("key") == F.get("ends", F.lit(0)), F.get("ends", F.lit(1))).otherwise(F.get("ends", F.lit(0)))))
    folds = folds.join(F.broadcast(total)).select("key", "gram", "held_gram", "total")  # one row

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            keys, coefs = [], []
            for k, own, valid, whole in part.itertuples(index=False):
                own, valid, whole = (_matrices(m, 3) for m in (own, valid, whole))
                train = whole - own - valid
                if train[2][0, 0] >= 1 and train[0][0, 0] >= 1:
                    keys.append(k)
                    coefs.append(ridge_from_gram(whole[1] - own[1], _chosen(train[0], valid[2], alphas)))
            if keys:
                yield pd.DataFrame({"_k": keys, "_coef": coefs})

    heads = folds.mapInPandas(fit, "_k string, _coef array<double>")
    return known.join(heads, F.col(group).cast("string") == F.col("_k")).withColumn("pred", _predict(F.col("_coef"), vector)).drop("_k", "_coef")


def score_with(df: DataFrame, row: str, sequence: str, scorer: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """(row, score): ``scorer`` maps a batch of sequences to a batch of numbers; it is sent to the tasks once, rows never meet."""

    def score(batch: pd.Series) -> pd.Series:
        return scorer(batch).astype("float64")

    return df.select(row, F.pandas_udf(score, "double")(F.col(sequence)).alias("score"))


class MarkovScorer:
    """Mean log probability of a base after its context, from the rows (context, base, p) of ``corpus.next_bases``.

    Grams with a letter that was never counted take no part; a sequence without a gram scores null.  The table has at most 4 ** (order + 1) rows.
    """

    def __init__(self, table: DataFrame, order: int = 2):
        self.order, self.log_p = order, {r["context"] + r["base"]: float(np.log(r["p"])) for r in table.collect()}

    def __call__(self, batch: pd.Series) -> pd.Series:
        return batch.map(self._mean)

    def _mean(self, s: str | None) -> float | None:
        width = self.order + 1
        found = [self.log_p[g] for i in range(len(s or "") - width + 1) if (g := s[i : i + width]) in self.log_p]
        return sum(found) / len(found) if found else None
