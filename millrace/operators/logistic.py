"""Logistic heads of many bootstraps, folds and penalties at once: every Newton step of all of them is one pass over the rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialize
from . import metrics
from .evaluation import REFIT, row_times

# The grids of the penalty's inverse, for all rows and for few-shot evaluation.
C_GRID, FEW_SHOT_C_GRID = (0.01, 0.1, 1.0, 10.0), (0.01, 0.1, 1.0, 10.0, 100.0)
#: Fits that run together; each holds (width + 1) squared sums in a task and on the driver, so vectors wider than a head's input are projected first.
CELLS_AT_ONCE = 64
MAX_STEPS = 60


def _summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``part`` (vectors, labels, weights) over all rows: one array of ``size`` numbers a task, summed by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for b in batches:
            if len(b):
                total += part(np.stack(b["x"]), b["y"].to_numpy(), np.stack(b["w"])).ravel()
        yield pd.DataFrame({"i": np.arange(size), "v": total})

    out = np.zeros(size)
    for r in rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["i"]] = r["v"]
    return out


def fit_cells(df: DataFrame, vector: str, label: str, cells: list[tuple[Column, float]], tolerance: float = 1e-7) -> np.ndarray:
    """(cells, 1 + width): intercept and coefficients, for the vectors as they are, of a head for each cell (weight of a row, c).

    A head is the least of the class-balanced log loss, times c, plus half the squared weights of features that are standardised over the cell's rows.  A feature that is constant there gets 0.  Rows with a null vector or
    label take no part; a cell that lacks a class is an error.  Steps that do not lessen the loss are halved.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    rows = materialize(rows.select(F.col(vector).cast("array<double>").alias("x"), (F.col(label) > 0).cast("double").alias("y"), F.array(*[w.cast("double") for w, _ in cells]).alias("w")))
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("there are no rows to fit")
    n, d = len(cells), first["d"]

    def moments(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        w = np.column_stack([np.ones(len(x)), w])
        return np.column_stack([w.sum(0), w.T @ y, w.T @ x, w.T @ x**2])

    m = _summed(rows, moments, (n + 1) * (2 + 2 * d)).reshape(n + 1, -1)
    total, positive = m[:, 0], m[:, 1]
    if (short := np.flatnonzero((positive[1:] <= 0) | (positive[1:] >= total[1:]))).size:
        raise ValueError(f"cells without both classes: {short[:5].tolist()}")
    mean = m[:, 2 : 2 + d] / total[:, None]
    sd = np.sqrt(np.maximum(m[:, 2 + d :] / total[:, None] - mean**2, 0))
    centre, scale = mean[0], np.where(sd[0] > 1e-12, sd[0], 1.0)
    spread = sd[1:] / scale
    penalty = np.column_stack([np.zeros(n), np.where(spread > 1e-9, spread**2, 1e12) / np.array([c for _, c in cells])[:, None]])
    balance = np.stack([total[1:] / (2 * (total[1:] - positive[1:])), total[1:] / (2 * positive[1:])])  # of class 0 and 1

    def at(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def part(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
            z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
            out = []
            for k in range(n):
                s = w[:, k] * balance[y.astype(int), k]
                f = z @ beta[k]
                p = 1 / (1 + np.exp(-f))
                out.append(np.concatenate([[(s * (np.logaddexp(0, f) - y * f)).sum()], z.T @ (s * (p - y)), ((z * (s * p * (1 - p))[:, None]).T @ z).ravel()]))
            return np.stack(out)

        sums = _summed(rows, part, n * (1 + (d + 1) + (d + 1) ** 2)).reshape(n, -1)
        loss = sums[:, 0] + 0.5 * (penalty * beta**2).sum(1)
        return loss, sums[:, 1 : d + 2] + penalty * beta, sums[:, d + 2 :].reshape(n, d + 1, d + 1) + penalty[:, None, :] * np.eye(d + 1)

    beta, kept, best = np.zeros((n, d + 1)), np.zeros((n, d + 1)), np.full(n, np.inf)
    step, settled = np.zeros((n, d + 1)), np.zeros(n, bool)
    for _ in range(MAX_STEPS):
        loss, slope, curve = at(beta)
        worse = loss > best + 1e-12 * np.abs(np.where(np.isfinite(best), best, 0))
        better = ~worse & ~settled
        kept[better], best[better] = beta[better], loss[better]
        step[better] = np.linalg.solve(curve[better], slope[better][:, :, None])[:, :, 0] if better.any() else 0
        step[worse] /= 2
        settled |= np.abs(step).max(1) < tolerance
        if settled.all():
            break
        beta = np.where(settled[:, None], kept, kept - step)
    coef = kept[:, 1:] / scale
    return np.column_stack([kept[:, 0] - coef @ centre, coef])


def _score(coefs: np.ndarray, vector: str) -> Column:
    """The probability by each head, in order."""
    heads = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in coefs])
    x = F.col(vector).cast("array<double>")
    dot = lambda h: F.aggregate(F.zip_with(x, F.slice(h, 2, F.size(h) - 1), lambda a, b: a * b), F.get(h, F.lit(0)), lambda t, v: t + v)
    return F.transform(heads, lambda h: 1 / (1 + F.exp(-dot(h))))


def _values(rows: DataFrame, label: str, row: str, group: str | None, by: list[str]) -> dict[tuple, float]:
    """Macro F1 of each key and cell of ``rows`` (by, scores), or the mean reciprocal rank where a group is given."""
    x = rows.select(*by, F.col(row).alias("row_no"), F.col(label).cast("double").alias("label"), *([F.col(group).alias("group_id")] if group else []), F.posexplode("scores").alias("cell", "score"))
    found = metrics.ranking(x, [*by, "cell"], "group_id").withColumnRenamed("mrr", "value") if group else metrics.binary(x, [*by, "cell"]).withColumnRenamed("macro_f1", "value")
    return {tuple(r[c] for c in [*by, "cell"]): r["value"] if r["value"] is not None else -1.0 for r in found.select(*by, "cell", "value").collect()}


def fixed_split_logistic(df: DataFrame, row: str, vector: str, label: str, seeds: tuple[int, ...], cs: tuple[float, ...] = C_GRID, group: str | None = None) -> DataFrame:
    """The test rows with ``seed_scores``, ``score`` (their mean) and ``pred``: per seed a head on a bootstrap of train, its c chosen on validation, refit on a bootstrap of both.

    The choice is by macro F1, with ``group`` by the mean reciprocal rank within groups; of equals the smaller c.  A split that is missing is an error.
    """
    have = {r["split"] for r in df.select("split").distinct().collect()}
    if not {"train", "validation", "test"} <= have:
        raise ValueError("train, validation and test rows are needed")
    train, both = F.col("split") == "train", F.col("split").isin("train", "validation")
    trials = [(s, c) for s in seeds for c in cs]
    heads = fit_cells(df, vector, label, [(F.when(train, row_times(s, row)).otherwise(0), c) for s, c in trials])
    value = _values(df.where("split = 'validation'").withColumn("scores", _score(heads, vector)), label, row, group, [])
    chosen = [max((value.get((k,), -1.0), -c) for k, (t, c) in enumerate(trials) if t == s) for s in seeds]
    final = fit_cells(df.where(both), vector, label, [(row_times(s + REFIT, row), -c) for s, (_, c) in zip(seeds, chosen, strict=True)])
    out = df.where("split = 'test'").withColumn("seed_scores", _score(final, vector))
    out = out.withColumn("score", F.aggregate("seed_scores", F.lit(0.0), lambda t, v: t + v) / len(seeds))
    return out.withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def fold_offset(name: str) -> int:
    return int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)


def logo_logistic(df: DataFrame, row: str, group: str, vector: str, label: str, seeds: tuple[int, ...], cs: tuple[float, ...] = C_GRID) -> DataFrame:
    """Every row with ``seed_scores``, ``score`` and ``pred`` of the fold that tests its group: validation is the last other group by name, train the rest; refit on both.

    Each fold has bootstraps of its own, by an offset to the seed from the group's name.  Folds are fitted together, up to CELLS_AT_ONCE heads at a time, and no row is repeated for a fold.  Fewer than three groups are an
    error; rows without a group are left out.
    """
    known = df.where(F.col(group).isNotNull()).withColumn("_g", F.col(group).cast("string"))
    names = sorted(r["_g"] for r in known.select("_g").distinct().collect())  # one row for each fold
    if len(names) < 3:
        raise ValueError(f"{len(names)} groups: leaving one out takes three")
    parts = []
    at_once = max(1, CELLS_AT_ONCE // (len(seeds) * len(cs)))
    for k in range(0, len(names), at_once):
        folds = [(g, names[-1] if g != names[-1] else names[-2]) for g in names[k : k + at_once]]
        trials = [(g, v, s, c) for g, v in folds for s in seeds for c in cs]
        heads = fit_cells(known, vector, label, [(F.when(~F.col("_g").isin(g, v), row_times(s + fold_offset(g), row)).otherwise(0), c) for g, v, s, c in trials])
        value = _values(known.where(F.col("_g").isin(sorted({v for _, v in folds}))).withColumn("scores", _score(heads, vector)), label, row, None, ["_g"])
        chosen = [(g, s, -max((value.get((v, i), -1.0), -c) for i, (h, _, t, c) in enumerate(trials) if (h, t) == (g, s))[1]) for g, v in folds for s in seeds]
        final = fit_cells(known, vector, label, [(F.when(F.col("_g") != g, row_times(s + fold_offset(g) + REFIT, row)).otherwise(0), c) for g, s, c in chosen])
        own = F.coalesce(*[F.when(F.col("_g") == g, F.lit(i)) for i, (g, _) in enumerate(folds)])
        tested = known.where(F.col("_g").isin([g for g, _ in folds]))
        parts.append(tested.withColumn("seed_scores", F.slice(_score(final, vector), own * len(seeds) + 1, len(seeds))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.drop("_g").withColumn("score", F.aggregate("seed_scores", F.lit(0.0), lambda t, v: t + v) / len(seeds))
    return out.withColumn("pred", (F.col("score") >= 0.5).cast("int"))
