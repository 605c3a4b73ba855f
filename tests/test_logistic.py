"""Logistic heads of many cells against optima that are found one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluation as E
from millrace.operators import logistic as L


def optimum(x, y, w, c):
    """Newton steps on standardised features of one weighted sample."""
    mu = w @ x / w.sum()
    sd = np.sqrt(w @ (x - mu) ** 2 / w.sum())
    z = np.column_stack([np.ones(len(x)), np.where(sd > 1e-9, (x - mu) / np.where(sd > 1e-9, sd, 1), 0)])
    s = w * np.where(y > 0, w.sum() / (2 * w[y > 0].sum()), w.sum() / (2 * w[y <= 0].sum()))
    b, pen = np.zeros(z.shape[1]), np.r_[0, np.ones(x.shape[1])] / c
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ b))
        step = np.linalg.solve((z * (s * p * (1 - p))[:, None]).T @ z + np.diag(pen + 1e-13), z.T @ (s * (p - y)) + pen * b)
        b -= step
    return lambda q: 1 / (1 + np.exp(-np.column_stack([np.ones(len(q)), np.where(sd > 1e-9, (q - mu) / np.where(sd > 1e-9, sd, 1), 0)]) @ b))


def macro_f1(y, p):
    f = lambda a, b: 2 * (a & b).sum() / max(1, a.sum() + b.sum())
    return (f(y, p) + f(~y, ~p)) / 2


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 3)) * [1, 40, 0.1] + [5, 0, 1]
    x = np.column_stack([x, np.full(150, 7.0)])
    y = (x @ [1.2, 0.02, -6, 0] + rng.normal(size=150) * 1.5 > 0.5).astype(float)
    split = np.array(["test" if i % 5 == 0 else "validation" if i % 5 == 1 else "train" for i in range(150)])
    group = np.array([f"g{i % 4}" for i in range(150)])
    df = spark.createDataFrame([(i, split[i], group[i], x[i].tolist(), float(y[i]), f"q{i // 10}") for i in range(150)] + [(900, "train", "g1", None, 1.0, "q"), (901, "train", None, [1.0] * 4, None, "q")], "row int, split string, grp string, v array<double>, y double, q string")

    def times(seed):
        return np.array([r["t"] for r in df.where("row < 900").orderBy("row").select(E.row_times(seed, "row").alias("t")).collect()], float)

    return df, x, y, split, group, times


def test_cells_equal_single_optima(data):
    df, x, y, split, _, times = data
    cells = [(F.when(F.col("split") == "train", E.row_times(s, "row")).otherwise(0), c) for s, c in ((0, 0.01), (0, 10.0), (3, 1.0))]
    heads = L.fit_cells(df, "v", "y", cells)
    for h, (s, c) in zip(heads, ((0, 0.01), (0, 10.0), (3, 1.0)), strict=True):
        want = optimum(x, y, times(s) * (split == "train"), c)(x)
        assert np.allclose(1 / (1 + np.exp(-(h[0] + x @ h[1:]))), want, atol=1e-6)
    with pytest.raises(ValueError, match="both classes"):
        L.fit_cells(df.where("y = 1"), "v", "y", cells)
    with pytest.raises(ValueError, match="no rows"):
        L.fit_cells(df.where("row = 900"), "v", "y", cells)


def test_fixed_split(data):
    df, x, y, split, _, times = data
    train, valid, test = (split == s for s in ("train", "validation", "test"))
    want = []
    for s in (0, 1):
        c = max((macro_f1(y[valid] > 0, optimum(x, y, times(s) * train, c)(x[valid]) >= 0.5), -c) for c in (0.01, 1.0))[1]
        want.append(optimum(x, y, times(s + E.REFIT) * (train | valid), -c)(x[test]))
    got = L.fixed_split_logistic(df, "row", "v", "y", (0, 1), (1.0, 0.01)).orderBy("row").collect()
    assert [r["row"] for r in got] == np.flatnonzero(test).tolist()
    assert np.allclose([r["seed_scores"] for r in got], np.array(want).T, atol=1e-6) and np.allclose([r["score"] for r in got], np.mean(want, 0), atol=1e-6)
    assert all(r["pred"] == (r["score"] >= 0.5) for r in got)
    with pytest.raises(ValueError, match="needed"):
        L.fixed_split_logistic(df.where("split <> 'validation'"), "row", "v", "y", (0,))
    ranked = L.fixed_split_logistic(df, "row", "v", "y", (0,), (0.01, 1.0), group="q")
    assert ranked.count() == test.sum()


def test_leave_one_group_out(data):
    df, x, y, _, group, times = data
    got = {r["row"]: r["score"] for r in L.logo_logistic(df, "row", "grp", "v", "y", (5,), (0.1, 10.0)).collect() if r["row"] < 900}
    assert len(got) == 150
    for g in sorted(set(group)):
        held, o = "g2" if g == "g3" else "g3", L.fold_offset(g)
        test, valid = group == g, group == held
        c = max((macro_f1(y[valid] > 0, optimum(x, y, times(5 + o) * ~(test | valid), c)(x[valid]) >= 0.5), -c) for c in (0.1, 10.0))[1]
        want = optimum(x, y, times(5 + o + E.REFIT) * ~test, -c)(x[test])
        assert np.allclose([got[i] for i in np.flatnonzero(test)], want, atol=1e-6)
    with pytest.raises(ValueError, match="takes three"):
        L.logo_logistic(df.where("grp IN ('g1', 'g2')"), "row", "grp", "v", "y", (5,))


def test_head_is_fitted_by_as_many_tasks_as_cores(spark, monkeypatch):
    from millrace.operators import heads

    parts, fit = [], heads.LogisticRegression.fit
    monkeypatch.setattr(heads.LogisticRegression, "fit", lambda self, df: parts.append(df.rdd.getNumPartitions()) or fit(self, df))
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 3)], float(i % 2)) for i in range(60)], "id long, embedding array<double>, label double").repartition(9)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 20))
    try:
        heads.fit_logistic(df, df, steps=2).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert parts == [spark.sparkContext.defaultParallelism]
