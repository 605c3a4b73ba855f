"""Ridge evaluation against fits on the rows themselves."""

import numpy as np

from millrace.operators import evaluation as E


def data(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(160, 4)) * [1, 5, 0.1, 0] + 3
    y = x @ [1, -0.2, 4, 0] + rnd.normal(size=160)
    split = ["test" if i % 5 == 0 else "validation" if i % 5 == 1 else "train" for i in range(160)]
    rows = [(i, split[i], f"g{i % 6}", x[i].tolist(), float(y[i])) for i in range(160)]
    df = spark.createDataFrame([*rows, (900, "train", "g1", None, 1.0), (901, "train", None, [1.0] * 4, None)], "row int, split string, grp string, v array<double>, y double")
    seeds = [0, 1, 42]
    times = df.select("row", *[E.row_times(s + m, "row").alias(f"t{s}_{m}") for s in seeds for m in (0, E.REFIT)]).collect()
    return df, x, y, np.array(split), np.array([f"g{i % 6}" for i in range(160)]), {c: np.array([r[c] for r in times[:160]], float) for c in times[0].asDict()}


def fit(x, y, w, alpha):
    mu = (w @ x) / w.sum()
    sd = np.sqrt(w @ (x - mu) ** 2 / w.sum())
    z = (x - mu) / np.where(sd > 1e-9, sd, 1) * (sd > 1e-9)
    b = np.linalg.solve(z.T @ (z * w[:, None]) + alpha * np.eye(x.shape[1]), z.T @ (w * (y - (w @ y) / w.sum())))
    return lambda q: (q - mu) / np.where(sd > 1e-9, sd, 1) * (sd > 1e-9) @ b + (w @ y) / w.sum()


def best(x, y, w, train, valid, alphas):
    return min(alphas, key=lambda a: ((fit(x[train], y[train], w[train], a)(x[valid]) - y[valid]) ** 2).sum())


def test_fixed_split(spark):
    df, x, y, split, _, t = data(spark)
    train, valid, test = (split == s for s in ("train", "validation", "test"))
    want = np.zeros(test.sum())
    for s in (0, 1):
        a = best(x, y, t[f"t{s}_0"], train, valid, (0.1, 10.0, 1000.0))
        want += fit(x[train | valid], y[train | valid], t[f"t{s}_{E.REFIT}"][train | valid], a)(x[test]) / 2
    got = {r["row"]: r["pred"] for r in E.fixed_split_ridge(df, "row", "v", "y", (0, 1), (10.0, 0.1, 1000.0)).collect()}
    assert sorted(got) == np.flatnonzero(test).tolist()
    assert np.allclose([got[i] for i in sorted(got)], want, atol=1e-6)


def test_leave_one_group_out(spark):
    df, x, y, _, grp, t = data(spark)
    got = {r["row"]: r["pred"] for r in E.logo_ridge(df, "row", "grp", "v", "y", 42, (0.1, 1000.0)).collect() if r["row"] < 900}
    assert len(got) == 160
    for g in sorted(set(grp)):
        held = "g4" if g == "g5" else "g5"
        test, valid = grp == g, grp == held
        a = best(x, y, t["t42_0"], ~test & ~valid, valid, (0.1, 1000.0))
        want = fit(x[~test], y[~test], t[f"t42_{E.REFIT}"][~test], a)(x[test])
        assert np.allclose([got[i] for i in np.flatnonzero(test)], want, atol=1e-6)
    assert E.logo_ridge(df.where("grp IN ('g1', 'g2')"), "row", "grp", "v", "y", 42, (0.1,)).isEmpty()
