"""Group draws against a plain loop, bootstrapped rank metrics against weighted brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import resampling as R


def plain_draws(groups, seed, cell, tries=100):
    names = sorted(groups)
    whole = set().union(*groups.values())
    for t in range(1, tries + 1):
        drawn = [names[int(hashlib.sha256("|".join(map(str, (seed, t, *cell, k))).encode()).hexdigest()[:12], 16) % len(names)] for k in range(len(names))]
        if set().union(*(groups[g] for g in drawn)) == whole:
            return {(g, drawn.count(g), t) for g in drawn}


def test_group_draws_equal_a_plain_loop(spark):
    groups = {f"g{i}": {"a", "b"} if i in (2, 5) else {"a"} for i in range(9)} | {"rare": {"c"}}
    rows = [(g, x) for g, has in groups.items() for x in has for _ in range(3)] + [("", "z"), (None, "z")]
    df = spark.createDataFrame(rows, "g string, label string")
    cells = spark.createDataFrame([(f, r) for f in ("f1", "f2") for r in range(12)], "fold string, replicate int")
    got = {}
    for r in R.group_bootstrap(df, "g", F.array("label"), cells, ["fold", "replicate"], 7).collect():
        got.setdefault((r["fold"], r["replicate"]), set()).add((r["g"], r["times"], r["attempt"]))
    assert got == {(f, r): plain_draws(groups, 7, (f, r)) for f in ("f1", "f2") for r in range(12)}
    assert max(t for x in got.values() for _, _, t in x) > 1 and all(sum(n for _, n, _ in x) == 10 for x in got.values())
    with pytest.raises(ValueError, match="after 1 tries"):
        R.group_bootstrap(df, "g", F.array("label"), cells, ["fold", "replicate"], 7, tries=1)
    with pytest.raises(ValueError, match="groups"):
        R.group_bootstrap(df.where("g = 'g1'"), "g", F.array("label"), cells, ["fold", "replicate"], 7)
    vectors = spark.createDataFrame([("x", [0, 1]), ("y", [1, 1]), ("z", [0, 0])], "g string, v array<int>")
    each = F.transform("v", lambda v, i: F.concat_ws(":", i.cast("string"), v.cast("string")))
    some = R.group_bootstrap(vectors, "g", each, cells.limit(3), ["fold", "replicate"], 1).collect()
    assert {(r["fold"], r["replicate"]) for r in some} and all({"y", "z"} <= {r["g"] for r in some if (r["fold"], r["replicate"]) == c} for c in {(r["fold"], r["replicate"]) for r in some})


def test_audit_does_not_depend_on_order(spark):
    rows = [(1, f"r{i}", i % 3 + 1) for i in range(50)]
    make = lambda x: R.draw_audit(spark.createDataFrame(x, "c int, r string, times long").repartition(3), ["c"], "r").first()
    a = make(rows)
    assert a == make(rows[::-1]) and (a["rows"], a["unique_rows"]) == (sum(t for *_, t in rows), 50) and len(a["digest"]) == 16
    assert make([*rows[1:], (1, "r0", 2)])["digest"] != a["digest"]


def brute(label, score, w):
    pos, neg = label > 0, label <= 0
    w = np.where(pos, w * pos.sum() / w[pos].sum(), w * neg.sum() / w[neg].sum())
    auc = sum(w[i] * w[j] * (1.0 if score[i] > score[j] else 0.5 if score[i] == score[j] else 0) for i in np.flatnonzero(pos) for j in np.flatnonzero(neg)) / (pos.sum() * neg.sum())
    ap = sum(w[pos & (score == s)].sum() * w[pos & (score >= s)].sum() / w[score >= s].sum() for s in sorted(set(score)) if w[pos & (score == s)].sum()) / pos.sum()
    return auc, ap


def test_replicates_equal_weighted_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(f"run{i % 2}", i, float(rng.integers(0, 2)), round(float(rng.normal()), 1)) for i in range(160)]
    df = spark.createDataFrame([*rows, ("run0", None, 1.0, 0.5), ("run0", 900, None, 0.5), ("run1", 901, 1.0, None)], "run string, row long, label double, score double")
    hashes = {r["row"]: r["h"] for r in df.select("row", F.xxhash64("row").alias("h")).collect()}
    for buckets in (1, 7):
        got = {(r["run"], r["replicate"]): (r["auroc"], r["average_precision"]) for r in R.bootstrap_ranked(df, ["run"], "row", "label", "score", 3, 20, buckets).collect()}
        assert len(got) == 40
        for run in ("run0", "run1"):
            own = [r for r in rows if r[0] == run]
            w = R.replicate_times(np.array([hashes[r[1]] for r in own]), 20, 3)
            for k in range(20):
                assert got[run, k] == pytest.approx(brute(np.array([r[2] for r in own]), np.array([r[3] for r in own]), w[:, k]))
    assert abs(R.replicate_times(np.arange(2000), 50, 1).mean() - 1) < 0.02
    whole = R.bootstrap_ranked(df.drop("run"), [], "row", "label", "score", 3, 5)
    assert whole.count() == 5
    one = R.summarize_bootstrap(R.bootstrap_ranked(df, ["run"], "row", "label", "score", 3, 20), ["run"], "auroc").collect()
    assert {r["replicates"] for r in one} == {20} and all(r["low"] <= r["mean"] <= r["high"] for r in one)
    with pytest.raises(Exception, match="non-finite"):
        R.summarize_bootstrap(R.bootstrap_ranked(df.where("label = 1"), ["run"], "row", "label", "score", 3, 4), ["run"], "auroc").collect()
