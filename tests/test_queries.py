"""Every registered query with SQL against DuckDB, on the smallest tables, and edge cases of the metrics by hand."""

import os
from decimal import Decimal

import duckdb
import pytest

from millrace.operators import features, metrics, rows, sampling, stats
from millrace.plans import preparation, queries, reports, stores  # noqa: F401  (each enters its queries)
from millrace.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    want = duck.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_one_class_and_ties(spark):
    one = spark.createDataFrame([(0, 1.0, 0.5, 1), (0, 1.0, 0.5, 2)], "k int, label double, score double, row_no int")
    assert metrics.auroc(one, ["k"]).first()["auroc"] == 0.0 and metrics.average_precision(one, ["k"]).first()["average_precision"] == 1.0
    tied = spark.createDataFrame([(0, 1.0, 0.5, 1), (0, 0.0, 0.5, 2)], "k int, label double, score double, row_no int")
    assert metrics.auroc(tied, ["k"]).first()["auroc"] == 0.5
    assert metrics.top_odds(tied, ["k"], 1.0).first()["top_odds_ratio"] == 1.0


def test_running_sums_over_buckets(spark):
    nan, inf = float("nan"), float("inf")
    vals = [None, -inf, -3.0, -2.5, 0.0, 1e-9, 7.0, 7.5, inf, nan]
    rows = spark.createDataFrame([("a", v, i + 1) for i, v in enumerate(vals)] + [("b", 1.0, 5), ("c", None, 2)], "k string, v double, n long")
    for down in (False, True):
        got = {(r["k"], r["n"]): r["s"] for r in metrics.running_sums(rows, ["k"], "v", {"n": "s"}, down, buckets=3).collect()}
        order = [*range(10, 0, -1)] if down else [*range(1, 11)]
        assert [got["a", n] for n in order] == [sum(order[:i]) for i in range(10)]
        assert got["b", 5] == got["c", 2] == 0


def test_paired_t_of_equal_pairs(spark):
    rows = spark.createDataFrame([("a", s, 0.5, 0.5) for s in range(5)] + [("b", s, 0.6, 0.5) for s in range(5)], "k string, seed int, x double, y double")
    got = {r["k"]: r["p"] for r in stats.paired_t(rows, ["k"], "x", "y").collect()}
    assert got["a"] == 1.0 and got["b"] < 1e-6


def test_no_signature_in_two_splits(spark):
    rows = spark.createDataFrame([("1", "train", "AC"), ("2", "test", "AC"), ("3", "test", "AC"), ("4", "train", "GG")], "sample_id string, split string, sequence string")
    assert sorted(r["sample_id"] for r in sampling.decontaminate(rows).collect()) == ["2", "3", "4"]


def test_cap_must_be_positive(spark):
    with pytest.raises(ValueError):
        sampling.hash_sample(spark.range(1), 0)


def test_boundaries_against_brute_force(spark):
    import random

    rnd, rows, hits = random.Random(3), [("a", None, [1]), ("a", [4], None), ("a", [], [])], 0
    for _ in range(40):
        truth, found = (sorted(rnd.sample(range(120), rnd.randint(0, 9))) for _ in range(2))
        rows.append(("a", truth, found))
        free = list(found)
        for t in truth:
            near = [p for p in free if abs(p - t) <= 20]
            if near:
                free.remove(min(near, key=lambda p: (abs(p - t), p)))
                hits += 1
    got = metrics.boundary_match(spark.createDataFrame(rows, "k string, t array<bigint>, f array<bigint>"), ["k"], "t", "f").first()
    n_truth, n_found = (sum(len(r[i] or []) for r in rows) for i in (1, 2))
    assert got["precision"] == hits / n_found and got["recall"] == hits / n_truth


def test_snv_windows_name_what_is_wrong(spark):
    rows_in = spark.createDataFrame([("ACGTACGT", 5, "A", "C"), ("ACGTACGT", 1, "A", "C"), ("ACGTACGT", 5, "G", "C"), ("ACGTACGT", 5, "AC", "C")], "sequence string, pos1 int, ref string, alt string")
    got = [(r["status"], r["alt_window"]) for r in rows.snv_windows(rows_in, 4).collect()]
    assert got == [("ok", "GTCC"), ("edge", None), ("mismatch", None), ("not_snv", None)]


def test_heads_score_every_test_row(spark):
    n = QUERIES["f05_ridge_head"](spark, DIR).count()
    multi = QUERIES["f04_multilabel_head"](spark, DIR).collect()
    assert len(multi) == 2 * n and all(0 <= r["score"] <= 1 for r in multi)
    few = QUERIES["f09_few_shot"](spark, DIR).collect()
    assert sorted(r["seed"] for r in few) == [42, 43] and all(r["n"] == n for r in few)


def test_negative_sites_pass_long_runs(spark):
    import random

    rnd = random.Random(4)
    n = {"a": 1000, "b": 400}
    rows_in = sorted({("a", 10 * i, 10 * i + 10) for i in range(30)} | {(c, s, s + rnd.randint(1, 120)) for c in n for s in rnd.sample(range(280), 25)})
    elements, lengths = spark.createDataFrame(rows_in, "contig string, start long, end long"), spark.createDataFrame(list(n.items()), "contig string, length long")

    def site(c, at, shift, taken):
        s = at + shift if at + shift < n[c] else at - shift
        while (c, s) in taken:
            s += 10
        return s

    starts = {(c, s) for c, s, _ in rows_in}
    got = sorted(tuple(r) for r in features.negative_sites(elements.select("contig", "start"), lengths, 10).collect())
    assert got == sorted((c, s, site(c, s, 10, starts)) for c, s in starts)
    both = starts | {(c, e) for c, _, e in rows_in}
    got = sorted(tuple(r) for r in features.negative_sites(elements, lengths, 10).collect())
    assert got == sorted((c, s, e, side, site(c, at, max(10, (e - s + 1) // 2), both)) for c, s, e in rows_in for side, at in (("left", s), ("right", e)))


def test_mean_interval_of_large_groups(spark):
    want = {12: 2.200985160, 21: 2.085963447, 30: 2.045229642, 121: 1.979930405}
    data = spark.createDataFrame([(n, float(i % 7)) for n in want for i in range(n)], "k int, v double")
    for r in stats.mean_ci(data, ["k"], "v").collect():
        vals = [float(i % 7) for i in range(r["k"])]
        mean = sum(vals) / len(vals)
        sd = (sum((v - mean) ** 2 for v in vals) / (len(vals) - 1)) ** 0.5
        assert abs((r["high"] - mean) / sd * len(vals) ** 0.5 - want[r["k"]]) < 1e-4


def test_every_window_has_a_batch(spark):
    from millrace.operators import corpus

    rows = [(4 if i % 3 else 8, i % 5, f"w{i}") for i in range(53)]
    out = corpus.batch_plan(spark.createDataFrame(rows, "length int, shard int, window_id string"), 6, 1, 0).collect()
    assert sorted(r["window_id"] for r in out) == sorted(w for _, _, w in rows)
    places = [(r["tail"], None if r["tail"] else r["length"], r["batch_no"], r["slot"]) for r in out]
    assert len(set(places)) == len(out) and all(0 <= r["slot"] < 6 for r in out)
    full = [p[:3] for p in places if not p[0]]
    assert {full.count(b) for b in full} == {6}
    assert len({r["batch_order"] for r in out}) == len({p[:3] for p in places})


def test_ranks_keep_null_values_and_keys(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 2.0), (None, 5.0), (None, None)], "k string, v double")
    got = {(r["k"], r["v"]): r["r"] for r in metrics.average_rank(rows, ["k"], "v", "r").collect()}
    assert got == {("a", None): 1, ("a", 1.0): 2, ("a", 2.0): 3, (None, None): 1, (None, 5.0): 2}


def test_groups_without_one_positive_are_counted(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 0.9, 1), ("a", 1, 0.0, 0.1, 2), ("a", 2, 0.0, 0.1, 3), ("b", 3, 1.0, 0.1, 4), ("b", 3, 1.0, 0.2, 5)], "k string, g int, label double, score double, row_no int")
    got = {r["k"]: (r["n_groups"], r["n_skipped"], r["mrr"]) for r in metrics.ranking(rows, ["k"], "g").collect()}
    assert got == {"a": (1, 1, 1.0), "b": (0, 1, None)}


def test_masks_of_odd_rows(spark):
    """Each base is hashed once; null sequences, unknown letters and ids that are null stay as they were."""
    import hashlib

    from millrace.operators import rows

    codes = [("s", [0, 4, None, 1, 2, 3] * 9), (None, [0, 1]), ("e", []), ("n", None), ("x", [4, None])]
    got = {r["sample_id"]: r for r in rows.mask_tokens(spark.createDataFrame(codes, "sample_id string, codes array<int>"), 7).collect()}
    assert got["n"]["inputs"] is None and got["n"]["targets"] is None and got["e"]["inputs"] == [] and got["x"]["inputs"] == [4, None] and got["x"]["targets"] == [-100, -100]
    for s in ("s", None):
        own, want_in, want_to = dict(codes)[s], [], []
        h = [hashlib.sha256(f"7|{s}|{i}".encode() if s else f"7|{i}".encode()).digest() for i in range(len(own))]
        u, v, w = ([int.from_bytes(x[4 * k : 4 * k + 4], "big") / 2**32 for x in h] for k in range(3))
        least = min(u[i] for i, c in enumerate(own) if c is not None and c < 4)
        for i, c in enumerate(own):
            m = c is not None and c < 4 and (u[i] < 0.15 or (least >= 0.15 and u[i] == least))
            want_to.append(c if m else -100)
            want_in.append((5 if v[i] < 0.8 else int(w[i] * 5) if v[i] < 0.9 else c) if m else c)
        assert (got[s]["inputs"], got[s]["targets"]) == (want_in, want_to)


def test_boundaries_of_one_context_with_many(spark):
    """Ties go to the smaller place, a place is taken once, null places match nothing."""
    df = spark.createDataFrame([("a", [25, 50, None], [10, 40, None])], "k string, t array<bigint>, f array<bigint>")
    got = metrics.boundary_match(df, ["k"], "t", "f").first()
    assert got["precision"] == 2 / 3 and got["recall"] == 2 / 3
