"""Near copies against alignments of all pairs."""

import random

import numpy as np

from millrace.operators import similarity
from millrace.operators.alignment import align


def edited(rnd, s, edits):
    for _ in range(edits):
        at, kind = rnd.randrange(len(s)), rnd.randrange(3)
        s = s[:at] + ("" if kind == 0 else rnd.choice("ACGT")) + s[at + (kind < 2) :]
    return s


def linked(texts):
    """Pairs whose best alignment over a quarter of all diagonals each way is equal in 95% of its columns and covers 90% of both."""
    pairs = sorted(((i, j) for i, a in enumerate(texts) for j in range(i + 1, len(texts)) if a and 4 * max(len(a), len(texts[j])) <= 5 * min(len(a), len(texts[j]))), key=lambda p: len(texts[p[0]]))
    want = {}
    for k in range(0, len(pairs), 400):
        part = pairs[k : k + 400]
        q, t = ([texts[p[x]].encode() for p in part] for x in (0, 1))
        found = align(q, t, np.array([-(len(x) // 4) - 2 for x in q]), np.array([len(x) // 4 + 2 for x in t]), similarity.SCORING)
        for n, p in enumerate(part):
            covers = 10 * (found.query_end[n] - found.query_begin[n]) >= 9 * len(q[n]) and 10 * (found.target_end[n] - found.target_begin[n]) >= 9 * len(t[n])
            if found.score[n] and covers and 20 * found.matches[n] >= 19 * found.columns[n]:
                want[p] = found.matches[n] / found.columns[n]
    return want


def test_pairs_and_clusters_against_all_pairs(spark):
    rnd = random.Random(9)
    texts = {"", "A", "ACGTN" * 5}
    for n in (5, 9, 12, 19, 21, 40, 60, 99, 128, 131, 150):
        base = "".join(rnd.choices("ACGT", k=n))
        texts |= {base} | {edited(rnd, base, e) for e in (1, 1, 2, n // 20, n // 20 + 1)}
        # The same with other ends, on one side or both.
        for left, right in ((n // 20, n // 20), (n // 10, 0), (0, n // 10), (n // 8, n // 8)):
            inner = edited(rnd, base[left : n - right], rnd.choice([0, n // 30]))
            texts |= {"".join(rnd.choices("ACGT", k=left)) + inner + "".join(rnd.choices("ACGT", k=right)), inner}
    hot = "".join(rnd.choices("ACGT", k=90))
    texts |= {edited(rnd, hot, 1) for _ in range(30)}
    texts = sorted(texts)
    df = spark.createDataFrame([*enumerate(texts), (10_000, None)], "node long, c string")
    want = linked(texts)
    got = similarity.near_pairs(df, "node", "c").collect()
    assert {(r["a"], r["b"]): round(r["identity"], 9) for r in got} == {p: round(x, 9) for p, x in want.items()} and len(got) == len(want) > 300
    assert all(min(r["coverage_a"], r["coverage_b"]) >= 0.9 for r in got)
    best = {i: i for p in want for i in p}
    for _ in best:
        for a, b in want:
            best[a] = best[b] = min(best[a], best[b])
    assert {r["node"]: r["component"] for r in similarity.near_clusters(df, "node", "c").collect()} == best
    empty = df.where("node < 0")
    assert similarity.near_pairs(empty, "node", "c").isEmpty() and similarity.near_clusters(empty, "node", "c").isEmpty()


def test_shifted_copies(spark):
    rnd = random.Random(3)
    core = "".join(rnd.choices("ACGT", k=1000))
    left, right = "".join(rnd.choices("ACGT", k=60)), "".join(rnd.choices("ACGT", k=60))
    far = "".join(rnd.choices("ACGT", k=200))
    df = spark.createDataFrame([(1, left + core), (2, core + right), (3, far + core), (4, far + left + core)], "node long, c string")
    got = {(r["a"], r["b"]): r["identity"] for r in similarity.near_pairs(df, "node", "c").collect()}
    assert set(got) == {(1, 2), (3, 4)} and got[1, 2] == 1


def test_long_pairs_through_their_main_diagonal(spark):
    rnd = random.Random(5)
    texts = []
    for n in (600, 1000):
        base = "".join(rnd.choices("ACGT", k=n))
        moved = base[n // 12 :] + "".join(rnd.choices("ACGT", k=n // 12))
        gap = base[: n // 2] + "".join(rnd.choices("ACGT", k=n // 40)) + base[n // 2 :]
        texts += [base, edited(rnd, base, n // 30), edited(rnd, base, n // 12), moved, edited(rnd, moved, n // 60), gap, "".join(rnd.choices("ACGT", k=n)), ("AC" * n)[:n]]
    want = linked(texts)
    pairs = spark.createDataFrame([(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))], "a long, b long")
    got = similarity.confirmed(pairs, spark.createDataFrame(list(enumerate(texts)), "node long, c string"), "node", "c").collect()
    assert {(r["a"], r["b"]) for r in got} == set(want) and len(want) > 5
    assert all(abs(r["identity"] - want[r["a"], r["b"]]) < 1e-9 for r in got)
    rejected = [similarity.likely_band(a.encode(), b.encode()) == (1, 0) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and (i, j) in want]
    assert not any(rejected) and similarity.likely_band(texts[0].encode(), texts[6].encode()) == (1, 0)


def test_pairs_that_no_near_copy_can_be_are_not_aligned():
    rnd = random.Random(8)
    a, b = ("".join(rnd.choices("ACGT", k=n)) for n in (1000, 200))
    # The thirds lie 200 diagonals apart, further than a near copy's edits; a short pair shares a third of its grams.
    assert similarity.likely_band(a.encode(), (a[:333] + b + a[333:666] + b[::-1] + a[666:]).encode()) == (1, 0)
    assert similarity.likely_band(a[:300].encode(), (a[:100] + b).encode()) == (1, 0)
    low, high, *wide = similarity.likely_band(a.encode(), (b[:40] + a).encode())
    assert low <= 40 <= high and wide == [40 - 52, 40 + 52]


def test_pairs_are_refused_by_their_sketches_before_sequences_meet(spark):
    rnd = random.Random(21)
    texts = []
    for n in (130, 300, 900):
        base = "".join(rnd.choices("ACGT", k=n))
        texts += [base, edited(rnd, base, n // 30), base[n // 12 :] + "".join(rnd.choices("ACGT", k=n // 12))]
    repeated = "".join(rnd.choices("ACGT", k=40)) * 8
    texts += [repeated, repeated[:200] + "A" + repeated[200:], "".join(rnd.choices("ACGT", k=320)), "ACGT" * 9]
    marked = similarity.sequence_marks(spark.createDataFrame(list(enumerate(texts)), "node long, c string"), "node", "c").persist()
    pairs = spark.createDataFrame([(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))], "a long, b long")
    left = {(r["a"], r["b"]) for r in similarity._alike(pairs, marked).collect()}
    assert set(linked(texts)) <= left and left == {(3 * k + i, 3 * k + j) for k in range(3) for i, j in ((0, 1), (0, 2), (1, 2))} | {(9, 10)}


def test_edits_are_counted_before_long_pairs_are_aligned():
    rnd = random.Random(22)
    for n in (1100, 2500):
        base = "".join(rnd.choices("ACGT", k=n))
        for share, far in ((0.03, False), (0.05, False), (0.09, True)):
            x = rnd.randrange(n // 10)
            inner = edited(rnd, base[x : n - n // 10 + x], int(share * 0.9 * n))
            other = "".join(rnd.choices("ACGT", k=x)) + inner + "".join(rnd.choices("ACGT", k=n // 10 - x))
            assert similarity.too_many_edits(base.encode(), other.encode(), -n // 6, n // 6) == far
            assert not far or similarity.likely_band(base.encode(), other.encode()) == (1, 0)


def test_canonical_rows_equal_the_column_functions(spark):
    from pyspark.sql import functions as F

    from millrace.functions.sequences import canonical

    df = spark.createDataFrame([(1, "TTTG"), (2, "CAAA"), (3, ""), (4, None), (5, "ACGTN")], "id long, s string")
    got = similarity.canonical_rows(df, "s", "whole").select("id", "s", F.hex("whole").alias("w")).collect()
    want = df.select("id", canonical(F.col("s")).alias("s"), F.upper(F.sha2(canonical(F.col("s")), 256)).alias("w")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
