"""Alignments against a plain matrix, and the searches that stand on them against alignments of all pairs."""

import random

import numpy as np
import pytest

from millrace.operators import homology
from millrace.operators.alignment import Scoring, align, align_even, best_scores


def plain(q, t, low, high, s):
    """Best score of a local alignment over diagonals low to high, by the full matrix."""
    none = -(10**9)
    h, f, best = {}, {}, 0
    for i in range(len(q)):
        e = none
        for j in range(max(0, i + low), min(len(t), i + high + 1)):
            f[i, j] = max(h.get((i - 1, j), none) - s.first, f.get((i - 1, j), none) - s.further)
            e = max(h.get((i, j - 1), none) - s.first, e - s.further) if j - 1 >= i + low else none
            d = max(0, h.get((i - 1, j - 1), 0)) + (s.match if q[i] == t[j] else -s.mismatch)
            h[i, j] = max(d, e, f[i, j])
            best = max(best, h[i, j])
            h[i, j] = h[i, j] if h[i, j] > 0 else 0
            if h[i, j] == 0:
                h[i, j] = none if h[i, j] < 0 else 0
    return best


def edited(rnd, s, rate):
    out = []
    for c in s:
        x = rnd.random()
        out.append(c if x > rate else rnd.choice(["", rnd.choice("ACGT"), c + rnd.choice("ACGT")]))
    return "".join(out)


@pytest.mark.parametrize("scoring", [Scoring(2, 3, 5, 2), Scoring(1, 3, 3, 3), Scoring(1, 1, 2, 1)])
def test_scores_against_the_matrix(scoring):
    rnd = random.Random(str(scoring))
    pairs = []
    for _ in range(60):
        q = "".join(rnd.choices("ACGT", k=rnd.randrange(1, 60)))
        t = "".join(rnd.choices("ACGT", k=rnd.randrange(8))) + edited(rnd, q, rnd.choice([0, 0.05, 0.2, 0.5])) + "".join(rnd.choices("ACGT", k=rnd.randrange(8)))
        low = rnd.randrange(-12, 3)
        pairs.append((q, t or "A", low, low + rnd.randrange(1, 25)))
    pairs.append(("ACGT", "ACGT", -50, 50))
    pairs.append(("AAAA", "CCCC", -4, 4))
    got = align([p[0].encode() for p in pairs], [p[1].encode() for p in pairs], np.array([p[2] for p in pairs]), np.array([p[3] for p in pairs]), scoring)
    for k, (q, t, low, high) in enumerate(pairs):
        assert got.score[k] == plain(q, t, low, high, scoring), (q, t, low, high)
        a, b = q[got.query_begin[k] : got.query_end[k]], t[got.target_begin[k] : got.target_end[k]]
        assert max(len(a), len(b)) <= got.columns[k] <= len(a) + len(b) and got.matches[k] <= min(len(a), len(b))
        if got.score[k]:
            # The letters that are counted give the score again, when gaps are taken as one or as many.
            gaps, unlike = 2 * got.columns[k] - len(a) - len(b), len(a) + len(b) - got.columns[k] - got.matches[k]
            rest = scoring.match * got.matches[k] - scoring.mismatch * unlike - got.score[k]
            assert scoring.further * gaps <= rest <= scoring.first * gaps
            assert a[0] == b[0] and a[-1] == b[-1]
    alone = [align([q.encode()], [t.encode()], np.array([lo]), np.array([hi]), scoring) for q, t, lo, hi in pairs]
    assert all([int(x[0]) for x in one] == [int(x[k]) for x in got] for k, one in enumerate(alone))


def all_hits(queries, targets):
    """The best hit of each query by alignment with every target over all diagonals."""
    best = {}
    for i, q in queries:
        part = [(j, t) for j, t in targets if t and q and 0.6 * len(q) <= len(t) <= 1.7 * len(q)]
        if not part:
            continue
        a = align([q.encode()] * len(part), [t.encode() for _, t in part], np.array([-len(q)] * len(part)), np.array([len(t) for _, t in part]), homology.SCORING)
        for k, (j, t) in enumerate(part):
            covers = 5 * (a.query_end[k] - a.query_begin[k]) >= 4 * len(q) and 5 * (a.target_end[k] - a.target_begin[k]) >= 4 * len(t)
            if a.score[k] and covers and 5 * a.matches[k] >= 4 * a.columns[k]:
                best[i] = max(best.get(i, (0, 0)), (int(a.score[k]), -j))
    return best


def test_search_against_all_alignments(spark):
    rnd = random.Random(12)
    targets = [(1000 + i, "".join(rnd.choices("ACGT", k=rnd.choice([6, 20, 40, 60, 120, 400, 900])))) for i in range(120)]
    targets += [(2000, ""), (2001, None), (2002, targets[3][1]), (900, targets[3][1])]
    queries = [(i, edited(rnd, rnd.choice(targets[:120])[1], rnd.choice([0, 0.02, 0.1, 0.18, 0.3]))) for i in range(90)]
    queries += [(90, None), (91, ""), (92, queries[0][1]), (93, "ACGT" * 30), (94, targets[6][1] * 3)]
    want = all_hits(queries, targets)
    q, t = (spark.createDataFrame(x, "id long, s string") for x in (queries, targets))
    got = {r["query"]: r for r in homology.similarity_join(q, t, "id", "s").collect()}
    bits = lambda score: (0.625 * score - np.log(0.41)) / np.log(2)
    assert len(want) > 50 and set(got) <= set(want)
    same = [i for i in want if i in got and got[i]["bits"] == pytest.approx(bits(want[i][0]))]
    assert len(same) >= 0.95 * len(want), sorted(set(want) - set(same))
    assert all(got[i]["target"] == -want[i][1] for i in same)
    assert homology.similarity_join(q.where("id < 0"), t, "id", "s").isEmpty() and homology.similarity_join(q, t.where("id < 0"), "id", "s").isEmpty()


def test_low_homology_by_groups(spark):
    rows = [("a", "g", 1.0), ("b", "g", 0.0), ("c", "h", 1.0), ("d", "h", 1.0), ("e", None, 0.0), ("f", None, 1.0), ("g", "", 0.0)]
    samples = spark.createDataFrame(rows, "sample_id string, group_id string, label double")
    hits = spark.createDataFrame([("b",), ("d",), ("e",)], "query string")
    low = lambda s: {r["sample_id"]: r["low"] for r in homology.low_homology(s, hits, "sample_id").collect()}
    assert low(samples) == {"a": True, "b": True, "c": False, "d": False, "e": False, "f": True, "g": True}
    assert low(samples.drop("group_id")) == {x: x not in "bde" for x in "abcdefg"}
    with pytest.raises(Exception, match="no positive sample in group g"):
        homology.low_homology(samples.where("sample_id <> 'a'"), hits, "sample_id").collect()


def test_search_among_its_own_rows(spark):
    """A row is no hit of its own, its copies are; seeds that hardly any pair shares are counted over whole tables."""
    rnd = random.Random(8)
    a, b, c = ("".join(rnd.choices("ACGT", k=300)) for _ in range(3))
    near = a[:150] + ("A" if a[150] != "A" else "C") + a[151:]
    t = spark.createDataFrame([(0, a), (1, near), (50, b), (51, b), (52, b), (100, c), (3, None), (150, "")], "id long, s string")
    got = {r["query"]: (r["target"], r["identity"]) for r in homology.similarity_join(t.where("id % 50 = 0"), t, "id", "s", itself=False).collect()}
    assert got == {0: (1, 299 / 300), 50: (51, 1.0)}
    assert homology._shares_seeds(10)(a.encode(), near.encode()) is None and homology._shares_seeds(10)(a.encode(), b.encode()) == (1, 0)
    wanted = np.full(-(-(5**10) // 8), 255, np.uint8)
    counts = {r["seed"]: r["in_targets"] for r in homology._seed_counts(t.selectExpr("s AS sequence").where("sequence IS NOT NULL"), 10, wanted).collect()}
    assert counts[int(homology._seed_numbers(b, 10)[7])] == 3 and counts[int(homology._seed_numbers(a, 10)[7])] == 2


def test_even_gaps_give_the_same_alignments():
    rnd = random.Random(7)
    for alphabet, scoring in (("ACGT", Scoring(1, 3, 3, 3)), ("AC", Scoring(1, 1, 1, 1)), ("A", Scoring(1, 3, 3, 3)), ("ACGTN", Scoring(2, 3, 2, 2))):
        for _ in range(25):
            pairs = []
            for _ in range(rnd.choice([1, 9])):
                a = "".join(rnd.choices(alphabet, k=rnd.choice([1, 2, 20, 120])))
                b = "".join(x for x in a if rnd.random() > 0.05) + "".join(rnd.choices(alphabet, k=rnd.randrange(1, 9)))
                middle = rnd.randrange(-6, 6)
                pairs.append((a.encode(), b.encode(), middle - rnd.randrange(20), middle + rnd.randrange(20)))
            q, t, low, high = zip(*pairs)
            want, got = (f(list(q), list(t), np.array(low), np.array(high), scoring) for f in (align, align_even))
            assert all((x == y).all() for x, y in zip(want, got))
            over = align_even(list(q), list(t), np.array(low), np.array(high), scoring, want.score + 1)
            assert not any(x.any() for x in over)


def test_scores_come_without_alignments():
    rnd = random.Random(31)
    for alphabet, scoring in (("ACGT", homology.SCORING), ("AC", Scoring(1, 1, 2, 1)), ("A", Scoring(2, 3, 5, 2))):
        pairs = []
        for _ in range(40):
            a, b = ("".join(rnd.choices(alphabet, k=rnd.randrange(1, 60))) for _ in range(2))
            b = a[: len(a) // 2] + b[:5] + a[len(a) // 2 :] if rnd.random() < 0.5 else b
            low = rnd.randrange(-len(a), len(b))
            pairs.append((a.encode(), b.encode(), low, rnd.randrange(low, len(b) + 1)))
        q, t, low, high = (list(x) for x in zip(*pairs, strict=True))
        assert (best_scores(q, t, np.array(low), np.array(high), scoring) == align(q, t, np.array(low), np.array(high), scoring).score).all()
    least = homology.least_score(0.8)(np.array([100, 100]), np.array([100, 130]))
    assert least.tolist() == [48, 62]  # 80 letters with 16 gaps of one letter: 64 * 2 - 16 * 5
