"""Draws from pools against the plain greedy rule, and resumed draws against unbroken ones."""

from fractions import Fraction

import numpy as np
import pytest

from millrace.operators import draws as D

POOLS = [D.Pool("a", 5, 7), D.Pool("b", 3, 2), D.Pool("c", 3, 11), D.Pool("d", 1, 1)]


def in_order(pools, count):
    due = sorted((Fraction(k, p.weight), i, k) for i, p in enumerate(pools) for k in range(count))
    return [(s, pools[i].name, k // pools[i].size, k % pools[i].size) for s, (_, i, k) in enumerate(due[:count])]


def test_slots_and_rounds(spark):
    rows, state = D.draw(spark, D.State(tuple(POOLS), 3), 400)
    got = sorted(tuple(r[c] for c in ("slot", "pool", "round", "cursor", "place")) for r in rows.collect())
    assert [r[:4] for r in got] == in_order(POOLS, 400) and state.slot == 400
    sizes = {p.name: p.size for p in POOLS}
    for pool in sizes:
        for t in {r[2] for r in got if r[1] == pool}:
            places = [r[4] for r in got if r[1] == pool and r[2] == t]
            assert len(set(places)) == len(places) and set(places) <= set(range(sizes[pool]))
    assert len({tuple(r[4] for r in got if r[1] == "c" and r[2] == t) for t in range(6)}) > 4
    behind = [abs(400 * p.weight / 12 - sum(r[1] == p.name for r in got)) for p in POOLS]
    assert max(behind) < 1.5


def test_resumed_draws_equal_unbroken_ones(spark, tmp_path):
    path, parts = str(tmp_path / "state"), []
    for count in (13, 1, 86, 0, 50):
        rows, after = D.draw(spark, D.State.load(spark, path, POOLS, 9), count)
        parts += rows.collect()
        if count:
            after.save(spark, path)
    whole, _ = D.draw(spark, D.State(tuple(POOLS), 9), 150)
    assert sorted(map(tuple, parts)) == sorted(map(tuple, whole.collect()))
    with pytest.raises(FileExistsError):
        after.save(spark, path)
    for pools, seed in ([*POOLS[:3]], 9), (POOLS, 8):
        with pytest.raises(ValueError):
            D.State.load(spark, path, pools, seed)
    table = {r["pool"]: r for r in after.table(spark).collect()}
    assert sum(r["draws"] for r in table.values()) == 150 and all(r["round"] * r["size"] + r["cursor"] == r["draws"] for r in table.values())
    with pytest.raises(ValueError):
        D.draw(spark, D.State((D.Pool("x", 1, 0),), 1), 5)


def test_permutations_of_any_size():
    for n in (1, 2, 3, 4, 5, 64, 100, 1023, 1025):
        for key in (0, -5, 1 << 60):
            assert sorted(D.permuted_places(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))


def test_weights_give_the_token_shares():
    w = D.draw_weights(D.LENGTH_SHARES, D.REGION_SHARES)
    tokens = {k: v * k[0] for k, v in w.items()}
    whole = sum(tokens.values())
    assert len(w) == 35 and all(tokens[n, r] * 10_000 == whole * s * t for n, s in D.LENGTH_SHARES.items() for r, t in D.REGION_SHARES.items())
