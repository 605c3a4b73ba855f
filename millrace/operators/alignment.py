"""Banded local alignment with affine gaps, of many pairs at once in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a row over all pairs that are aligned together.
CELLS = 1 << 15
#: Bytes of scores that ``align_even`` keeps for the pairs of a batch, and at most for one pair.
KEPT, KEPT_ONE = 1 << 26, 1 << 27
_LOW = np.int32(-(1 << 29))


class Scoring(NamedTuple):
    """Scores of equal and of unlike letters, cost of a gap's first letter and of each further one."""

    match: int
    mismatch: int
    first: int
    further: int


class Alignments(NamedTuple):
    """Of each pair: score, equal letters, columns, and the aligned part of query and target; all zero where nothing aligns."""

    score: np.ndarray
    matches: np.ndarray
    columns: np.ndarray
    query_begin: np.ndarray
    query_end: np.ndarray
    target_begin: np.ndarray
    target_end: np.ndarray


def _shift(x: np.ndarray, fill: int) -> np.ndarray:
    """One diagonal up: the cell above lies one place to the right in the row before."""
    out = np.empty_like(x)
    out[:, :-1] = x[:, 1:]
    out[:, -1] = fill
    return out


def align(queries: list[bytes], targets: list[bytes], low: np.ndarray, high: np.ndarray, scoring: Scoring) -> Alignments:
    """The best local alignment of each query with its target over diagonals (target place minus query place) ``low`` to ``high``.

    All pairs move together, a query letter at a time; a row of the band is a vector operation.  Counts of matches and columns and the begin travel with the scores, so
    nothing is traced back and memory follows the band's width.  Of equal scores the first row's and then the lowest diagonal's is taken.
    """
    n, width = len(queries), int((high - low).max()) + 1
    most = max(map(len, queries))
    q = np.full((n, most), 1, np.uint8)  # 1 and 0 are no letters, and not alike
    t = np.zeros((n, most + width), np.uint8)
    for i, (a, b) in enumerate(zip(queries, targets, strict=True)):
        q[i, : len(a)] = np.frombuffer(a, np.uint8)
        at = max(0, -int(low[i]))  # column x of the strip is the target's letter x + low
        part = np.frombuffer(b, np.uint8)[max(0, int(low[i])) :][: max(0, most + width - at)]
        t[i, at : at + len(part)] = part
    inside = np.arange(width)[None, :] <= (high - low)[:, None]
    here, column = np.arange(n), np.arange(width, dtype=np.int32)
    zero32, zero64 = (lambda: np.zeros((n, width), np.int32)), (lambda: np.zeros((n, width), np.int64))
    score, count, begin = zero32(), zero64(), zero64()
    up, up_count, up_begin = np.full((n, width), _LOW), zero64(), zero64()
    best, best_count, best_begin, best_at = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
    for row in range(most):
        letters = t[:, row : row + width]
        same = letters == q[:, row, None]
        # A gap in the target: from the row above.
        opened, longer = _shift(score, int(_LOW)) - scoring.first, _shift(up, int(_LOW)) - scoring.further
        take = longer > opened
        up, up_count, up_begin = np.where(take, longer, opened), np.where(take, _shift(up_count, 0), _shift(count, 0)), np.where(take, _shift(up_begin, 0), _shift(begin, 0))
        # A pair of letters: along the diagonal, from a cell or from nothing.
        fresh = score <= 0
        pair = score + np.where(same, scoring.match, -scoring.mismatch).astype(np.int32)
        pair[(letters == 0) | ~inside] = _LOW
        pair_begin = np.where(fresh, (np.int64(row) << 32) + (row + column + (1 << 20))[None, :], begin)
        pair_count = np.where(fresh, 0, count) + (same.astype(np.int64) << 32) + 1
        take = up > pair
        base, base_count, base_begin = np.where(take, up, pair), np.where(take, up_count, pair_count), np.where(take, up_begin, pair_begin)
        dead = base <= 0
        base[dead], base_count[dead], base_begin[dead] = 0, 0, 0
        # A gap in the query: the best cell to the left, less what the gap costs.
        lifted = np.where(dead, _LOW, base) + scoring.further * column
        left = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(np.concatenate([np.ones((n, 1), bool), lifted[:, 1:] > left[:, :-1]], axis=1), column, 0), axis=1)
        gap = np.full((n, width), _LOW)
        gap[:, 1:] = left[:, :-1] - scoring.further * column[1:] - (scoring.first - scoring.further)
        gap[~inside] = _LOW
        if (take := gap > base).any():
            r, c = np.nonzero(take)
            s = source[r, c - 1]
            score, count, begin = base.copy(), base_count.copy(), base_begin.copy()
            score[r, c], count[r, c], begin[r, c] = gap[r, c], base_count[r, s], base_begin[r, s]
        else:
            score, count, begin = base, base_count, base_begin
        at = score.argmax(axis=1)
        value = score[here, at]
        if (better := value > best).any():
            best[better], best_count[better], best_begin[better] = value[better], count[here, at][better], begin[here, at][better]
            best_at[better] = np.stack([np.full(n, row), at], axis=1)[better]
    found = best > 0
    q0, t0 = best_begin >> 32, (best_begin & 0xFFFFFFFF) - (1 << 20) + low
    q1, t1 = best_at[:, 0] + 1, best_at[:, 0] + best_at[:, 1] + low + 1
    matches, pairs = best_count >> 32, best_count & 0xFFFFFFFF
    columns = (q1 - q0) + (t1 - t0) - pairs
    return Alignments(*(np.where(found, x, 0) for x in (best, matches, columns, q0, q1, t0, t1)))


def kept_bytes(most: int, width: int) -> int:
    """Bytes of scores that ``align_even`` keeps for a pair of ``most`` letters on both sides together."""
    return 2 * (most + 2) * (width // 2 + 4) * (1 if most < 1 << 15 else 2)


def _highest(x: np.ndarray) -> np.ndarray:
    """Maxima over the first axis, by halves where the second is short: numpy takes a row at a time."""
    while len(x) > 64 and 1 < x.shape[1] < 8:
        h = len(x) // 2
        y = np.maximum(x[:h], x[h : 2 * h])
        if len(x) % 2:
            np.maximum(y[0], x[-1], out=y[0])
        x = y
    return x.max(axis=0)


#: Cells of a diagonal that are traced back together.
_BACK = 32


def align_even(queries: list[bytes], targets: list[bytes], low: np.ndarray, high: np.ndarray, scoring: Scoring, least: np.ndarray | None = None) -> Alignments:
    """``align`` for gaps whose letters all cost the same: the same alignments, several times faster, in memory that follows the product of length and band.

    Cells of one sum of places (query and target) need only those of the two sums before, so that a step is a few operations on scores alone, pairs side by side.  The scores are kept and the best
    alignment is traced back, by the choices that ``align`` makes among equal ones.  Pairs that score under ``least`` are taken for such where nothing aligns.
    """
    assert scoring.first == scoring.further
    n, gap = len(queries), scoring.first
    steps = max(len(a) + len(b) for a, b in zip(queries, targets, strict=True)) - 1
    half = low >> 1  # of the even diagonal at or below the band's lowest
    size = int((high - 2 * half).max()) // 2 + 1
    last = max(steps - 1, 0) >> 1
    # Diagonal 2 (half + k) + p of sum 2 h + p: query place h - half - k, target place h + p + half + k.  1 and 0 are no letters, and not alike.
    q, t = np.full((last + size, n), 1, np.uint8), np.zeros((last + size + 1, n), np.uint8)
    for x, (a, b) in enumerate(zip(queries, targets, strict=True)):
        e = int(half[x])
        top = last - e  # where the query's first letter lies; the others before it
        rows = np.arange(max(0, top - len(q) + 1), min(len(a), top + 1))
        q[top - rows, x] = np.frombuffer(a, np.uint8)[rows]
        rows = np.arange(max(0, e), min(len(b), e + len(t)))
        t[rows - e, x] = np.frombuffer(b, np.uint8)[rows]
    kind = np.int16 if steps < 1 << 15 else np.int32
    column = 2 * np.arange(size)[:, None]
    inside = [((column + p + 2 * half >= low) & (column + p + 2 * half <= high)).astype(kind) for p in (0, 1)]
    whole = [bool(x.all()) for x in inside]
    scores = np.zeros((steps + 2, size + 2, n), kind)
    most = np.zeros((steps, n), kind)
    room, gaps, worth = np.empty((size, n), bool), np.empty((size, n), kind), kind(scoring.match + scoring.mismatch)
    zeros = np.zeros((size, n), kind)
    for s in range(steps):
        h, p = s >> 1, s & 1
        x, near = scores[s + 2, 1:-1], scores[s + 1]
        np.equal(q[last - h : last - h + size], t[h + p : h + p + size], out=room)
        np.multiply(room, worth, out=x)
        x += scores[s, 1:-1]
        x -= kind(scoring.mismatch)
        np.maximum(near[p : p + size], near[p + 1 : p + 1 + size], out=gaps)
        gaps -= kind(gap)
        np.maximum(x, gaps, out=x)
        np.maximum(x, zeros, out=x)
        if not whole[p]:
            x *= inside[p]
        most[s] = _highest(x)
    best = most.max(axis=0).astype(np.int64)
    if least is not None:
        best[best < least] = 0
    # Of equal scores the first query place's, then the lowest diagonal's.
    end = np.full((3, n), np.iinfo(np.int64).max)
    ss, pp = np.nonzero((most == best) & (best > 0))
    for i in range(0, len(ss), 1 << 12):
        s, x = ss[i : i + (1 << 12)], pp[i : i + (1 << 12)]
        k = size - 1 - (scores[s + 2, 1:-1, x] == best[x, None])[:, ::-1].argmax(axis=1)
        place, diagonal = (s >> 1) - half[x] - k, 2 * k + (s & 1)
        order = np.lexsort((diagonal, place, x))
        x, first = np.unique(x[order], return_index=True)
        own = order[first]
        better = (place[own] < end[0, x]) | ((place[own] == end[0, x]) & (diagonal[own] < end[1, x]))
        end[:, x[better]] = np.stack([place[own], diagonal[own], s[own]])[:, better]
    begin, matches, pairs = np.zeros((2, n), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    x = np.nonzero(best > 0)[0]
    c, s, run = end[1, x], end[2, x], np.zeros(len(x), bool)
    back = np.arange(_BACK)[:, None]
    while len(x):
        # Letters that meet, a stretch of each diagonal at a time.
        own = np.nonzero(~run)[0]
        y, p, s0 = x[own], s[own] & 1, s[own]
        k, h, sums = (c[own] - p) >> 1, np.maximum((s0 >> 1) - back, 0), np.maximum(s0 - 2 * back, 0)
        same = q[last - h + k, y] == t[h + p + k, y]
        before, above, left = scores[sums, k + 1, y], scores[sums + 1, k + p + 1, y] - kind(gap), scores[sums + 1, k + p, y] - kind(gap)
        pair = before + np.where(same, kind(scoring.match), kind(-scoring.mismatch))
        goes = (above <= pair) & (left <= np.maximum(pair, 0))
        ends = goes & (before <= 0)
        length = np.where((~goes | ends).any(axis=0), (~goes | ends).argmax(axis=0), _BACK)
        fits = np.minimum(length, _BACK - 1)
        done = (length < _BACK) & ends[fits, np.arange(len(own))]
        length += done
        matches[y] += (same & (back < length)).sum(axis=0)
        pairs[y] += length
        at = (s0 >> 1) - length + 1
        begin[:, y[done]] = np.stack([at - k - half[y], at + p + k + half[y]])[:, done]
        s[own] -= 2 * length
        stays = np.ones(len(x), bool)
        stays[own[done]] = False
        x, c, s, run = x[stays], c[stays], s[stays], run[stays]
        # A step of any kind.
        h, p = s >> 1, s & 1
        k = (c - p) >> 1
        same = q[last - h + k, x] == t[h + p + k, x]
        before, above, left = scores[s, k + 1, x].astype(np.int64), scores[s + 1, k + p + 1, x] - gap, scores[s + 1, k + p, x] - gap
        pair = before + np.where(same, scoring.match, -scoring.mismatch)
        base = np.maximum(np.maximum(pair, above), 0)
        # A gap in the query begins as far left as one with its score can.
        run = np.where(run, left >= base, left > base) & (left > 0)
        up = ~run & (above > pair)
        met = ~run & ~up
        matches[x[met]] += same[met]
        pairs[x[met]] += 1
        done = met & (before <= 0)
        e = half[x[done]]
        begin[:, x[done]] = np.stack([(h - k)[done] - e, (h + p + k)[done] + e])
        c, s = c + up - run, s - 1 - met
        if done.any():
            x, c, s, run = x[~done], c[~done], s[~done], run[~done]
    found = best > 0
    q1 = end[0] + 1
    t1 = q1 + end[1] + 2 * half
    columns = (q1 - begin[0]) + (t1 - begin[1]) - pairs
    return Alignments(*(np.where(found, v, 0) for v in (best, matches, columns, begin[0], q1, begin[1], t1)))


def best_scores(queries: list[bytes], targets: list[bytes], low: np.ndarray, high: np.ndarray, scoring: Scoring) -> np.ndarray:
    """The scores of ``align`` without the alignments, ten times faster: a sum of places at a time as in ``align_even``, of which only the last two are kept."""
    n = len(queries)
    steps = max(len(a) + len(b) for a, b in zip(queries, targets, strict=True)) - 1
    half = low >> 1
    size = int((high - 2 * half).max()) // 2 + 1
    last = max(steps - 1, 0) >> 1
    q, t = np.full((last + size, n), 1, np.uint8), np.zeros((last + size + 1, n), np.uint8)
    for x, (a, b) in enumerate(zip(queries, targets, strict=True)):
        e = int(half[x])
        top = last - e
        rows = np.arange(max(0, top - len(q) + 1), min(len(a), top + 1))
        q[top - rows, x] = np.frombuffer(a, np.uint8)[rows]
        rows = np.arange(max(0, e), min(len(b), e + len(t)))
        t[rows - e, x] = np.frombuffer(b, np.uint8)[rows]
    kind = np.int16 if scoring.match * steps < 1 << 15 else np.int32
    column = 2 * np.arange(size)[:, None]
    inside = [((column + p + 2 * half >= low) & (column + p + 2 * half <= high)).astype(kind) for p in (0, 1)]
    whole = [bool(x.all()) for x in inside]
    # Scores of three sums, and of the gaps in target and query that end in two; no gap is worth more than nothing at the edges.
    scores, downs, rights = ([np.zeros((size + 2, n), kind) for _ in range(k)] for k in (3, 2, 2))
    room, opened, most = np.empty((size, n), bool), np.empty((size, n), kind), np.zeros((size, n), kind)
    worth, mismatch, first, further, zero = map(kind, (scoring.match + scoring.mismatch, scoring.mismatch, scoring.first, scoring.further, 0))
    for s in range(steps):
        h, p = s >> 1, s & 1
        x, before, near = scores[s % 3][1:-1], scores[(s - 2) % 3][1:-1], scores[(s - 1) % 3]
        np.equal(q[last - h : last - h + size], t[h + p : h + p + size], out=room)
        np.multiply(room, worth, out=x)
        x += before
        x -= mismatch
        for gaps, at in ((downs, p + 1), (rights, p)):
            ends = gaps[s & 1][1:-1]
            np.subtract(near[at : at + size], first, out=opened)
            np.subtract(gaps[1 - (s & 1)][at : at + size], further, out=ends)
            np.maximum(ends, opened, out=ends)
            np.maximum(x, ends, out=x)
        np.maximum(x, zero, out=x)
        if not whole[p]:
            x *= inside[p]
        np.maximum(most, x, out=most)
    return most.max(axis=0).astype(np.int64)


#: Over so many tasks the pairs of one sequence are dealt out at the most.
_SPREAD = 16
#: Pairs of more letters on both sides together are long.
_LONG_PAIR = 2048

ALIGNED = "score bigint, matches bigint, columns bigint, query_begin bigint, query_end bigint, target_begin bigint, target_end bigint"


def align_pairs(pairs: DataFrame, keys: list[str], scoring: Scoring, guess: Callable[[bytes, bytes], tuple[int, ...] | None] | None = None, enough: Callable[[Alignments, np.ndarray, np.ndarray], np.ndarray] | None = None, least: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``keys`` of ``pairs`` (keys, query, target, low, high) with the columns of ALIGNED; pairs of like size are aligned together.

    ``guess`` may name a narrower band for a pair: where the alignment over it is ``enough`` (alignments, lengths of queries, of targets), it is taken, else the whole band is aligned.  A guess with low
    over high says that no alignment can be enough: such a pair has no row.  It may go on with low and high of the only diagonals on which one can be.
    Where gaps cost more to open, scores are found first (``best_scores``), and a guess is enough if it gives the same score.
    ``least`` names the lowest scores that matter, by the lengths of queries and targets: a pair under it may have a row of zeros, or none.
    """

    def scored(query: list[bytes], target: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The score of each pair, -1 where it does not matter."""
        out, lengths, widths = np.full(len(query), -1, np.int64), np.array([len(q) for q in query], np.int64), high - low + 1
        order, i = np.lexsort((widths, lengths)), 0
        while i < len(order):
            j = i + 1
            while j < len(order) and lengths[order[j]] <= 1.3 * lengths[order[i]] + 8 and (j - i + 1) * widths[order[i : j + 1]].max() <= CELLS:
                j += 1
            own = order[i:j]
            pairs = [query[k] for k in own], [target[k] for k in own]
            found = best_scores(*pairs, low[own], high[own], scoring)
            out[own] = np.where(found >= least(*(np.array([len(x) for x in side]) for side in pairs)), found, -1)
            i = j
        return out

    def batched(query: list[bytes], target: list[bytes], low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, Alignments]]:
        order = np.lexsort((high - low, [len(s) for s in query])) if len(query) else np.zeros(0, np.int64)
        widths, both = high - low + 1, np.array([len(q) + len(t) for q, t in zip(query, target, strict=True)], np.int64)
        even = scoring.first == scoring.further
        i = 0
        while i < len(order):
            j, width, most = i + 1, int(widths[order[i]]), int(both[order[i]])
            kept = even and kept_bytes(most, width) <= KEPT_ONE
            while j < len(order) and len(query[order[j]]) <= 1.3 * len(query[order[i]]) + 8:
                width, most = max(width, int(widths[order[j]])), max(most, int(both[order[j]]))
                if (j - i + 1) * width > CELLS or (kept and (j - i + 1) * kept_bytes(most, width) > KEPT):
                    break
                j += 1
            own = order[i:j]
            pairs = [query[k] for k in own], [target[k] for k in own], low[own], high[own], scoring
            yield own, align_even(*pairs, least and least(*(np.array([len(x) for x in side]) for side in pairs[:2]))) if kept else align(*pairs)
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            query, target = ([s.encode() for s in b.column(c).to_pylist()] for c in ("query", "target"))
            low, high = (b.column(c).to_numpy().astype(np.int64) for c in ("low", "high"))
            rows = lambda own, found: pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(own)) for c in keys), *map(pa.array, found)], [*keys, *Alignments._fields])  # noqa: B023, E731
            left, scores_first = np.arange(len(query)), least and scoring.first != scoring.further
            if guess:
                bands = [guess(q, t) for q, t in zip(query, target, strict=True)]
                if scores_first:
                    # All scores come first: few pairs matter, and a narrower band that gives the same score is enough.
                    left = np.array([i for i, x in enumerate(bands) if x is None or x[0] <= x[1]], np.int64)
                    whole = np.full(len(query), -1, np.int64)
                    whole[left] = scored([query[i] for i in left], [target[i] for i in left], low[left], high[left])
                    cut = [x and (max(int(low[i]), x[0]), min(int(high[i]), x[1])) for i, x in enumerate(bands)]
                    bands = [(1, 0) if whole[i] < 0 else x if x and x[0] <= x[1] else None for i, x in enumerate(cut)]
                # Where no alignment outside the narrower band can be enough, the only diagonals on which one can be are aligned at once.
                within = [x is not None and len(x) == 4 and x[0] <= x[2] <= x[3] <= x[1] for x in bands]
                first = np.array([i for i, x in enumerate(bands) if x and x[0] <= x[1] and not within[i]], np.int64)
                open_ = {i for i, x in enumerate(bands) if x is None or within[i]}
                for own, found in batched([query[i] for i in first], [target[i] for i in first], *(np.array([bands[i][k] for i in first], np.int64) for k in (0, 1))):
                    good = found.score == whole[first[own]] if scores_first else enough(found, np.array([len(query[i]) for i in first[own]]), np.array([len(target[i]) for i in first[own]]))
                    if good.any():
                        yield rows(first[own][good], (x[good] for x in found))
                    open_ |= set(first[own][~good].tolist())
                left = np.array(sorted(open_), np.int64)
                low, high = low.copy(), high.copy()
                for i in (i for i in open_ if bands[i] and len(bands[i]) == 4):
                    low[i] = min(max(low[i], bands[i][2]), high[i])
                    high[i] = max(min(high[i], bands[i][3]), low[i])
            elif scores_first:
                left = left[scored(query, target, low, high) >= 0]
            for own, found in batched([query[i] for i in left], [target[i] for i in left], low[left], high[left]):
                yield rows(left[own], found)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema.fields)
    # The work lies in the letters' products and not in bytes, so pairs are dealt out to a fixed number of tasks that is not coalesced.
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Those of one first key lie in few tasks, where ``guess`` may keep what it learnt of a sequence.  A step over letters costs long pairs the same for one as for many, so those of like size
    # lie together, in a sixth of the tasks.
    size, spread = F.length("query") + F.length("target"), F.hash(*keys)
    dealt = F.when(size <= _LONG_PAIR, F.hash(F.lit(0), F.col(keys[0]), F.pmod(spread, F.lit(_SPREAD)))).otherwise(F.hash(F.lit(1), F.floor(F.log(size) / F.log(F.lit(1.3))), F.pmod(spread, F.lit(max(1, tasks // 6)))))
    return pairs.select(*keys, "query", "target", "low", "high").repartition(tasks, dealt).mapInArrow(run, f"{kinds}, {ALIGNED}")
