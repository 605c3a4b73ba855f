"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are rotated by a fixed random rotation and split into blocks of few dimensions.  If two vectors lie within
the squared distance ``2 - 2 cos``, some block holds at most its proportional share of it.  So each block is
range-joined on a grid under that budget; the union of the candidates is then verified exactly, each pair in the
first block that finds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import Forest, components, deal, segments
from .store import materialize

BLOCK_DIMS = 8
HOMES_PER_TASK = 4096
#: Measured nanoseconds of one comparison inside a block, and of one copy of a vector made, sent and read again.
PAIR_NS, COPY_NS = 6.0, 9000.0
#: Share of the comparisons that each further dimension of the grid leaves.
GRID_KEEPS = 0.55
_SLACK = 1e-5


@cache
def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))[0]


@cache
def block_budgets(dim: int, squared: float) -> tuple[tuple[int, int, float], ...]:
    """(first dimension, end, budget) of each block, the budget in proportion to its dimensions."""
    return tuple((i, min(dim, i + BLOCK_DIMS), squared * (min(dim, i + BLOCK_DIMS) - i) / dim) for i in range(0, dim, BLOCK_DIMS))


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _cells(x: np.ndarray, radius: float, grid: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, cells, kind): the home cell of each row, and every cell of smaller number that its radius touches."""
    width, reach = 2 * radius, radius * (1 + 1e-6)
    g = x[:, :grid]
    home = np.floor(g / width).astype(np.int64)
    yield np.arange(len(x)), home, 0
    low, high = np.floor((g - reach) / width).astype(np.int64), np.floor((g + reach) / width).astype(np.int64)
    for step in product((-1, 0, 1), repeat=grid):
        if step < (0,) * grid:
            cell = home + np.array(step)
            ok = ((cell >= low) & (cell <= high)).all(axis=1)
            yield np.flatnonzero(ok), cell[ok], 2


def grid_width(rows: int) -> int:
    """Dimensions of each block's grid with the least estimated cost for ``rows`` vectors of a label.

    A further dimension leaves about half of the comparisons of a vector and makes about twice the copies of it.
    """
    return min(range(1, BLOCK_DIMS + 1), key=lambda g: rows * PAIR_NS * GRID_KEEPS**g / 2 + COPY_NS * (1 + (2**g - 1) / 2))


def vector_links(vectors: DataFrame, cosine: float, grid: int, dtype: str = "<f8") -> DataFrame:
    """From (label, node, n, v: binary of ``dtype``): rows (a, null, w) that add w links to a, and (a, b, null) that join up."""
    squared, item = 2 - 2 * cosine, np.dtype(dtype).itemsize

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, b in batch.groupby(batch["v"].map(len) // item):
                x = _unit(np.frombuffer(b"".join(b["v"]), dtype).reshape(-1, dim).astype(float)) @ rotation(dim)
                for k, (i, j, budget) in enumerate(block_budgets(dim, squared)):
                    for rows, cells, kind in _cells(x[:, i:j], budget**0.5, min(grid, j - i)):
                        if not len(rows):
                            continue
                        out = b.iloc[rows].copy()
                        out["bucket"] = [f"{label}/{dim}/{k}/" + ".".join(map(str, c)) for label, c in zip(out["label"], cells.tolist(), strict=True)]
                        out["kind"] = np.int32(kind)
                        yield out[["bucket", "kind", "node", "n", "v"]]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for key, seg in segments(batches, ["bucket", "salt"]):
            dim, k = (int(t) for t in key[0].rsplit("/", 3)[1:3])
            blocks = block_budgets(dim, squared)
            i, j, budget = blocks[k]
            raw = np.frombuffer(b"".join(seg["v"]), dtype).reshape(-1, dim).astype(float)
            x = _unit(raw) @ rotation(dim)
            node, n, kind = (seg[c].to_numpy() for c in ("node", "n", "kind"))
            if key != last:
                last, forest = key, Forest()
                H = {"raw": raw[:0], "x": x[:0], "node": node[:0], "n": n[:0]}
            own = kind == 0
            if own.any():
                H = {c: np.concatenate([H[c], v[own]]) for c, v in (("raw", raw), ("x", x), ("node", node), ("n", n))}
                forest.grow(int(own.sum()))
            size = len(H["node"])
            if not size:
                continue
            hb = H["x"][:, i:j]
            hh = (hb * hb).sum(axis=1)
            degree = np.zeros(size, np.int64)
            out_a, out_b, more_a, more_w = [], [], [], []
            for s in range(0, len(node), wide := max(1, (1 << 20) // size)):
                p = slice(s, s + wide)
                vb = x[p, i:j]
                d = (vb * vb).sum(axis=1)[:, None] + hh[None, :] - 2 * (vb @ hb.T)
                v, h = np.nonzero(d <= budget * (1 + _SLACK) + 1e-9)
                ok = (kind[p][v] == 2) | (H["node"][h] < node[p][v])
                v, h = v[ok], h[ok]
                for t in range(0, len(v), 1 << 14):
                    a, b = v[t : t + (1 << 14)], h[t : t + (1 << 14)]
                    ra, rb = raw[p][a], H["raw"][b]
                    cos = (ra * rb).sum(axis=1) / (np.sqrt((ra * ra).sum(axis=1)) * np.sqrt((rb * rb).sum(axis=1)))
                    ok = cos >= cosine
                    a, b = a[ok], b[ok]
                    gap = (x[p][a] - H["x"][b]) ** 2
                    found = np.stack([gap[:, q:r].sum(axis=1) <= g * (1 + 1e-9) + 1e-12 for q, r, g in blocks], axis=1)
                    ok = found[:, k] & ~found[:, :k].any(axis=1)  # an earlier block has the others
                    a, b = a[ok], b[ok]
                    np.add.at(degree, b, n[p][a])
                    if len(a):
                        own_a, at = np.unique(a, return_inverse=True)
                        more_a.append(node[p][own_a])
                        more_w.append(np.bincount(at, H["n"][b]).astype(np.int64))
                        first = np.full(len(own_a), len(a))
                        np.minimum.at(first, at, np.arange(len(a)))
                        lead = b[first[at]]
                        out_a += node[p][own_a].tolist()
                        out_b += H["node"][b[first]].tolist()
                        for y, z in zip(lead, b, strict=True):
                            if y != z and forest.union(y, z):
                                out_a.append(H["node"][y])
                                out_b.append(H["node"][z])
            hit = degree > 0
            a = np.concatenate([H["node"][hit], *more_a, np.array(out_a, np.int64)]).astype(np.int64)
            w = np.concatenate([degree[hit], *more_w]).astype(np.int64)
            if len(a):
                yield pd.DataFrame({"a": a, "b": pd.array([None] * len(w) + out_b, "Int64"), "w": pd.array([*w, *[None] * len(out_b)], "Int64")})

    placed = vectors.mapInPandas(place, "bucket string, kind int, node bigint, n bigint, v binary")
    return deal(placed, ["bucket"], "node", HOMES_PER_TASK).mapInPandas(compare, "a bigint, b bigint, w bigint")


def embedding_components(vectors: DataFrame, cosine: float = 0.93, grid: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label).

    Only rows of one label (not null) and one length are compared.  Null, zero and non-finite vectors and vectors with a null
    component have no link and are their own component.  Equal vectors of a label are one node, counted but never
    expanded; nodes have numbers of their own, so a vec_id may be on several rows and joins nothing.  A repeated row counts as another vector.
    Rows with a null vec_id link like any other; their component is null where no row of it has a vec_id, and they are never kept.  Other columns are not read.  An empty table gives an empty result.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & finite & F.exists(e, lambda c: c != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", F.when(good, e).alias("e"))
    dtype = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return v.map(lambda a: None if a is None else (np.asarray(a, dtype) + 0.0).tobytes())  # -0.0 is 0.0

    known = materialize(rows.select("vec_id", F.col("label").cast("string").alias("label"), packed("e").alias("v")))
    nodes = known.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    if grid is None:
        grid = grid_width(nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0)
    found = materialize(vector_links(nodes.repartition("node"), cosine, grid, dtype))
    degree = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("w"))
    joined = components(found.where("b IS NOT NULL").select("a", "b"))
    named = nodes.join(degree, "node", "left").join(joined, "node", "left")
    named = materialize(named.select("label", "v", "first", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    heads = named.groupBy("component").agg(F.min("first").alias("component_id"))
    out = known.join(named.join(heads, "component").select("label", "v", "n_links", "component_id"), ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
