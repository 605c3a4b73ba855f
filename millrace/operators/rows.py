"""From samples to model rows: windows, padding, masking, pooling, slices of batches and bootstrap draws."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import hash_uniform, reverse_complement

#: Token ids of a mask and of padding, and the target that is left out of a loss.
MASK, PAD, IGNORE = 5, 6, -100
#: Rows that are masked together.
MASK_ROWS = 256


def snv_windows(df: DataFrame, size: int) -> DataFrame:
    """Rows (sequence, pos1, ref, alt) with the window around the site and its mutant.

    ``status`` is ``ok``, ``edge`` (the window would leave the sequence), ``not_snv`` or ``mismatch`` (the sequence
    holds another base there); both windows are null unless it is ``ok``.
    """
    half = size // 2
    start = F.col("pos1") - 1 - half
    ref, alt = F.upper("ref"), F.upper("alt")
    status = (
        F.when((start < 0) | (start + size > F.length("sequence")), "edge").when(~F.coalesce(ref.rlike("^[ACGT]$") & alt.rlike("^[ACGT]$"), F.lit(False)), "not_snv")
        .when(F.substr("sequence", F.col("pos1").cast("int"), F.lit(1)) != ref, "mismatch").otherwise("ok")
    )
    win = F.substr("sequence", (start + 1).cast("int"), F.lit(size))
    df = df.withColumn("status", status).withColumn("ref_window", F.when(F.col("status") == "ok", win))
    return df.withColumn("alt_window", F.overlay("ref_window", alt, F.lit(half + 1), F.lit(1)))


def pad_and_mask(df: DataFrame, batch: str, codes: str = "codes") -> DataFrame:
    """Codes right-padded to the longest of their batch, and a mask of what is real.  A batch is small by definition."""
    most = F.max(F.size(codes)).over(Window.partitionBy(batch))
    real = F.size(codes)
    return df.withColumn("_n", most).withColumns({
        "valid": F.concat(F.array_repeat(F.lit(True), real), F.array_repeat(F.lit(False), F.col("_n") - real)),
        codes: F.concat(codes, F.array_repeat(F.lit(PAD), F.col("_n") - real)),
    }).drop("_n")


def mask_tokens(df: DataFrame, seed: int, share: float = 0.15) -> DataFrame:
    """Inputs and targets of masked training, one Arrow pass over the code arrays, no shuffle; a base is hashed once for its three draws.

    A base is chosen when its draw is below ``share``; in a sequence where none is, the base with the least draw is.
    Of the chosen, 80% become the mask, 10% a random code 0 to 4 and the rest stay.  Draws hash (seed, sample, position),
    so a retried task repeats them.
    """
    names = df.columns

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), MASK_ROWS):
                part = b.slice(i, MASK_ROWS)
                codes = part.column("_codes")
                pairs = [_masked(f"{seed}|{s}|" if s is not None else f"{seed}|", c, share) for s, c in zip(part.column("_id").to_pylist(), codes, strict=True)]
                columns = [pa.array([x and x[k] for x in pairs], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *columns], [*names, "inputs", "targets"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    x = df.select("*", F.col("sample_id").cast("string").alias("_id"), F.col("codes").cast("array<int>").alias("_codes"))
    return x.mapInArrow(masked, f"{fields}, inputs array<int>, targets array<int>")


def _masked(prefix: str, codes: pa.ListScalar, share: float) -> tuple | None:
    """Inputs and targets of one sequence; a code that is null stays null in both unless it is chosen, which it can't be."""
    if not codes.is_valid:
        return None
    own = codes.values
    null = own.is_null().to_numpy(zero_copy_only=False)
    code = own.fill_null(IGNORE).to_numpy(zero_copy_only=False).astype(np.int32)
    at = np.flatnonzero(~null & (code < 4))
    start = hashlib.sha256(prefix.encode())
    digests = bytearray()
    for i in at.tolist():
        h = start.copy()
        h.update(b"%d" % i)
        digests += h.digest()[:12]
    u, v, w = (np.frombuffer(bytes(digests), ">u4").reshape(-1, 3) / 4294967296.0).T
    chosen = u < share
    if len(u) and not chosen.any():
        chosen = u == u.min()
    at, v, w = at[chosen], v[chosen], w[chosen]
    targets = np.full(len(code), IGNORE, np.int32)
    targets[at] = code[at]
    inputs = code.copy()
    inputs[at] = np.where(v < 0.8, MASK, np.where(v < 0.9, np.floor(w * 5).astype(np.int32), code[at]))
    return ([None if n else c for c, n in zip(inputs.tolist(), null)] if null.any() else inputs), targets


def strand_augment(df: DataFrame, seed: int, p: float = 0.5) -> DataFrame:
    """The reverse complement instead, with probability ``p`` by the sample's hash."""
    turn = hash_uniform(F.concat_ws("|", F.lit(str(seed)), "sample_id")) < p
    return df.withColumn("sequence", F.when(turn, reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")))


def mean_pool(tokens: DataFrame, by: list[str], vector: str, valid: str) -> DataFrame:
    """Mean of the valid token vectors of each group, by dimension; groups without one are zero.  Partial sums go first."""
    x = tokens.select(*by, valid, F.posexplode(vector).alias("dim", "v"))
    s, n = F.sum(F.when(F.col(valid), F.col("v").cast("double")).otherwise(0.0)), F.count_if(valid)
    return x.groupBy(*by, "dim").agg((s / F.greatest(n, F.lit(1))).alias("mean"))


def class_ids(df: DataFrame, name: str, order: str) -> DataFrame:
    """(name, class_id) in order of first sight; the window runs over one row per name."""
    first = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias("_f"))
    return first.select(name, (F.row_number().over(Window.orderBy("_f", name)) - 1).alias("class_id"))


def rank_slices(df: DataFrame, batch: str, order: str, ranks: int) -> DataFrame:
    """Rank 0 to ``ranks`` - 1 of each row: contiguous, nearly equal parts of its batch, larger ones first."""
    return df.withColumn("rank", F.ntile(ranks).over(Window.partitionBy(batch).orderBy(order)) - 1)


def next_cursor(position: str, epoch: str, size: str) -> dict:
    """Columns to resume from: the next position, or the start of the next epoch."""
    last = F.col(position) + 1 >= F.col(size)
    return {"next_position": F.when(last, 0).otherwise(F.col(position) + 1), "next_epoch": F.col(epoch) + last.cast("int")}


def preview(df: DataFrame, by: list[str], order: str, n: int = 5) -> DataFrame:
    """The first ``n`` values of each group; Spark's limited rank keeps at most ``n`` rows of a group before the shuffle."""
    k = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_k") <= n)
    return k.groupBy(*by).agg(F.array_sort(F.collect_list(order)).alias("first"))


def bootstrap_draws(df: DataFrame, stratum: str, order: str, replicates: int, seed: int) -> DataFrame:
    """(stratum, replicate, row, times): draws with replacement that keep each stratum's size.

    Draw k of a replicate takes row hash(seed, replicate, stratum, k) mod size of its stratum.  Draws are counted before
    they meet the rows.  Rows are numbered inside their stratum, so strata are evaluation sets, not corpora;
    ``stats.bootstrap_counts`` serves those.
    """
    w = Window.partitionBy(stratum)
    ranked = df.select(stratum, order, (F.row_number().over(w.orderBy(order)) - 1).cast("long").alias("k"), F.count("*").over(w).alias("n"))
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), "replicate", F.col(stratum).cast("string"), "k"), 256), 1, 12), 16, 10).cast("long") % F.col("n")
    draws = ranked.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).groupBy(stratum, "replicate", u.alias("k")).agg(F.count("*").alias("times"))
    return draws.join(ranked.drop("n"), [stratum, "k"]).drop("k")
