"""Sequence and embedding features, and probability metrics over base distributions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import canonical


def canonical_kmers(spark: SparkSession, ks: tuple[int, ...], dim: int) -> DataFrame:
    """(k, gram, idx) of every k-mer by its number, with the index of its canonical form."""
    words = spark.range(1).select(F.explode(F.array(*map(F.lit, ks))).alias("k")).select("k", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(4), F.col("k")) - 1).cast("int"))).alias("i"))
    kmer = F.coalesce(*[F.when(F.col("k") == k, gram_letters(F.col("i"), k)) for k in ks])
    spelled = words.withColumn("kmer", canonical(kmer))
    h = F.sha2(F.concat_ws("|", "k", "kmer"), 256)
    # The low 12 bits of the first 8 bytes decide the index for any dimension that divides 4096.
    return spelled.select("k", F.col("i").cast("long").alias("gram"), (F.conv(F.substring(h, 14, 3), 16, 10).cast("int") % dim).alias("idx"))


#: Grams of a batch that goes on to Spark.
GRAM_ROWS = 1 << 18


def gram_counts(df: DataFrame, keep: list[str], *lengths: int) -> DataFrame:
    """(``keep``, k, gram, n): for each of ``lengths`` the ACGT grams of each row's ``sequence``; ``gram`` is the number in base 4 of its letters, n how often it occurs.

    Grams with any other letter count nowhere.  One Arrow pass: the numbers of all grams roll over the letters, so the time follows the sequence's length, and
    a task holds the grams of GRAM_ROWS and one sequence at most, as numbers and not as objects.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, rows = [], 0
            for i, s in enumerate(b.column("sequence")):
                for k in lengths if s.is_valid else ():
                    gram, n = _grams(s.as_py(), k)
                    held.append((np.full(len(gram), i), np.full(len(gram), k, np.int32), gram, n))
                    rows += len(gram)
                if held and (rows >= GRAM_ROWS or i + 1 == len(b)):
                    row, *columns = map(np.concatenate, zip(*held, strict=True))
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row)) for c in keep), *map(pa.array, columns)], [*keep, "k", "gram", "n"])
                    held, rows = [], 0

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema.fields)
    return df.select(*keep, F.col("sequence").cast("string").alias("sequence")).mapInArrow(run, f"{kept}k int, gram bigint, n bigint")


def letter_places(sequence: Column | str, letter: str) -> Column:
    """The places of a letter in a sequence, from 0."""

    @F.arrow_udf("array<bigint>")
    def places(parts: pa.Array) -> pa.Array:
        found = [None if s is None else np.flatnonzero(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") == ord(letter)) for s in parts.to_pylist()]
        return pa.array(found, pa.list_(pa.int64()))

    return places(sequence)


_CODES = np.full(256, 4, np.uint8)
_CODES[[ord(c) for c in "ACGT"]] = range(4)


def _grams(sequence: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    codes = _CODES[np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)]
    if len(codes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    numbers, bad = np.zeros(len(codes) - k + 1, np.int64), np.concatenate([[0], np.cumsum(codes > 3)])
    for i in range(k):
        numbers = numbers * 4 + codes[i : i + len(numbers)]
    return np.unique(numbers[bad[k:] == bad[:-k]], return_counts=True)


def gram_letters(gram: Column, k: int) -> Column:
    """The letters of a gram's number."""
    return F.concat(*[F.substr(F.lit("ACGT"), (F.floor(gram / 4**j) % 4 + 1).cast("int"), F.lit(1)) for j in range(k - 1, -1, -1)])


def kmer_hash(df: DataFrame, ks: tuple[int, ...] = (3, 4, 5, 6), dim: int = 2048) -> DataFrame:
    """(sample_id, idx, share): counts of canonical ACGT k-mers hashed to ``dim``, divided by the total over all k.

    The k-mers of a row are counted where the row is read; the shuffle carries at most ``dim`` counts of a row.
    """
    rows = gram_counts(df, ["sample_id"], *ks)
    known = F.broadcast(canonical_kmers(df.sparkSession, ks, dim))  # 4 ** k rows for each k
    counts = rows.join(known, ["k", "gram"]).groupBy("sample_id", "idx").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("sample_id").agg(F.sum("n").alias("total"))
    return counts.join(totals, "sample_id").select("sample_id", "idx", (F.col("n") / F.col("total")).alias("share"))


# The seed of the projection, its width, and the factor that spreads dimensions over buckets at that width (1 at any other).
PROJECTION_SEED, PROJECTION_DIM, PROJECTION_FACTOR = 20260801, 256, 205


def project_hash(df: DataFrame, dim: int = PROJECTION_DIM, seed: int = PROJECTION_SEED) -> DataFrame:
    """(vec_id, bucket, value): signed hash projection of ``embedding``, whatever its width; sums inside the row, no shuffle.

    Dimension i falls into the bucket of i modulo ``dim`` with the sign of a hash, and a bucket is divided by the root of its dimensions' number.  Buckets that no
    dimension falls into have no row; null and empty vectors have none.  Vectors may differ in width.  The signs are a list as long as the widest vector.
    """
    width = df.agg(F.max(F.size("embedding"))).first()[0] or 0
    signs = F.lit([1.0 if hashlib.sha256(f"{seed}|{i}".encode()).digest()[0] & 1 else -1.0 for i in range(width)] or [0.0])
    factor = PROJECTION_FACTOR if dim == PROJECTION_DIM else 1
    size = F.size("embedding")

    def value(r: Column) -> Column:
        at = F.sequence(r, size - 1, F.lit(dim))
        total = F.aggregate(at, F.lit(0.0), lambda t, i: t + F.get("embedding", i).cast("double") * F.get(signs, i))
        return F.struct((r.cast("long") * factor + seed % dim) % dim, total / F.sqrt(F.size(at).cast("double")))

    buckets = F.transform(F.sequence(F.lit(0), F.least(size, F.lit(dim)) - 1), value)
    x = df.where(size > 0).select("vec_id", F.explode(buckets).alias("x"))
    return x.select("vec_id", F.col("x.col1").alias("bucket"), F.col("x.col2").alias("value"))


def base_probabilities(df: DataFrame) -> DataFrame:
    """(vec_id, pos, p): each four embedding values squared and normalised; what is left of fewer than four is no position."""
    quads = F.floor(F.size("embedding") / 4).cast("int")
    quad = F.transform(F.sequence(F.lit(0), quads - 1), lambda i: F.transform(F.slice("embedding", i * 4 + 1, 4), lambda x: x.cast("double") * x.cast("double")))
    x = df.where(quads > 0).select("vec_id", F.posexplode(quad).alias("pos", "q"))
    total = F.aggregate("q", F.lit(0.0), lambda a, v: a + v)
    return x.withColumn("_t", total).where("_t > 0").select("vec_id", "pos", F.transform("q", lambda v: v / F.col("_t")).alias("p"))


def motif_recovery(prob: DataFrame, by: list[str]) -> DataFrame:
    """Base accuracy over true ACGT positions, and the share of motifs with every base right; rows need (motif, truth 0-3, p)."""
    hit = F.array_position("p", F.array_max("p")) - 1 == F.col("truth")
    m = prob.groupBy(*by, "motif").agg(F.count_if(hit).alias("h"), F.count("*").alias("n"))
    return m.groupBy(*by).agg((F.sum("h") / F.sum("n")).alias("base_accuracy"), F.avg((F.col("h") == F.col("n")).cast("double")).alias("motif_accuracy"))


def snv_effect(prob: DataFrame, ref: str, alt: str, floor: float = 1e-12) -> DataFrame:
    at = lambda c: F.greatest(F.lit(floor), F.get("p", F.col(c)))
    return prob.withColumn("effect", F.coalesce(F.log(at(ref)) - F.log(at(alt)), F.lit(0.0)))


def strand_average(forward: str, reverse: str):
    return F.zip_with(forward, F.reverse(reverse), lambda a, b: (a.cast("double") + b) / 2)


def chunks(df: DataFrame, size: int, overlap: int) -> DataFrame:
    """(contig, chunk_no, start, seq): overlapping chunks of long sequences; an empty or null sequence has none."""
    some = df.where(F.length("sequence") > 0)
    # The lengths are those of the whole sequence, so they are found once and not for each chunk.
    x = some.select("contig", F.col("sequence").cast("binary").alias("raw"), "sequence", (F.octet_length("sequence") == F.length("sequence")).alias("narrow"), F.explode(F.sequence(F.lit(0), F.floor((F.length("sequence") - 1) / size))).alias("chunk_no"))
    at = (F.col("chunk_no") * size + 1).cast("int")
    seq = F.when(F.col("narrow"), F.substring("raw", at, F.lit(size + overlap)).cast("string")).otherwise(F.substr("sequence", at, F.lit(size + overlap)))
    return x.select("contig", "chunk_no", (F.col("chunk_no") * size).alias("start"), seq.alias("seq"))


def fetch_windows(positions: DataFrame, chunked: DataFrame, window: int, size: int) -> DataFrame:
    """Windows of ``window`` letters around 0-based positions, by an equi-join on (contig, chunk); null over the ends.

    ``chunked`` must overlap by at least ``window`` letters, so that each window lies in the chunk of its start.
    """
    p = positions.withColumn("_s", F.col("pos") - window // 2).withColumn("chunk_no", F.floor(F.greatest(F.col("_s"), F.lit(0)) / size))
    x = p.join(chunked, ["contig", "chunk_no"], "left")
    w = F.substr("seq", (F.col("_s") - F.col("start") + 1).cast("int"), F.lit(window))
    return x.select("contig", "pos", F.when((F.col("_s") >= 0) & (F.length(w) == window), w).alias("window"))


def negative_sites(features: DataFrame, lengths: DataFrame, context: int) -> DataFrame:
    """For each boundary a site that is none: right by ``context``, or left past the contig's end, then right in steps until one is free.

    The boundaries are the starts; where ``features`` has an ``end``, both ends of an element are, and the first shift is
    half the element if that is more (one row per ``side`` then).  Runs of boundaries a step apart are passed at once.
    """
    at, by, shift = F.col("_at"), ["contig", "start"], F.lit(context)
    if "end" in features.columns:
        by, shift = [*by, "end", "side"], F.greatest(shift, F.floor((F.col("end") - F.col("start") + 1) / 2))
        sides = F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).alias("_at")) for n, c in (("left", "start"), ("right", "end"))])
        f = features.select("contig", "start", "end", F.inline(sides)).distinct()
    else:
        f = features.select("contig", "start", F.col("start").alias("_at")).distinct()
    steps = F.row_number().over(Window.partitionBy("contig", F.pmod(at, F.lit(context))).orderBy("_at"))
    runs = f.select("contig", "_at").distinct().withColumn("_run", at - steps * context)
    runs = runs.select("contig", at.alias("_s"), (F.max("_at").over(Window.partitionBy("contig", "_run")) + context).alias("_free"))
    f = f.join(lengths, "contig").withColumn("_s", F.when(at + shift < F.col("length"), at + shift).otherwise(at - shift))
    return f.join(runs, ["contig", "_s"], "left").select(*by, F.coalesce("_free", "_s").alias("site"))


def strand_divergence(pairs: DataFrame, by: list[str], floor: float = 1e-12) -> DataFrame:
    """Symmetric Kullback-Leibler divergence of ``p`` and ``q``, halved, averaged over positions."""
    log = lambda x: F.log(F.greatest(x, F.lit(floor)))
    term = F.aggregate(F.zip_with("p", "q", lambda a, b: (a - b) * (log(a) - log(b))), F.lit(0.0), lambda t, x: t + x) / 2
    return pairs.groupBy(*by).agg(F.avg(term).alias("divergence"))


def boundary_pairs(df: DataFrame, length: int, flank: int = 5) -> DataFrame:
    """Rows (id, left, right, bases) as ``2 * flank`` rows (id, ref_pos, mut_pos, base code 0 to 3, or 4).

    ``left`` and ``right`` are the 1-based ends of the variant; ``bases`` are the mutant's letters around its centre.
    """
    x = df.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(2 * flank - 1))))
    ref = F.when(F.col("o") < flank, F.col("left") - 1 - flank + F.col("o")).otherwise(F.col("right") + F.col("o") - flank)
    code = F.instr(F.lit("ACGT"), F.upper(F.substr("bases", F.col("o") + 1, F.lit(1))))
    return x.select("id", ref.cast("long").alias("ref_pos"), (F.lit(length // 2 - flank) + F.col("o")).cast("long").alias("mut_pos"), F.when(code > 0, code - 1).otherwise(4).alias("base"))


def boundary_score(pairs: DataFrame, ref: DataFrame, mut: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Minus the mean log ratio of mutant to reference at the pairs; letters that are no base count zero.

    ``outside`` counts pairs whose position neither table has.  Those take no part in the mean.
    """
    r, m = (t.select(F.col("vec_id").alias("id"), F.col("pos").cast("long").alias(f"{n}_pos"), F.col("p").alias(f"_{n}")) for t, n in ((ref, "ref"), (mut, "mut")))
    at = lambda n: F.greatest(F.lit(floor), F.get(f"_{n}", F.col("base").cast("int")))
    j = pairs.join(r, ["id", "ref_pos"], "left").join(m, ["id", "mut_pos"], "left")
    known = F.col("_ref").isNotNull() & F.col("_mut").isNotNull()
    value = F.when(F.col("base") == 4, 0.0).when(known, F.log(at("mut") / at("ref")))
    return j.groupBy("id").agg((-F.avg(value)).alias("score"), F.count_if((F.col("base") < 4) & ~known).alias("outside"))
