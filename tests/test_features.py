"""Projection, k-mers, Markov counts, chunks and the genome reader against plain loops."""

import gzip
import hashlib
import math
import random
from collections import Counter

import pytest

from millrace.operators import corpus, features
from millrace.sources import genome


def projected(v, dim, seed):
    factor = 205 if dim == 256 else 1
    bucket = [(i % dim * factor + seed % dim) % dim for i in range(len(v))]
    m = Counter(bucket)
    out = dict.fromkeys(bucket, 0.0)
    for i, x in enumerate(v):
        out[bucket[i]] += x * (1 if hashlib.sha256(f"{seed}|{i}".encode()).digest()[0] & 1 else -1) / math.sqrt(m[bucket[i]])
    return out


@pytest.mark.parametrize("dim", [256, 64, 7])
def test_projection_of_any_width(spark, dim):
    rnd = random.Random(dim)
    vectors = [[rnd.gauss(0, 1) for _ in range(w)] for w in (1, 2, 63, 64, 65, 128, 256, 257, 300, 4096)]
    df = spark.createDataFrame([*enumerate(vectors), (100, []), (101, None)], "vec_id long, embedding array<double>")
    got = {}
    for r in features.project_hash(df, dim, 42).collect():
        got.setdefault(r["vec_id"], {})[r["bucket"]] = r["value"]
    assert set(got) == set(range(len(vectors)))
    for i, v in enumerate(vectors):
        assert got[i] == pytest.approx(projected(v, dim, 42)), len(v)
    assert features.project_hash(df.where("vec_id > 99")).isEmpty() and features.project_hash(df.where("false")).isEmpty()


def test_late_dimensions_are_not_lost(spark):
    df = spark.createDataFrame([(1, [0.0] * 64 + [5.0] * 64)], "vec_id long, embedding array<double>")
    assert sum(abs(r["value"]) for r in features.project_hash(df).collect()) == pytest.approx(5 * 64)


def sequences():
    rnd = random.Random(4)
    return [None, "", "A", "AC", "NNNNNNN", "ACGTNACGT", "acgt", "AÉCGTACGT", *("".join(rnd.choices("ACGTN", [9, 9, 9, 9, 1], k=k)) for k in (3, 6, 50, 5000))]


def test_kmers_and_markov_counts(spark):
    df = spark.createDataFrame(list(enumerate(sequences())), "sample_id long, sequence string")
    flip = str.maketrans("ACGT", "TGCA")
    want = {}
    for i, s in enumerate(sequences()):
        n = Counter()
        for k in (3, 4, 5, 6):
            for w in (s[j : j + k] for j in range(len(s or "") - k + 1)):
                if set(w) <= set("ACGT"):
                    h = hashlib.sha256(f"{k}|{min(w, w.translate(flip)[::-1])}".encode()).digest()
                    n[int.from_bytes(h[:8], "big") % 2048] += 1
        want |= {(i, x): c / sum(n.values()) for x, c in n.items()}
    got = {(r["sample_id"], r["idx"]): r["share"] for r in features.kmer_hash(df).collect()}
    assert got == pytest.approx(want)
    grams = Counter(s[j : j + 3] for s in sequences() if s for j in range(len(s) - 2) if set(s[j : j + 3]) <= set("ACGT"))
    rows = {r["context"] + r["base"]: (r["n"], r["p"]) for r in corpus.next_bases(df).collect()}
    assert {g: n for g, (n, _) in rows.items()} == grams
    for g, (n, p) in rows.items():
        assert p == pytest.approx((n + 1) / (4 + sum(c for x, c in grams.items() if x[:2] == g[:2])))


def cut(name, s, size, overlap):
    return {(name, c): (c * size, s[c * size : c * size + size + overlap]) for c in range(-(-len(s) // size))}


def test_chunks_of_empty_and_wide_sequences(spark):
    seqs = {"a": "", "b": "A", "c": "ACGTACG", "d": "ACGÉTACGT" * 5, "e": None}
    got = features.chunks(spark.createDataFrame(list(seqs.items()), "contig string, sequence string"), 4, 2).collect()
    assert {(r["contig"], r["chunk_no"]): (r["start"], r["seq"]) for r in got} == {k: v for n, s in seqs.items() for k, v in cut(n, s or "", 4, 2).items()}
    assert {r["vec_id"] for r in features.base_probabilities(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 0.0, 1.0, 3.0]), (3, None)], "vec_id long, embedding array<float>")).collect()} == {2}


def test_genome_in_byte_ranges(spark, tmp_path, monkeypatch):
    rnd = random.Random(7)
    contigs = {"chr1": "".join(rnd.choices("ACGTN", k=9000)), "chr2": "ACGT", "empty": "", "chr3": "".join(rnd.choices("ACGT", k=2500))}
    text = "stray\n" + "".join(f">{n} some words\n" + "".join(s[i : i + 61].lower() + " \n" for i in range(0, len(s), 61)) for n, s in contigs.items()) + ">late\tx\n" + "TTTT"
    (tmp_path / "a.fa").write_text(text)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">zipped\nACG\nTAC\n>long\n" + "G" * 150_000 + "\n")
    want = {k: v for n, s in {**contigs, "late": "TTTT", "zipped": "ACGTAC", "long": "G" * 150_000}.items() for k, v in cut(n, s, 1000, 100).items()}
    for most in ("500", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            got = genome.read_genome(spark, str(tmp_path), 1000, 100).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(got) == len(want) and {(r["contig"], r["chunk_no"]): (r["start"], r["seq"]) for r in got} == want
    (tmp_path / "c.fa").write_text(">chr2\nA\n")
    with pytest.raises(ValueError, match="chr2"):
        genome.read_genome(spark, str(tmp_path), 1000, 100)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "d.fa").write_text("ACGT\n")
    with pytest.raises(ValueError, match="no sequences"):
        genome.read_genome(spark, str(tmp_path / "none"), 1000, 100)


def test_grams_leave_a_task_in_bounded_batches(spark, monkeypatch):
    df = spark.createDataFrame([(i, "ACGTNACGT" * 3) for i in range(40)] + [(40, None), (41, "A")], "sample_id long, sequence string").coalesce(1)
    once = features.gram_counts(df, ["sample_id"], 2, 3)
    assert once.where("sample_id >= 40").isEmpty() and {(r["k"], r["gram"], r["n"]) for r in once.where("sample_id = 7").collect()} == {(2, 1, 6), (2, 6, 6), (2, 11, 6), (3, 6, 6), (3, 27, 6), (2, 12, 2), (3, 49, 2), (3, 44, 2)}
    monkeypatch.setattr(features, "GRAM_ROWS", 10)
    assert sorted(features.gram_counts(df, ["sample_id"], 2, 3).collect()) == sorted(once.collect())


def test_letter_places(spark):
    df = spark.createDataFrame([("ANNÉN",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(features.letter_places("s", "N")).collect()] == [[1, 2, 4], [], None]
