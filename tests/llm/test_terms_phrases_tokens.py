"""Token files, phrases and source divergence against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import divergence, phrases, token_files, words
from millrace.llm.store import shared_dir

CLASH = ("row", "part", "start", "ids", "block", "code", "lang_", "term", "n", "f", "id", "k", "phrase", "value", "rank", "item", "docs", "sources", "counts", "places", "w", "x", "a", "b", "l", "r", "score")


def frame(spark, rows):
    """(doc_id, text, lang, source) beside columns of clashing names."""
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns({c: F.lit(c) for c in CLASH})


def prose(rng, n, vocabulary=40):
    return " ".join(f"W{int(i)}" + rng.choice(["", "", "", ".", ",", "\n"]) for i in rng.zipf(1.5, n) % vocabulary)


# ---- words


def test_words_of_slices():
    texts = [None, "", "Ab cD", " x", "y ", "ÀÉ é.Z", "a,b;c", "\t", "one\x0btwo", "end"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}).slice(1)
    got, row, piece = words.split(batch.column("text"), phrases.CLASSES)
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    want = [(w, i, (i, j)) for i, t in enumerate(texts[1:]) for j, p in enumerate(re.split(r"[.,;:!?\x0A-\x0D]", low(t))) for w in re.findall(r"[^\x20\x09]+", p)]
    assert [w.decode() for w in got.to_pylist()] == [w for w, _, _ in want] and row.tolist() == [i for _, i, _ in want]
    pieces = [p for _, _, p in want]
    assert all((x == y) == (p == q) and x <= y for x, y, p, q in zip(piece, piece[1:], pieces, pieces[1:], strict=False))
    assert len(words.split(pa.array([], pa.string()), phrases.CLASSES)[0]) == 0 == len(words.split(pa.array([None, ""], pa.string()), phrases.CLASSES)[0])
    assert sum(len(s) for s in words.slices(pa.RecordBatch.from_pydict({"text": ["x" * words.SLICE_BYTES, "y", "z" * (words.SLICE_BYTES + 5), None, ""]}))) == 5


# ---- token files


@pytest.mark.parametrize("top", [1, 256, 1 << 16, 1 << 17, 1 << 32])
def test_segments_of_any_ids(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 3001, dtype=np.uint64).astype(np.uint32)
    ids[::7] &= 0xFF
    raw = token_files.encode_segment(ids)
    s = token_files.Segment(lambda at, n: raw[at : at + n])
    assert [s.token(i) for i in range(0, 3001, 5)] == ids[::5].tolist()
    for i, j in [(0, 3001), (0, 0), (3001, 3001), (511, 513), (1024, 1536), *np.sort(rng.integers(0, 3002, (40, 2))).tolist()]:
        assert s.slice(i, j).tolist() == ids[i:j].tolist()


def test_a_token_needs_few_bytes():
    ids = np.random.default_rng(5).integers(0, 50_000, 1 << 18).astype(np.uint32)
    raw, read = token_files.encode_segment(ids), []
    s = token_files.Segment(lambda at, n: read.append(n) or raw[at : at + n])
    for i in range(0, len(ids), 4099):
        read.clear()
        assert s.token(i) == ids[i]
        assert sum(read) <= 2 + 1 + 4 + token_files.RANK_BITS // 8


def test_documents_over_segments(monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 1000)
    rng = np.random.default_rng(3)
    docs = [(i if i % 5 else None, rng.integers(0, 70_000, n).astype(np.uint32)) for i, n in enumerate([0, 1, 999, 1, 2500, 0, 3, 1000, 7])]
    sink = io.BytesIO()
    w = token_files.TokenWriter(sink)
    for d in docs:
        w.add(*d)
    w.close()
    assert len(sink.getvalue()) == w.bytes
    f, whole = token_files.TokenFile(io.BytesIO(sink.getvalue()), w.bytes), np.concatenate([d for _, d in docs])
    assert f.tokens == len(whole) and [None if n else int(i) for i, n in zip(f.doc_ids, f.nulls, strict=True)] == [i for i, _ in docs]
    assert [f.token(i) for i in range(0, len(whole), 3)] == whole[::3].tolist()
    begin = np.concatenate([[0], f.ends[:-1]])
    assert all(f.slice(int(i), int(j)).tolist() == d.tolist() for i, j, (_, d) in zip(begin, f.ends, docs, strict=True))
    with pytest.raises(ValueError):
        token_files.TokenFile(io.BytesIO(sink.getvalue()[:-1]), w.bytes - 1)
    with pytest.raises(IndexError):
        f.token(len(whole))


def library_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_token_files_against_library(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", "  \n", "Hello, \"World\"!!", "(see above). 100%.", "<|endoftext|> x <|startoftext|>", "这是 中文。नमस्ते.", "long " * 60_000, *(prose(rng, int(n)) for n in rng.integers(1, 400, 60))]
    ids = [*rng.permutation(len(texts) - 8).tolist(), None, None, 3, 3, (1 << 62) + 1, -(1 << 62), 10**13, -1]
    rows = [(i, t, "en", "s") for i, t in zip(ids, texts, strict=True)]
    d = frame(spark, rows).repartition(5)
    got = token_files.token_digest(d).collect()
    assert len(got) == len(rows)
    want = Counter((i, len(x := library_ids(t)), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t, _, _ in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered)])[:-1].tolist()
    assert [r["doc_id"] for r in ordered] == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_files.token_digest(d.where("false")).count() == 0


def test_spans_of_the_corpus(spark):
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, 50), None, None) for i in range(120)]
    path = shared_dir(spark)
    token_files.write_tokens(frame(spark, rows).repartition(6), path)
    whole = [x for _, t, _, _ in rows for x in library_ids(t)]
    n = len(whole)
    asked = [(0, n), (0, 0), (n - 3, 10), (n, 5), (-4, 6), (None, 3), (5, None), *((int(a), int(b)) for a, b in rng.integers(0, n, (40, 2)))]
    got = {(r["start"], r["length"]): r["ids"] for r in token_files.read_spans(spark, path, spark.createDataFrame([*asked, asked[0]], "start bigint, length bigint")).collect()}
    assert len(got) == len(set(asked))
    for a, b in asked:
        assert got[a, b] == ([] if a is None or b is None else whole[max(0, a) : max(0, a + b)]), (a, b)
    none = shared_dir(spark)
    token_files.write_tokens(frame(spark, rows).where("false"), none)
    assert token_files.read_spans(spark, none, spark.createDataFrame([(0, 3)], "start bigint, length bigint")).first()["ids"] == []


# ---- phrases


def brute_phrases(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and counts[p[i:j]] == a}
        scored = []
        for p, a in cand.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "block", "top"), [(3, 200, 2000), (5, 1 << 20, 7)])
def test_phrases_against_brute_force(spark, least, block, top):
    rng = np.random.default_rng(least)
    rows = [(i, prose(rng, int(n)), ["en", "de", None, "en"][i % 4], "s") for i, n in enumerate(rng.integers(0, 300, 60))]
    rows += [(None, None, "en", None), (1, "", None, None), (2, "...", "fr", "s"), (3, "Same five words right here", "es", "s"), *[(9, "Same five words right here now", "es", "s")] * 6, (4, "tick " * 20_000, "en", "s"), (5, "Ünïcode ÀB ünïcode àb\tÀB " * 9, "de", "s")]
    got = phrases.collocations(frame(spark, rows).repartition(5), least=least, top=top, block_words=block).collect()
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == brute_phrases(rows, least, 5, top)


def test_phrases_of_nothing(spark):
    d = frame(spark, [(1, "a b", "en", "s"), (2, None, None, None)])
    assert phrases.collocations(d.where("false")).count() == 0 == phrases.collocations(d).count()
    words_only = frame(spark, [(i, f"stop {i} go", "en", "s") for i in range(120)])
    assert phrases.collocations(words_only).count() == 0


def test_scores_beyond_64_bits(spark):
    big = [(10**15, 3 * 10**16, 2 * 10**15, 10**15 + 7), (7, 10, 9, 8), (100, 10**9, 100, 100)]
    got = spark.createDataFrame(big, "a bigint, n bigint, l bigint, r bigint").select(phrases._score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()
    assert [int(r[0]) for r in got] == [1000 * a * n // (le * r) for a, n, le, r in big]


# ---- divergence


def brute_divergence(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = [s for x, s in groups if x == lang]
        n = {s: sum(counts[lang, s][t] for t in kept) for s in own}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 5) // (n[s] + 5 * len(kept)) for t in kept} for s in own}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in own) + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}
        for s in own:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most])]
    return sorted(out)


@pytest.mark.parametrize(("least", "spill", "matrix", "batch"), [(2, 10**6, 100, 10_000), (4, 60, 1, 7)])
def test_divergence_against_brute_force(spark, least, spill, matrix, batch):
    rng = np.random.default_rng(least)
    rows = [(i, prose(rng, int(n)).replace("W", rng.choice(["a", "B", "cé", "Ж"])), ["en", "de", None][i % 3], f"s{int(rng.zipf(1.6)) % 6}" if i % 11 else None) for i, n in enumerate(rng.integers(0, 120, 150))]
    rows += [(1, None, "fr", "x"), (2, "", "fr", "y"), (3, "12 34", "fr", None), (4, "alone", "it", "z"), *[(5, "word Word wörd", "en", "s1")] * 9, (6, "tick " * 20_000, "en", "s2"), (7, "x" * 100_000 + " x", "de", "s0")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = divergence.source_divergence(frame(spark, rows).repartition(5), least, 9, spill, matrix).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got) == brute_divergence(rows, least, 9)


def test_divergence_of_nothing(spark):
    d = frame(spark, [(1, "a b", "en", "s"), (2, None, "en", "t"), (3, "a", "de", "t")])
    assert divergence.source_divergence(d.where("false")).count() == 0
    assert sorted(map(tuple, divergence.source_divergence(d).collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_shares_are_exact():
    c, d = np.array([0, 1, 7, 10**12, 10**15 - 1, 3]), np.array([3, 3, 9, 10**12, 10**15, 10**15])
    assert divergence.share(c, d).tolist() == [1 + 10**9 * int(x) // int(y) for x, y in zip(c, d, strict=True)]
