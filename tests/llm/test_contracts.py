"""What holds for all operators: ids of any size, null ids, clashing columns, empty tables, repeated and very long rows; and the pipeline by brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, embedding_dedup, near, packing, quality, sharding, simhash, toxicity, url_filter, warc

IDS = [(1 << 60) + 1, -1, None, 10**13, (1 << 63) - 1]
CLASH = ("_h", "_lines", "_word_chars", "_kept", "kept", "clean_text", "n_words", "score", "predicted", "doc", "row", "row_key", "shard", "fp", "node", "label", "part", "again", "digest", "n", "w", "ids", "key")


def docs(spark, rows):
    """(doc_id, text) with columns of any clashing name, each of which holds its own mark."""
    base = spark.createDataFrame(rows, "doc_id bigint, text string")
    return base.withColumns({c: F.concat(F.lit(c), F.lit(" of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASH})


def prose(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"word{i}" for i in rng.integers(0, 10**6, n)) + "."


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def digests(spark, d):
    """Each document operator's result over ``d``."""
    return {
        "op2": toxicity.toxicity_digest(d, labels(spark)), "op3": quality.quality_digest(d), "op4": simhash.simhash_digest(d), "op5": packing.pack_documents(d),
        "op6": bpe.bpe_digest(d), "op7": sharding.shard_digest(d), "near": near.near_components(d),
    }


def test_ids_of_any_size(spark):
    d = docs(spark, [(i, prose(k)) for k, i in enumerate(IDS)])
    for name, out in digests(spark, d).items():
        assert {r["doc_id"] for r in out.collect()} == set(IDS), name
    pages = spark.createDataFrame([(i, f"http://com/en/{k}", prose(k, 300)) for k, i in enumerate(IDS)], "page_id bigint, url string, html string")
    assert {r["page_id"] for r in url_filter.filter_urls(pages).collect()} == set(IDS)
    again = pages.unionByName(pages.withColumn("page_id", F.lit((1 << 60) + 7)))
    out = warc.warc_round_trip(again).collect()
    assert {r["page_id"] for r in out} == {*IDS, (1 << 60) + 7}
    assert {r["refers_to"] for r in out if r["page_id"] == (1 << 60) + 1} == {(1 << 60) + 7}
    said = spark.createDataFrame([(i, i, "user", "hello") for i in IDS], "conv_id bigint, turn bigint, role string, text string")
    assert {r["conv_id"] for r in chat.chat_digest(said).collect()} == set(IDS)
    vectors = spark.createDataFrame([(i, [1.0, float(k), 2.0], 1) for k, i in enumerate(IDS)], "vec_id bigint, embedding array<float>, label int")
    assert {r["vec_id"] for r in embedding_dedup.embedding_components(vectors).collect()} == set(IDS)


def test_empty_tables(spark):
    none = docs(spark, [(1, "x")]).where("false")
    for name, out in digests(spark, none).items():
        assert out.count() == 0, name
    for out in (toxicity.drop_toxic(none, labels(spark)), quality.clean_documents(none), simhash.one_of_each(none)):
        assert out.columns == none.columns and out.count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert url_filter.filter_urls(pages).count() == 0 == warc.warc_round_trip(pages).count()
    assert chat.chat_digest(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
    assert embedding_dedup.embedding_components(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_stages_leave_columns_alone(spark):
    clean = [(k, prose(k)) for k in range(3)]
    rows = [*clean, (3, clean[0][1]), (1, clean[1][1]), (7, "you idiot idiots morons scum " + prose(9, 20)), (8, None), (9, ""), (None, prose(30)), (None, clean[2][1])]
    d = docs(spark, rows)
    before = {(r["doc_id"], r["text"]): r for r in d.collect()}
    stages = {"toxic": toxicity.drop_toxic(d, labels(spark)), "clean": quality.clean_documents(d), "near": simhash.one_of_each(d)}
    for name, out in stages.items():
        assert out.columns == d.columns, name
        assert all(r == before[r["doc_id"], r["text"]] for r in out.collect()), name
    key = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert key(stages["toxic"]) == sorted((r for r in rows if r[0] != 7), key=str)
    assert key(stages["clean"]) == sorted((r for r in rows if r[1]), key=str)
    assert key(stages["near"]) == sorted([*clean, (7, rows[5][1]), (8, None), (None, prose(30))], key=str)


def test_repeated_rows(spark):
    d = docs(spark, [(1, prose(1)), (1, prose(1)), (2, ""), (2, ""), (None, None), (None, None)])
    for name, out in digests(spark, d).items():
        assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "1", "2", "2", "None", "None"], name
    assert sorted(str(r["doc_id"]) for r in simhash.one_of_each(d).collect()) == ["1", "2"]
    pages = spark.createDataFrame([(1, None, "h" * 2000), (1, None, "h" * 2000), (None, "http://x/", "h" * 2000), (None, None, None)], "page_id bigint, url string, html string")
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(pages).collect()) == [("1", "response", None), ("1", "response", None), ("None", "response", None), ("None", "revisit", 1)]
    assert url_filter.filter_urls(pages).count() == 4
    turns = spark.createDataFrame([(1, 0, "user", "x")] * 3 + [(None, None, None, None)] * 2, "conv_id bigint, turn bigint, role string, text string")
    assert {(r["conv_id"], r["n_turns"]) for r in chat.chat_digest(turns).collect()} == {(1, 3), (None, 2)}


def naive_density(lexicon, folded):
    hits = [(i, i + len(t), w) for t, w in lexicon.terms.items() for i in range(len(folded)) if folded.startswith(t, i)]
    spared = [(i, i + len(p)) for p in map(toxicity.fold, lexicon.exceptions) for i in range(len(folded)) if folded.startswith(p, i)]
    total = sum(w for i, j, w in hits if not any(x <= i and j <= y for x, y in spared))
    return np.log1p(8 * total / np.sqrt(max(1, folded.count(" ") - 1)))


def test_lexicon_against_naive_matcher():
    rng = np.random.default_rng(11)
    lexicon = toxicity.Lexicon()
    lexicon.terms |= {" trash": 2.0, " clow": 1.5, " clown ": 3.0, " scum": 0.5}
    a = lexicon.matcher()
    words = ["idiot", "proof", "trash", "can", "clown", "fish", "scum", "line", "pond", "stupid", "simple", "w0rd", "trаsh", "$cum", "bin", "sore", "loser", "rule"]
    for _ in range(400):
        folded = toxicity.fold(" ".join(rng.choice(words, rng.integers(0, 25))))
        assert lexicon.density(a, folded) == pytest.approx(naive_density(lexicon, folded), abs=1e-9), folded


def test_exceptions_in_a_long_text():
    import time

    lexicon = toxicity.Lexicon()
    a = lexicon.matcher()
    text = toxicity.fold("idiot proof " * 100_000)
    begin = time.time()
    assert lexicon.density(a, text) == 0 and time.time() - begin < 5


def test_shards_are_contiguous_and_whole(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), None if i % 50 == 0 else "é" * int(rng.integers(0, 300))) for i in rng.permutation(800)] + [(5, "same")] * 90
    out = sharding.shard_digest(docs(spark, rows)).collect()
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    ordered = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in ordered] == sorted(i for i, _ in rows)
    total, at = sum(s for _, s, _ in want), 0
    for r in ordered:
        assert r["shard"] == min(15, (2 * at + r["size"]) * 16 // (2 * total))
        at += r["size"]


def test_chat_assembly_and_lengths(spark):
    turns = [("system", "be kind"), ("user", "hi <|im_end|> \\ <|\\im_start|>"), ("assistant", "yes <|endoftext|>"), ("assistant", ""), ("user", "\n")]
    ids, mask = chat.assemble(turns)
    assert [(r, t) for r, t, _ in chat.read_back(ids, mask)] == turns
    assert [u for _, _, u in chat.read_back(ids, mask)] == ["", "", turns[2][1], "", ""]
    own = chat._encoding("byte_bpe_50k.tiktoken")[1]
    assert [int((ids == own[r]).sum()) for r in chat.RESERVED] == [5, 5, 5]
    parts = [chat.assemble([t]) for t in turns]
    assert np.concatenate([p[0] for p in parts]).tolist() == ids.tolist() and np.concatenate([p[1] for p in parts]).tolist() == mask.tolist()
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)] + [(2, 0, "assistant", "long " * 200_000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("ids", F.lit("clash")).withColumn("loss", F.lit(1))
    out = {r["conv_id"]: r for r in chat.chat_digest(frame).collect()}
    escaped = lambda t: re.sub(r"<\|(\\*)(im_start|im_end|im_role|endoftext)\|>", r"<|\\\1\2|>", t)
    for c in (1, 2):
        mine = [(r, t) for i, _, r, t in rows if i == c]
        formatted = "".join(f"<|im_start|>{escaped(r)}<|im_role|>{escaped(t)}<|im_end|>" for r, t in mine)
        assert out[c]["formatted_chars"] == len(formatted) == len(chat.render(chat.assemble(mine)[0])) and chat.render(chat.assemble(mine)[0]) == formatted
        assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert out[c]["loss_sha256"] == hashlib.sha256("".join(t for r, t in mine if r == "assistant").encode()).hexdigest()


def test_chat_ids_equal_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ("plain", "<|endoftext|> and <|im_end|>", "é漢😀 \n\n  x's", " "):
        ids, _ = chat.assemble([("user", text)])
        role = t.encode("user", add_special_tokens=False).ids
        assert ids.tolist()[len(role) + 2 : -1] == t.encode(chat.escape(text), add_special_tokens=False).ids


def test_long_texts_of_any_script():
    import time

    rng = np.random.default_rng(1)
    for text in ("".join(map(chr, rng.integers(0x4E00, 0x9000, 300_000))), "".join(rng.choice(list("0123456789"), 300_000)), "नमस्ते दुनिया" * 20_000, "😀" * 100_000, " \n" * 150_000, "!?" * 150_000):
        begin = time.time()
        ids = bpe.encode(text)
        assert time.time() - begin < 5
        assert ids == bpe.encode_leaf(text)


def test_joins_at_every_kind_of_text():
    rng = np.random.default_rng(3)
    parts = [*"abcthe  .,'sé1\n漢字९9'r\t😀ि!", "<|endoftext|>", "<|endof", "text|>", " 's", "'ll", "\x1c"]
    for _ in range(1500):
        text = "".join(str(rng.choice(parts)) * int(rng.choice([1, 1, 1, 2, 30])) for _ in range(rng.integers(2, 150)))
        k = int(rng.integers(1, len(text)))
        assert bpe.join_tokens(bpe.encode_leaf(text[:k]), bpe.encode_leaf(text[k:])) == bpe.encode_leaf(text), (text[:k], text[k:])


def test_archives_of_long_and_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "CAPTURES_PER_RANGE", 5)
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(["\r", "\n", "\r\n", "WARC/1.1\r\n", "a", "é", "\r\n\r\n"], rng.integers(0, 900))) for _ in range(40)] + ["x" * 3_000_000, "\r\n", "\r\n\r\n", ""]
    rows = [(i, f"http://h{i % 3}.com/{i % 7}", t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("offset", F.lit("clash")).repartition(3)
    out = warc.warc_round_trip(frame).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in out} == {i: (len(t.encode()), hashlib.sha1(t.encode()).hexdigest()) for i, _, t in rows}
    order = [(r["url_key"].encode(), r["at"], r["page_id"]) for r in sorted(out, key=lambda r: (r["range_no"], r["range_pos"]))]
    assert order == sorted(order) and len({r["range_no"] for r in out}) > 1


def test_hot_bands_and_clusters_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(near, "BAND_CAP", 3)
    monkeypatch.setattr(near, "CLUSTER_CAP", 4000)
    rng = np.random.default_rng(2)
    texts = []
    for base in ([f"w{i}" for i in rng.integers(0, 5000, 90)] for _ in range(3)):
        for k in range(25):
            copy = list(base)
            for i in rng.integers(0, 90, k % 5):
                copy[i] = f"x{rng.integers(99999)}"
            texts.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(86)} for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    got = {r["doc_id"]: r["component_id"] for r in near.near_components(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_one_vec_id_on_several_vectors(spark):
    a, b = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, a), (1, b), (2, [1.0, 0.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.1, 0.0]), (4, [0.0, 0.0, 1.0, 0.0]), (4, [0.0, 0.0, 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("label", F.lit("x/y")).withColumn("node", F.lit(0)).withColumn("v", F.lit("clash"))
    out = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_components(frame).collect())
    assert out == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (4, 1, 4)]


def bad_line(line):
    words = len(re.findall(r"[^\x20\x09-\x0D]+", line))
    bars, noise = sum(c in "|>" for c in line), sum(c in "#*$%&|<>!" for c in line)
    return (bars >= 3 and 4 * bars >= words) or (noise >= 3 and 3 * noise > words) or (words <= 30 and re.search(quality.BOILERPLATE, line.lower()) is not None)


def cleaned(text):
    """The text that the quality stage leaves, or None."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(8)}
    if len(words) < 20 or 100 * len(repeated) > 30 * len(words):
        return None
    lines = (text or "").split("\n")
    lost = sum(len("".join(re.findall(r"[^\x20\x09-\x0D]+", x))) for x in lines if bad_line(x))
    return None if 2 * lost > sum(map(len, words)) else "\n".join(x for x in lines if not bad_line(x))


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet")
    lexicon = toxicity.learn(table, spark.read.parquet(f"{d}/labels.parquet"))
    score = lambda t: 1 / (1 + np.exp(-(lexicon.intercept + lexicon.slope * naive_density(lexicon, toxicity.fold(t)))))
    left = {r["doc_id"]: cleaned(r["text"]) for r in table.collect() if score(r["text"]) < 0.7}
    left = {i: t for i, t in left.items() if t is not None}
    sets = {}
    for i, t in left.items():
        words = "".join(c.lower() if c.isascii() else c for c in t).split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    up = {i: i for i in left}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(left)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    kept = [i for i in ids if root(i) == i]
    assert len(kept) < len(ids) < table.count()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, d).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert sorted(pieces) == kept
    for i in kept:
        want, at = [*lib.encode(left[i], add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(want))
            assert r["ids_crc32"] == zlib.crc32(np.array(want[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(want)


def test_vectors_without_an_id_link(spark):
    a, far = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    frame = spark.createDataFrame([(None, a), (7, a), (5, [1.0, 0.0, 0.0]), (None, far), (None, far)], "vec_id bigint, embedding array<double>").withColumn("label", F.lit(1))
    out = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_components(frame).collect()), key=str)
    assert out == sorted([(None, 2, 5, False), (7, 2, 5, False), (5, 2, 5, True), (None, 1, None, False), (None, 1, None, False)], key=str)


def test_hot_vector_and_hot_fingerprint(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(900)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("label", F.lit(1)).repartition(8)
    x = np.array([v for _, v in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near_ = unit @ unit.T >= 0.93
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_components(frame).collect()}
    assert got == {i: int(near_[i].sum()) - 1 for i in range(900)}
    texts = [(i, None if i % 3 == 0 else prose(i, 12)) for i in range(600)]
    out = simhash.simhash_digest(docs(spark, texts).repartition(8)).collect()
    assert len(out) == 600 and {r["component_id"] for r in out if r["doc_id"] % 3 == 0} == {0}
