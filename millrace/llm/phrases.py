"""Phrases and their collocation scores by set-oriented mining over sorted occurrence relations.

The relation of length k holds (place, phrase) of every occurrence of a frequent phrase of k words, sorted by place; places number the words of a block of whole
documents and leave a gap between pieces, so neighbours in a piece are neighbours in place.  Each step merge-joins a block's relation with
itself at adjacent places, counts the groups, and keeps only occurrences of frequent ones before the next length.  Relations and group counts are
tables in the shared folder; counts of a phrase from all blocks meet by its key, and what is frequent goes back to the blocks that have it, so no list
of phrases is ever sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize
from .words import byte_classes, slices, split

CLASSES = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
#: A block is closed when it holds this many words; documents are never cut.
BLOCK_WORDS = 1 << 21
LONGEST = 5
MIN_COUNT = 100
TOP = 2000
_RELATION = [("places", pa.binary()), ("codes", pa.binary())]
_FIRST = pa.schema([("block", pa.int64()), ("code", pa.int64()), ("lang", pa.string()), ("term", pa.binary()), ("n", pa.int64()), *_RELATION])
_NEXT = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("groups", pa.binary()), *_RELATION])
_FIRST_DDL = "block bigint, code bigint, lang string, term binary, n bigint, places binary, codes binary"
_NEXT_DDL = "block bigint, bucket int, groups binary, places binary, codes binary"
_FREQUENT = pa.schema([("block", pa.int64()), ("found", pa.binary()), ("id", pa.int64()), ("f", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_FREQUENT_DDL = "block bigint, found binary, id bigint, f bigint, a bigint, b bigint"
#: Codes of a block stay below 2**_CODE_BITS.
_CODE_BITS = 31


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns as planes of bytes, compressed; most bytes of a plane are alike."""
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _expand(packed: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    rows, out, at = len(raw) // sum(widths), [], 0
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + rows * w].reshape(w, rows).T).view(k).ravel())
        at += rows * w
    return out


def pack_relation(places: np.ndarray, codes: np.ndarray) -> dict[str, bytes]:
    """Places as a bitmap, and the codes; common phrases have small ones."""
    bitmap = np.zeros(int(places[-1]) + 1 if len(places) else 0, bool)
    bitmap[places] = True
    return {"places": _squeeze(np.packbits(bitmap, bitorder="little")), "codes": _squeeze(codes.astype("<u4"))}


def unpack_relation(places: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    (bitmap,), (code,) = _expand(places, "u1"), _expand(codes, "<u4")
    return np.flatnonzero(np.unpackbits(bitmap, bitorder="little")), code.astype(np.int64)


def pack_groups(a: np.ndarray, b: np.ndarray, n: np.ndarray, code: np.ndarray) -> bytes:
    """Groups in the order of ``a``, which is kept as steps."""
    return _squeeze(np.diff(a, prepend=0).astype("<i8"), b.astype("<i8"), n.astype("<u4"), code.astype("<u4"))


def unpack_groups(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    step, b, n, code = _expand(packed, "<i8", "<i8", "<u4", "<u4")
    return np.cumsum(step), b, n.astype(np.int64), code.astype(np.int64)


def bucket_of(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def _by_frequency(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of codes by falling count, and the occurrences under their new codes."""
    order = np.argsort(-times, kind="stable")
    new = np.empty(len(order), np.int64)
    new[order] = np.arange(len(order))
    return order, new[codes]


class Block:
    """Words of whole documents, with codes for each (language, word)."""

    def __init__(self, number: int) -> None:
        self.number, self.known, self.at = number, {}, 0
        self.places: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []

    def add(self, texts: pa.Array, langs: list[str]) -> None:
        words, row, piece = split(texts, CLASSES)
        if not len(words):
            return
        coded, names = words.dictionary_encode(), list(dict.fromkeys(langs))
        lang = np.array([names.index(x) for x in langs], np.int64)[row]
        pair = pa.array(coded.indices.to_numpy().astype(np.int64) * len(names) + lang).dictionary_encode()
        term, of = np.divmod(pair.dictionary.to_numpy(), len(names))
        terms = coded.dictionary.take(pa.array(term)).to_pylist()
        own = np.array([self.known.setdefault((names[x], t), len(self.known)) for x, t in zip(of.tolist(), terms, strict=True)], np.int64)
        self.codes.append(own[pair.indices.to_numpy()])
        gaps = np.zeros(len(piece), np.int64)
        np.cumsum(piece[1:] != piece[:-1], out=gaps[1:])
        self.places.append(self.at + np.arange(len(piece)) + gaps)
        self.at = int(self.places[-1][-1]) + 2

    def close(self) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(self.codes)
        n = np.bincount(codes, minlength=len(self.known))
        order, codes = _by_frequency(codes, n)
        langs = pa.array([x for x, _ in self.known], pa.string()).take(pa.array(order))
        terms = pa.array([t for _, t in self.known], pa.binary()).take(pa.array(order))
        for k in range(0, len(n), 50_000):
            rows = len(n[k : k + 50_000])
            none = pa.nulls(rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, self.number)), pa.array(np.arange(k, k + rows)), langs.slice(k, rows), terms.slice(k, rows), pa.array(n[order[k : k + rows]]), none, none], schema=_FIRST)
        yield pa.RecordBatch.from_pylist([{"block": self.number} | pack_relation(np.concatenate(self.places), codes)], schema=_FIRST)


def word_occurrences(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The relation of single words and the words' counts, block by block; ``docs`` has lang and text."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        block = Block(number)
        for b in batches:
            for s in slices(b):
                block.add(s.column("text"), s.column("lang").to_pylist())
                if block.at >= block_words:
                    yield from block.close()
                    number += 1
                    block = Block(number)
        if block.at:
            yield from block.close()

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(blocks, _FIRST_DDL)


def _frequent_words(table: DataFrame, least: int) -> DataFrame:
    """block, code, id, f, first, lang, term of every word of a block that is frequent in all.

    The smallest (block, code) of a word is its id; there ``first`` is true and the word is kept.  A block has a word once, so a word has no more rows than there are blocks.
    """
    own = F.shiftleft("block", _CODE_BITS) + F.col("code")
    w = Window.partitionBy("lang", "term")
    rows = table.where("code IS NOT NULL").select("block", "code", "lang", "term", F.sum("n").over(w).alias("f"), F.min(own).over(w).alias("id"))
    first = F.col("id") == own
    return rows.where(F.col("f") >= least).select("block", "code", "id", "f", first.alias("first"), *(F.when(first, F.col(k)).alias(k) for k in ("lang", "term")))


def _frequent_groups(table: DataFrame, least: int) -> DataFrame:
    """id, f, a, b of every frequent group, and beside them (block, found) rows, the codes and ids of a block's frequent groups.

    The groups of a bucket come from all blocks and are merged by key; ids are as for words.
    """

    def merge(rows: pa.Table) -> pa.Table:
        parts = [(block, *unpack_groups(g)) for block, g in zip(rows.column("block").to_pylist(), rows.column("groups").to_pylist(), strict=True)]
        own = np.concatenate([(block << _CODE_BITS) + code for block, *_, code in parts])
        a, b, n = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        order = np.lexsort((own, b, a))
        own, a, b = own[order], a[order], b[order]
        begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        total, size = np.add.reduceat(n[order], begin), np.diff(np.append(begin, len(own)))
        keep = total >= least
        ids, within = own[begin], np.repeat(keep, size)
        named, own = np.repeat(ids, size)[within], own[within]
        order = np.argsort(own)
        block, code = np.divmod(own[order], 1 << _CODE_BITS)
        blocks, cuts = np.unique(block, return_index=True)
        found = [_squeeze(code[i:j].astype("<u4"), named[order][i:j].astype("<i8")) for i, j in zip(cuts, np.append(cuts, len(code))[1:], strict=True)]
        phrases, begin = int(keep.sum()), begin[keep]
        lists = [pa.concat_arrays([pa.array(x, t), pa.nulls(phrases, t)]) for x, t in ((blocks, pa.int64()), (found, pa.binary()))]
        named = [pa.concat_arrays([pa.nulls(len(blocks), pa.int64()), pa.array(x)]) for x in (ids[keep], total[keep], a[begin], b[begin])]
        return pa.Table.from_arrays([*lists, *named], schema=_FREQUENT)

    return table.where("bucket IS NOT NULL").select("bucket", "block", "groups").groupBy("bucket").applyInArrow(merge, _FREQUENT_DDL)


def _extend(table: DataFrame, frequent: DataFrame, buckets: int, last: bool) -> DataFrame:
    """Occurrences one word longer, from the relation of ``table`` without its occurrences of phrases that are not frequent."""

    def join(relation: pa.Table, ids: pa.Table) -> pa.Table:
        if not len(relation) or not len(ids):
            return _NEXT.empty_table()
        block = relation.column("block")[0].as_py()
        places, codes = unpack_relation(relation.column("places")[0].as_py(), relation.column("codes")[0].as_py())
        named = np.full(int(codes.max(initial=0)) + 1, -1, np.int64)
        if "found" in ids.column_names:
            for found in ids.column("found").to_pylist():
                code, own = _expand(found, "<u4", "<i8")
                named[code] = own
        else:
            named[ids.column("code").to_numpy()] = ids.column("id").to_numpy()
        keep = named[codes] >= 0
        places, codes = places[keep], codes[keep]
        # Both sides of the merge-join are sorted by place, and a place has one phrase of this length.
        meet = np.flatnonzero(places[1:] == places[:-1] + 1)
        pair = pa.array(codes[meet] << _CODE_BITS | codes[meet + 1]).dictionary_encode()
        code = pair.indices.to_numpy()
        n = np.bincount(code, minlength=len(pair.dictionary))
        order, code = _by_frequency(code, n)
        a, b = (named[x] for x in np.divmod(pair.dictionary.to_numpy()[order], 1 << _CODE_BITS))
        bucket = bucket_of(a, b, buckets)
        by = np.lexsort((a, bucket))
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        rows = [{"block": block, "bucket": k, "groups": pack_groups(a[x], b[x], n[order][x], x)} for k in range(buckets) if len(x := by[cuts[k] : cuts[k + 1]])]
        if not last and len(meet):
            rows.append({"block": block} | pack_relation(places[meet], code))
        return pa.Table.from_pylist(rows, _NEXT)

    relations = table.where("places IS NOT NULL").select("block", "places", "codes").groupBy("block")
    return relations.cogroup(frequent.where("block IS NOT NULL").select("block", *(["found"] if "found" in frequent.columns else ["code", "id"])).groupBy("block")).applyInArrow(join, _NEXT_DDL)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = MIN_COUNT, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of up to ``longest`` words with f >= ``least``, and (lang, n) with n all words of a language.

    A-Z are lower-cased, null texts have no words, null languages are ``und``.  Repeated rows count each; other columns are not read; an empty table gives empty results.
    """
    table = materialize(word_occurrences(docs, block_words))
    words = table.where("code IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    # As many buckets of groups as there are blocks, so that a bucket has about as many groups as a block.
    buckets = max(table.where("places IS NOT NULL").count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = None
    for k in range(1, longest + 1):
        frequent = materialize(_frequent_words(table, least) if k == 1 else _frequent_groups(table, least))
        new = frequent.where("first" if k == 1 else "id IS NOT NULL")
        if k == 1:
            level = new.select("id", "lang", F.col("term").cast("string").alias("phrase"), F.col("term").cast("string").alias("last"), "f")
        else:
            head, tail = level.select(F.col("id").alias("a"), "lang", "phrase"), level.select(F.col("id").alias("b"), "last")
            level = new.select("id", "a", "b", "f").join(head, "a").join(tail, "b").select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f")
        level = materialize(level)
        found = level.select("lang", "phrase", F.lit(k).alias("k"), "f")
        known = found if known is None else known.unionByName(found)
        if k < longest:
            table = materialize(_extend(table, frequent, buckets, k + 1 == longest))
    return known, words


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) over 38 digits, which holds counts up to 3e17."""
    wide = {"a": a, "n": n, "l": left, "r": right}
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide["a"].cast("decimal(17,0)") * wide["n"].cast("decimal(17,0)")), wide["l"].cast("decimal(19,0)") * wide["r"].cast("decimal(19,0)"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = MIN_COUNT, top: int = TOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two words or more.

    A phrase is scored by its lowest-scoring cut; one that lies in a longer candidate of the same count is dropped.
    """
    phrases, words = frequent_phrases(docs, longest, least, block_words)
    candidates = phrases.where("k > 1").withColumn("w", F.split("phrase", " "))
    part = lambda begin, size: F.array_join(F.slice("w", begin, size), " ")
    cuts = candidates.select("lang", "phrase", "k", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    # Lists of phrases grow with the documents: their joins are by shuffle at every size.
    of = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)).hint("shuffle_hash")
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    cuts = cuts.join(F.broadcast(words), "lang")  # one row for each language
    scored = cuts.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    span = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    inside = candidates.where("k > 2").select("lang", "f", F.explode(span).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_sql() -> str:
    """DuckDB SQL of the query."""
    return r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
    w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM d),
    g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM w, unnest(range(1, 6)) AS a(k), unnest(range(1, len(ws) - k + 2)) AS b(i)),
    f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
    n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
    c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS p FROM f WHERE k > 1),
    x AS (SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n.n AS n, j, (1000 * c.f * n.n) // (l.f * r.f) AS score
          FROM c JOIN n USING (lang), unnest(range(1, c.k)) AS u(j)
          JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(p[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(p[j + 1:], ' ')),
    y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    i AS (SELECT lang, array_to_string(p[b : b + m - 1], ' ') AS phrase, max(f) AS longer FROM c, unnest(range(2, k)) AS u(m), unnest(range(1, k - m + 2)) AS v(b) GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM y LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR longer < a QUALIFY rank <= 2000
    """
