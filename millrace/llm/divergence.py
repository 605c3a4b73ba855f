"""How far the sources of a language differ in their terms, by in-mapper stripes.

A task folds whole documents into stripes, (language, term) to (document frequency, count by source), and spills them when they have grown large.  Spark sorts the
spilled stripes by key, a task merges each key's stripes as they stream past, and merged stripes directly give their part of every divergence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize
from .words import byte_classes, slices, split

#: Terms are runs of letters and of characters beyond ASCII.
CLASSES = byte_classes(bytes(c for c in range(128) if not chr(c).isalpha()))
MIN_DOCS = 30
TOP_TERMS = 50
SMOOTHING = 5
#: Figures that a task's stripes hold before they are spilled.
SPILL_COUNTS = 2_000_000
#: Languages of more sources than this give each chunk's pair sums at once and keep no matrix of them.
MATRIX_SOURCES = 1024
#: A spilled stripe's counts, side by side.
_ENTRY = np.dtype([("source", "<u4"), ("count", "<u8")])
_SPILLED = "lang int, term binary, docs bigint, entries binary"
_SPILLED_ARROW = pa.schema([("lang", pa.int32()), ("term", pa.binary()), ("docs", pa.int64()), ("entries", pa.binary())])
_STRIPE = "lang int, term binary, docs bigint, sources array<int>, counts array<bigint>"
_ARROW = pa.schema([("lang", pa.int32()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[cut], np.add.reduceat(values, cut) if len(cut) else values


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs, by hashing."""
    coded = pa.array(keys).dictionary_encode()
    return coded.dictionary.to_numpy(), np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))


class Stripes:
    """(term, group) and (term, language) counts of one task; a group is a (language, source) with a number in the order of both."""

    def __init__(self, lang_of: np.ndarray, most: int) -> None:
        self.most = most
        self.lang_of, self.groups, self.langs = lang_of, len(lang_of), int(lang_of.max(initial=-1)) + 1
        self.clear()

    def clear(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def fold(self, texts: pa.Array, group: np.ndarray) -> None:
        words, row, _ = split(texts, CLASSES)
        if not len(words):
            return
        coded = words.dictionary_encode()
        term, n = coded.indices.to_numpy(), len(coded.dictionary)
        own = np.array([self.terms.setdefault(t, len(self.terms)) for t in coded.dictionary.to_pylist()], np.int64)
        pair, times = counted(row.astype(np.int64) * n + term)  # a document has a term once
        row, term = np.divmod(pair, n)
        self.counts.append(summed(own[term] * self.groups + group[row], times))
        self.docs.append(summed(own[term] * self.langs + self.lang_of[group[row]], np.ones(len(term), np.int64)))
        self.size += len(self.counts[-1][0])
        if self.size > self.most:  # counts of the same keys come together first
            for kept in (self.counts, self.docs):
                kept[:] = [summed(*map(np.concatenate, zip(*kept, strict=True)))]
            self.size = len(self.counts[0][0])

    def spill(self) -> Iterator[pa.RecordBatch]:
        if self.counts:
            (key, count), (at, docs) = (summed(*map(np.concatenate, zip(*kept, strict=True))) for kept in (self.counts, self.docs))
            names = pa.array(self.terms, pa.binary())
            term, group = np.divmod(key, self.groups)
            # A stripe's groups lie side by side, as groups are in the order of their languages.
            begin = np.searchsorted(term * self.langs + self.lang_of[group], at)
            term, lang = np.divmod(at, self.langs)
            for k in range(0, len(at), 10_000):
                i, j = k, min(k + 10_000, len(at))
                lo, hi = begin[i], begin[j] if j < len(at) else len(key)
                entries = np.empty(hi - lo, _ENTRY)
                entries["source"], entries["count"] = group[lo:hi], count[lo:hi]
                off = ((np.append(begin[i:j], hi) - lo) * _ENTRY.itemsize).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(off), pa.py_buffer(entries)])
                yield pa.RecordBatch.from_arrays([pa.array(lang[i:j], pa.int32()), names.take(pa.array(term[i:j])), pa.array(docs[i:j]), packed], schema=_SPILLED_ARROW)
        self.clear()


def _lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, source and count of each entry of the stripes."""
    sources, counts = table.column("sources").combine_chunks(), table.column("counts").combine_chunks()
    return np.repeat(np.arange(len(table)), np.diff(sources.offsets.to_numpy())), sources.flatten().to_numpy(), counts.flatten().to_numpy()


def merge_sorted(batches: Iterator[pa.RecordBatch], groups: int, least: int) -> Iterator[pa.RecordBatch]:
    """One stripe for each key of at least ``least`` documents, from spilled stripes sorted by key; holds a batch and one open key."""
    held = None  # (lang, term, docs, sources, counts) of the open key

    def stripes(lang: np.ndarray, term: pa.Array, docs: np.ndarray, begin: np.ndarray, source: np.ndarray, count: np.ndarray) -> pa.Table:
        lists = [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), x) for x in (pa.array(source, pa.int32()), pa.array(count, pa.int64()))]
        out = pa.Table.from_arrays([pa.array(lang, pa.int32()), term, pa.array(docs), *lists], schema=_ARROW)
        return out.filter(pc.greater_equal(out.column("docs"), least))

    for b in batches:
        if not len(b):
            continue
        lang, term, docs = b.column("lang").to_numpy(), b.column("term"), b.column("docs").to_numpy()
        new = np.ones(len(b), bool)
        new[1:] = (lang[1:] != lang[:-1]) | ~pc.equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        packed = b.column("entries")
        off = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(b) + 1] // _ENTRY.itemsize
        entries = np.frombuffer(packed.buffers()[2], _ENTRY)[off[0] : off[-1]]
        key = (np.cumsum(new) - 1)[np.repeat(np.arange(len(b)), np.diff(off))] * groups + entries["source"]
        count = entries["count"].astype(np.int64)
        first = np.flatnonzero(new)
        sums = np.add.reduceat(docs, first)
        if held and held[0] == lang[0] and held[1] == term[0].as_py():
            key, count = np.concatenate([held[3], key]), np.concatenate([held[4], count])
            sums[0] += held[2]
        elif held:
            yield from stripes([held[0]], pa.array([held[1]], pa.binary()), [held[2]], [0, len(held[3])], held[3], held[4]).to_batches()
        key, count = summed(key, count)
        begin = np.searchsorted(key, np.arange(len(first) + 1) * groups)
        yield from stripes(lang[first[:-1]], term.take(pa.array(first[:-1])), sums[:-1], begin[:-1], key[: begin[-2]] % groups, count[: begin[-2]]).to_batches()
        held = (int(lang[-1]), term[-1].as_py(), int(sums[-1]), key[begin[-2] :] % groups, count[begin[-2] :])
    if held:
        yield from stripes([held[0]], pa.array([held[1]], pa.binary()), [held[2]], [0, len(held[3])], held[3], held[4]).to_batches()


def term_stripes(docs: DataFrame, groups: list[tuple[str, str]], min_docs: int = MIN_DOCS, spill: int = SPILL_COUNTS) -> DataFrame:
    """Merged stripes of the terms in at least ``min_docs`` rows of their language; ``groups`` are all (lang, source) in order."""
    number = {g: i for i, g in enumerate(groups)}
    langs = sorted({lang for lang, _ in groups})
    lang_of = np.array([langs.index(lang) for lang, _ in groups], np.int64)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = Stripes(lang_of, spill)
        for b in batches:
            for s in slices(b):
                stripes.fold(s.column("text"), np.array([number[g] for g in zip(s.column("lang").to_pylist(), s.column("source").to_pylist(), strict=True)], np.int64))
                if stripes.size > spill // 2:
                    yield from stripes.spill()
        yield from stripes.spill()

    spilled = materialize(docs.select("lang", "source", "text").mapInArrow(fold, _SPILLED))
    by_key = spilled.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return by_key.mapInArrow(lambda batches: merge_sorted(batches, len(groups), min_docs), _STRIPE)


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(1000000000 * count / total), exact while total * 1000 stays below 2**63; no count is over its total."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + step
    return 1 + whole


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, spill: int = SPILL_COUNTS, matrix_sources: int = MATRIX_SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of ``docs`` (lang, source, text).

    Part ``pair`` has the divergence from each other source of the language, part ``term`` the ``top`` terms that the source has more of than its language.
    Null text, lang and source are empty.  A language without kept terms has pairs of value 0; a source alone in its language has no pair.  Repeated rows count each, a
    text of any length is read whole, an empty table gives an empty result, and other columns are not read.  The groups (lang, source) and their sums go to
    every task: the result has a row for each pair of them, the square of what is sent.
    """
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = sorted((r["lang"], r["source"]) for r in docs.select("lang", "source").distinct().collect())
    langs = sorted({lang for lang, _ in groups})
    merged = materialize(term_stripes(docs, groups, min_docs, spill))
    sums = {r["g"]: r["n"] for r in merged.select(F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy(F.col("x.sources").alias("g")).agg(F.sum("x.counts").alias("n")).collect()}
    kept = {r["lang"]: r["v"] for r in merged.groupBy("lang").agg(F.count("*").alias("v")).collect()}
    totals = np.array([sums.get(g, 0) for g in range(len(groups))], np.int64)
    members = {i: [g for g, (x, _) in enumerate(groups) if x == lang] for i, lang in enumerate(langs)}
    schema = "lang string, source string, part string, item string, value bigint"
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(lang: int, source: int, part: str, items: list[str], values: np.ndarray) -> pa.RecordBatch:
        n = len(items)
        return pa.RecordBatch.from_arrays([pa.array([langs[lang]] * n, pa.string()), pa.array([groups[source][1]] * n, pa.string()), pa.array([part] * n, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = {}
        best: dict[int, list[tuple[int, bytes]]] = {}

        def pairs(lang: int, k: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            own = members[lang]
            yield rows(lang, own[k], "pair", [groups[g][1] for g in own[k + 1 :]], values)
            for g, v in zip(own[k + 1 :], values, strict=True):
                yield rows(lang, g, "pair", [groups[own[k]][1]], [v])

        for b in batches:
            table = pa.Table.from_batches([b])
            at = b.column("lang").to_numpy()
            for lang in np.unique(at).tolist():
                own = members[lang]
                some = table.filter(pa.array(at == lang))
                step = max(1, (1 << 20) // len(own))
                for i in range(0, len(some), step):
                    part = some.slice(i, step)
                    row, source, count = _lists(part)
                    c = np.zeros((len(part), len(own)), np.int64)
                    c[row, source - own[0]] = count
                    smooth = SMOOTHING * kept[lang]
                    p = share(c + SMOOTHING, totals[own] + smooth)
                    q = share(c.sum(1) + SMOOTHING, totals[own].sum() + smooth)
                    terms = part.column("term").to_pylist()
                    for k, g in enumerate(own):
                        more = p[:, k] - q
                        found = np.flatnonzero((c[:, k] > 0) & (more > 0))
                        if len(found) > top:  # ties with the last place stay
                            found = found[more[found] >= np.partition(more[found], -top)[-top]]
                        best[g] = sorted([*best.get(g, ()), *((-int(more[x]), terms[x]) for x in found)])[:top]
                        values = np.abs(p[:, k + 1 :] - p[:, k : k + 1]).sum(0)
                        if len(own) > matrix_sources:
                            yield from pairs(lang, k, values)
                        else:
                            matrix.setdefault(lang, np.zeros((len(own), len(own)), np.int64))[k, k + 1 :] += values
        for lang, m in matrix.items():
            for k in range(len(m) - 1):
                yield from pairs(lang, k, m[k, k + 1 :])
        for g, found in best.items():
            if found:
                yield rows(langs.index(groups[g][0]), g, "term", [t.decode() for _, t in found], np.array([-v for v, _ in found]))

    base = spark.createDataFrame(groups, "lang string, source string")
    other = base.withColumnRenamed("source", "item")
    # Every pair is there, whether or not its language kept a term; the result has just these rows.
    none = base.join(other, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    value = merged.mapInArrow(emit, schema).unionByName(none).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return value.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_sql() -> str:
    """DuckDB SQL of the query."""
    return r"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
    v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
    n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 5)) // (coalesce(n, 0) + 5 * v) AS p
          FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
    q AS (SELECT lang, term, 1 + (1000000000 * (sum(c)::HUGEINT + 5)) // (any_value(t) + 5 * any_value(v)) AS q
          FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n)::HUGEINT AS t FROM n GROUP BY lang) USING (lang) GROUP BY lang, term),
    s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM x QUALIFY part = 'pair' OR rank <= 50
    """
