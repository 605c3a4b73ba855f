"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, undoes look-alike letters and digit substitutions, and turns everything that is not a letter into
a space; lexicon terms are anchored at word starts (stems) or at both ends (whole words).  Hits inside an exception phrase do not
count.  The weights of the hits are summed, normalised by the text's length and mapped to a score by a fitted logistic curve.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that stand in for a letter.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l",
}
#: Whole words that count even before anything is learned.
SEED = ("idiot", "idiots", "moron", "morons", "stupid", "scum", "pathetic", "worthless", "disgusting", "loser", "losers")
SEED_WEIGHT = 4.0
#: Phrases in which a term is not an insult.
EXCEPTIONS = ("sore loser rule", "idiot proof", "stupid simple", "trash can", "trash bin", "trash bag", "clown fish", "scum line", "pond scum")
#: At most about this many labelled rows of each class are learned from, chosen by a hash of the doc_id.
SAMPLE_PER_CLASS = 6000
CANDIDATES = 20_000
STEMS = (4, 5, 6)


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = LOOKALIKES.get(chr(code), chr(code))
        self[code] = c = c if c.isalpha() else " "
        return c


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words between single spaces, with one at either end; null and empty texts give one space."""
    return f" {' '.join((text or '').lower().translate(_FOLD).split())} "


@dataclass
class Lexicon:
    """``terms``: folded pattern to weight; a pattern starts with a space, a whole word also ends with one."""

    terms: dict[str, float] = field(default_factory=lambda: {f" {w} ": SEED_WEIGHT for w in SEED})
    exceptions: Sequence[str] = EXCEPTIONS
    slope: float = 3.0
    intercept: float = -2.0

    def matcher(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (len(t), w))
        for p in self.exceptions:
            t = fold(p)
            a.add_word(t, (len(t), self.terms.get(t, 0.0) and None))
        a.make_automaton()
        return a

    def density(self, a: ahocorasick.Automaton, folded: str) -> float:
        hits = [(i - n + 1, i, w) for i, (n, w) in a.iter(folded)] if self.terms else []
        total, spare, ends = 0.0, len(folded), len(hits)
        # Hits come in the order of their ends.  Backwards, ``spare`` is the first begin of the exceptions that end here or later:
        # a hit lies inside one of them if it begins there or after it.
        for k in range(len(hits) - 1, -1, -1):
            i, j, w = hits[k]
            while ends and hits[ends - 1][1] >= j:
                ends -= 1
                if not hits[ends][2]:
                    spare = min(spare, hits[ends][0])
            if w and i < spare:
                total += w
        return float(np.log1p(8 * total / np.sqrt(max(1, folded.count(" ") - 1))))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that nothing is learned from; false where the doc_id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _terms(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w[:n]}" for w in words for n in STEMS if len(w) > n} | {f" {w} " for w in words if len(w) > 3}


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Fit a lexicon on labelled rows that are not held out, at most about SAMPLE_PER_CLASS of each class.

    Documents that hold a term are counted per class in Spark; terms of high precision that are frequent enough become candidates, and
    those that cover toxic documents which no better term covers are kept.  Only bounded tables reach the driver: CANDIDATES terms,
    the sample's toxic documents as lists of them, and one figure per sampled document.  Without toxic rows the seed lexicon is returned.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    n = {bool(r["toxic"]): r["count"] for r in marks.groupBy("toxic").count().collect()}
    if not n.get(True) or not n.get(False):
        return Lexicon()
    rate = F.when(F.col("toxic") == 1, min(1.0, SAMPLE_PER_CLASS / n[True])).otherwise(min(1.0, SAMPLE_PER_CLASS / n[False]))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < rate * 1_000_000)
    # Bounded by SAMPLE_PER_CLASS, whatever the size of the tables.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")).distinct()
    sample = sample.repartition(12, "text").persist()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b["text"], b["toxic"], strict=True):
                by[y == 1].update(_terms(fold(t)))
        yield pd.DataFrame([(t, c, by[0][t]) for t, c in by[1].items()] + [(t, 0, c) for t, c in by[0].items() if t not in by[1]], columns=["term", "tox", "rest"])

    size = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not size.get(True) or not size.get(False):
        sample.unpersist()
        return Lexicon()
    counts = sample.mapInPandas(count, "term string, tox long, rest long").groupBy("term").agg(F.sum("tox").alias("tox"), F.sum("rest").alias("rest"))
    least = max(3, size[True] // 250)
    odds = F.log((F.col("tox") + 0.5) / (size[True] + 1)) - F.log((F.col("rest") + 0.5) / (size[False] + 1))
    found = counts.where((F.col("tox") >= least) & (F.col("rest") * size[True] <= 0.02 * F.col("tox") * size[False]))
    rows = found.select("term", "tox", odds.alias("w")).orderBy(F.desc("tox"), "term").limit(CANDIDATES).collect()
    terms = [r["term"] for r in rows]

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {t: i for i, t in enumerate(terms)}
        for b in batches:
            yield pd.DataFrame({"hits": [[known[x] for x in _terms(fold(t)) if x in known] for t in b["text"]]})

    lists = [r["hits"] for r in sample.where("toxic = 1").mapInPandas(held, "hits array<int>").collect()]
    lexicon = Lexicon()
    lexicon.terms |= {terms[k]: float(min(8.0, rows[k]["w"])) for k in cover(lists, least)}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = lexicon.matcher()
        for b in batches:
            yield pd.DataFrame({"x": [lexicon.density(a, fold(t)) for t in b["text"]], "y": b["toxic"]})

    xy = sample.mapInPandas(measure, "x double, y int").toPandas()
    sample.unpersist()
    lexicon.intercept, lexicon.slope = logistic(xy["x"].to_numpy(), (xy["y"] == 1).to_numpy(float))
    return lexicon


def cover(lists: list[list[int]], least: int) -> list[int]:
    """Terms in the order of how many lists they cover that no term before them does; at least ``least`` each."""
    holders: dict[int, set[int]] = {}
    for i, hits in enumerate(lists):
        for k in hits:
            holders.setdefault(k, set()).add(i)
    out, left = [], set(range(len(lists)))
    while holders:
        k = max(holders, key=lambda t: (len(holders[t]), -t))
        if len(holders[k]) < least:
            break
        out.append(k)
        gone = holders.pop(k)
        left -= gone
        for t in [t for t, s in holders.items() if not s.isdisjoint(gone)]:
            # A term that mostly goes with those chosen adds nothing; one with cases of its own stays.
            holders[t] = holders[t] & left
            if not holders[t]:
                del holders[t]
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope by Newton steps; both classes weigh the same."""
    X, w = np.stack([np.ones_like(x), x], axis=1), np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    b = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(X @ b, -30, 30)))
        step = np.linalg.solve((X * (w * p * (1 - p))[:, None]).T @ X + ridge * np.eye(2), X.T @ (w * (y - p)) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), max(0.0, float(b[1]))


def _scorer(lexicon: Lexicon) -> Callable[..., Column]:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = lexicon.matcher()
        for texts in batches:
            x = np.array([lexicon.density(a, fold(t)) for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-(lexicon.intercept + lexicon.slope * x))))

    return score


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Narrow: only the text column goes to Python, whole.  Null and empty texts have no hit and get the curve's lowest score.  Repeated rows
    score alike.  An empty table gives an empty result.  Columns of these names in the input are replaced; all others stay.
    """
    return docs.withColumn("score", _scorer(lexicon)("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold, every column as it was, whatever its name.

    Null and empty texts stay, so do repeated rows and rows with a null doc_id; an empty table gives an empty result.
    """
    scored = docs.select(F.struct("*").alias("doc"), _scorer(learn(docs, labels))("text").alias("score"))
    return scored.where(F.col("score") < threshold).select("doc.*")
