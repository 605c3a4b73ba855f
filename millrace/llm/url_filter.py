"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed side by side into 64-bit words.  A state bit says "this many characters
of this rule are matched"; one Shift-And step per character moves every rule of every URL in the
batch at once.  ``*`` matches within the host or one path segment (no ``/``), ``**`` matches
anything.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the query: (action, host and path prefix).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Block list of the method itself, for URLs that no rule fits.
BLOCK_GLOBS = ("**casino**", "**cheap-pills**", "*.xxx/**", "**/wp-login.php**", "**.exe")


@dataclass(frozen=True)
class Automaton:
    """``chars``: sorted code points with a class of their own; class 0 is every other character."""

    chars: np.ndarray
    match: np.ndarray  # [class, word] bits that the character may set
    stay: np.ndarray  # [class, word] bits that loop on the character
    start: np.ndarray
    accept: np.ndarray  # [rule, 2]: word and bit

    def run(self, texts: Sequence[str]) -> np.ndarray:
        """bool[text, rule]: which rules match which whole text."""
        n = len(texts)
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        size = np.fromiter(map(len, codes), np.int64, n)
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate([codes[i] for i in order]) if n else np.zeros(0, "<u4")
        at = np.searchsorted(self.chars, flat)
        at[at == len(self.chars)] = 0
        flat = np.where(self.chars[at] == flat, at + 1, 0) if len(self.chars) else np.zeros(len(flat), int)
        begin = np.concatenate([[0], np.cumsum(size[order])])[:-1]
        state = np.tile(self.start, (n, 1))
        live = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")
        for i, k in enumerate(live):
            c, d = flat[begin[:k] + i], state[:k]
            step = d << np.uint64(1)
            step[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:k] = (step & self.match[c]) | (d & self.stay[c])
        out = np.zeros((n, len(self.accept)), bool)
        out[order] = (state[:, self.accept[:, 0]] >> self.accept[:, 1].astype(np.uint64)) & np.uint64(1) == 1
        return out


def compile_globs(globs: Sequence[str]) -> Automaton:
    """Pack the globs' states into words; a glob of any length may straddle words."""
    moves, loops, accept, start, bit = [], [], [], [], 0
    for glob in globs:
        start.append(bit)
        i = 0
        while i < len(glob):
            if glob[i] == "*":
                deep = glob[i : i + 2] == "**"
                loops.append((bit, deep))
                i += 1 + deep
            else:
                bit += 1
                moves.append((bit, glob[i]))
                i += 1
        accept.append(bit)
        bit += 1
    words = bit // 64 + 1
    chars = np.array(sorted({ord(c) for _, c in moves} | {ord("/")}), dtype=np.uint32)
    match, stay = (np.zeros((len(chars) + 1, words), np.uint64) for _ in range(2))
    for b, c in moves:
        match[np.searchsorted(chars, ord(c)) + 1, b // 64] |= np.uint64(1 << (b % 64))
    slash = np.searchsorted(chars, ord("/")) + 1
    for b, deep in loops:
        for c in range(len(chars) + 1):
            if deep or c != slash:
                stay[c, b // 64] |= np.uint64(1 << (b % 64))
    first = np.zeros(words, np.uint64)
    for b in start:
        first[b // 64] |= np.uint64(1 << (b % 64))
    return Automaton(chars, match, stay, first, np.array([(b // 64, b % 64) for b in accept]).reshape(-1, 2))


def canonical(url: str = "url") -> tuple:
    """(host, path) Columns: host after the first ``://`` up to ``/ ? #`` with A-Z lowered, path up to ``? #``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, block: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """page_id, host, path, rule, verdict, block_glob for every row; a narrow job without a shuffle.

    A rule ``host/path`` fits the host, its subdomains and every path that it begins; the longest
    fitting rule decides, else any block glob, else ``allow``.  Null URLs and URLs without ``://``
    have an empty host and path and are allowed.  Rows are judged one by one, so repeated rows and
    ties stay as they are; an empty table gives an empty result.  Other columns are not read.
    """
    prefixes = [r for _, r in rules]
    globs = [g for r in prefixes for g in (f"{r}**", f"*.{r}**")] + list(block)
    auto, n = compile_globs(globs), 2 * len(rules)
    longest = sorted(range(len(rules)), key=lambda k: len(prefixes[k]))

    @F.pandas_udf("rule string, verdict string, block_glob string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        hit = auto.run([h + p for h, p in zip(host, path, strict=True)])
        best = np.full(len(host), -1)
        for k in longest:
            best[hit[:, 2 * k] | hit[:, 2 * k + 1]] = k
        own = hit[:, n:]
        glob = np.where(own.any(axis=1), own.argmax(axis=1), -1) if len(block) else np.full(len(host), -1)
        verdict = [rules[k][0] if k >= 0 else ("block" if g >= 0 else "allow") for k, g in zip(best, glob, strict=True)]
        return pd.DataFrame({"rule": [prefixes[k] if k >= 0 else None for k in best], "verdict": verdict, "block_glob": [block[g] if g >= 0 else None for g in glob]})

    host, path = canonical()
    # Only host and path go to Python: ids stay what they are.
    slim = pages.select("page_id", host.alias("host"), path.alias("path"))
    return slim.withColumn("_j", judge("host", "path")).select("page_id", "host", "path", "_j.rule", "_j.verdict", "_j.block_glob")


def op1_sql() -> str:
    """DuckDB SQL of the query."""
    values = ", ".join(f"('{a}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for a, r in RULES)
    return f"""
    WITH u AS (
      SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    c AS (
      SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    r(act, rhost, rpath, rule) AS (VALUES {values}),
    m AS (
      SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(act, length(rule)) AS act
      FROM c LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
    g AS (
      SELECT *, CASE WHEN contains(host || path, 'casino') THEN '**casino**' WHEN contains(host || path, 'cheap-pills') THEN '**cheap-pills**'
        WHEN ends_with(host, '.xxx') AND path <> '' THEN '*.xxx/**' WHEN contains(host || path, '/wp-login.php') THEN '**/wp-login.php**'
        WHEN ends_with(host || path, '.exe') THEN '**.exe' END AS block_glob FROM m)
    SELECT page_id, host, path, rule, coalesce(act, CASE WHEN block_glob IS NULL THEN 'allow' ELSE 'block' END) AS verdict, block_glob FROM g
    """
