"""Quality rules, line first: bad lines go, then documents that lost too much text.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BOILERPLATE = r"licensed under|all rights reserved|cookie|terms of (use|service)|privacy policy|enable javascript|subscribe to|click here|log ?in|sign ?up"
#: A line fails the navigation rule with this many separators and at least one to four words.
MIN_SEPARATORS = 3
#: A document is rejected when its failed lines hold more than this share of its word characters.
MAX_LOST = 0.5


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def bad_line(line: Column) -> Column:
    """True for a line that breaks a navigation, boilerplate or punctuation rule.

    Navigation: three or more ``|`` or ``>`` separators, one for four words at least.  Punctuation: a symbol
    or an exclamation mark in more than a third of the words.  Boilerplate: short line with a stock phrase.
    """
    words = F.length(F.regexp_replace(F.btrim(line, F.lit(SPACE)), r"[^\x20\x09-\x0D]+", "")) + 1
    separators = _count(line, "|>")
    noise = _count(line, SYMBOLS + "!")
    boiler = (words <= 30) & F.lower(line).rlike(BOILERPLATE)
    return ((separators >= MIN_SEPARATORS) & (4 * separators >= words)) | ((noise >= 3) & (3 * noise > words)) | boiler


def _counted(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as the struct ``doc``, so that no column of it can clash with the steps beside it."""
    whole = F.col("doc.text")
    text = F.coalesce(whole, F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    # Each step reads arrays of the step before more than once, so they stay columns and are made once.
    step = docs.select(
        F.struct("*").alias("doc")
    ).select(
        "doc",
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))).alias("h"),
    )
    # Hashes of windows of 2, 4 and 8 words, each from two of the size before; a window that hangs over the end is cut off.
    pairs = lambda c, n: F.zip_with(c, F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    step = step.withColumns({
        "n_words": F.size("h").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "bad": F.filter("lines", bad_line),
        "h2": F.when(F.size("h") >= 8, pairs("h", 1)),
    }).drop("h", "lines")
    step = step.withColumn("h4", pairs("h2", 2)).withColumn("w", F.slice(pairs("h4", 4), 1, F.col("n_words").cast("int") - 7)).drop("h2", "h4")
    step = step.withColumn("s", F.when(F.size(F.array_distinct("w")) < F.size("w"), F.sort_array(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    here, before, after = (lambda x: x["h"]), (lambda i: F.get(F.col("s"), i - 1)["h"]), (lambda i: F.get(F.col("s"), i + 1)["h"])
    twice = F.filter("s", lambda x, i: F.coalesce(here(x) == before(i), F.lit(False)) | F.coalesce(here(x) == after(i), F.lit(False)))
    begins = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        begins,
        F.struct(F.lit(-8).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(8), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    lost = F.aggregate("bad", F.lit(0).cast("long"), lambda a, x: a + F.length(F.translate(x, SPACE, "")))
    step = step.withColumns({"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"), "lost_chars": F.coalesce(lost, F.lit(0)).cast("long")}).drop("w", "s")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = ~failed & (F.col("lost_chars") <= MAX_LOST * F.col("word_chars"))
    clean = F.when(F.size("bad") == 0, whole).otherwise(F.concat_ws("\n", F.filter(F.split(whole, "\n"), lambda x: ~bad_line(x))))
    return step.withColumns({"base_failed": failed, "kept": kept, "clean_text": clean}).drop("bad")


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept", "clean_text")


def judge_quality(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept, clean_text.

    Narrow: one pass over the rows, no shuffle, each text whole.  Null and empty texts have zero counts, fail the
    base rule and are not kept.  Repeated rows are judged alike.  Words in a repeated 8-word window are found by
    64-bit hashes of the words inside one text.  ``clean_text`` is the text without its failed lines.  An empty table gives an
    empty result.  Columns of these names in the input are replaced; all others stay, whatever their names.
    """
    own = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in FIGURES]
    return _counted(docs).select(*own, *FIGURES)


def clean_documents(docs: DataFrame) -> DataFrame:
    """The kept documents with failed lines removed, every other column as it was; ``n_chars`` follows the text if present.

    Repeated rows and rows with a null doc_id are judged like any other; an empty table gives an empty result.
    """
    judged = _counted(docs)
    fresh = {"text": F.col("clean_text")} | ({"n_chars": F.length("clean_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    row = F.struct(*[fresh.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
    # A filter would be pushed below the steps and its arrays made anew for every word; a generator's output stays above them.
    return judged.select(F.explode(F.when(F.col("kept"), F.array(row)).otherwise(F.array())).alias("doc")).select("doc.*")


def quality_digest(docs: DataFrame) -> DataFrame:
    out = judge_quality(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_sql() -> str:
    """DuckDB SQL of the query."""
    sql = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (
      SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    p AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM w, unnest(range(1, len(ws) - 6)) AS r(i)),
    q AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
    n AS (SELECT doc_id, sum(least(8, g))::BIGINT AS r FROM (SELECT doc_id, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8) AS g FROM q) GROUP BY doc_id),
    f AS (
      SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
        list_filter(ls, lambda x: (c(x, '[^|>]') >= 3 AND 4 * c(x, '[^|>]') >= v(x)) OR (c(x, '[^#*$%&|<>!]') >= 3 AND 3 * c(x, '[^#*$%&|<>!]') > v(x))
          OR (v(x) <= 30 AND regexp_matches(lower(x), '""" + BOILERPLATE + r"""'))) AS bad
      FROM w LEFT JOIN n USING (doc_id)),
    k AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
            coalesce(list_sum(list_transform(bad, lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')))), 0) AS lost FROM f)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.5 * word_chars AS kept FROM k
    """
    count = lambda chars: f"length(regexp_replace(x, '[^{chars}]', '', 'g'))"
    words = r"(length(regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[^\x20\x09-\x0D]+', '', 'g')) + 1)"
    return sql.replace("c(x, '[^|>]')", count("|>")).replace("c(x, '[^#*$%&|<>!]')", count("#*$%&|<>!")).replace("v(x)", words)
