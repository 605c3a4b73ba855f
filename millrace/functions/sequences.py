"""Column functions over DNA strings, labels and ids.  Each takes and returns Columns, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ambiguity letters that become N, and the split names that mean validation.
AMBIGUOUS = "RYSWKMBDHV"
VALIDATION_NAMES = ("val", "dev", "valid", "validation")


def norm_split(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*VALIDATION_NAMES), "validation").otherwise(low)


def norm_dna(c: Column) -> Column:
    """Struct of the sequence (upper case, U as T, ambiguity letters as N), whether it is valid, and how many letters were replaced."""
    up = F.upper(c)
    seq = F.translate(up, "U" + AMBIGUOUS, "T" + "N" * len(AMBIGUOUS))
    return F.struct(
        seq.alias("sequence"), F.coalesce(seq.rlike("^[ACGTN]+$"), F.lit(False)).alias("valid"),
        (F.length(up) - F.length(F.translate(up, "U", ""))).cast("long").alias("n_u"),
        (F.length(up) - F.length(F.translate(up, AMBIGUOUS, ""))).cast("long").alias("n_ambiguous"),
    )


def parse_label(c: Column) -> Column:
    """Struct (label, label_vec): a bracketed list or a 0-1 string of two or more digits is a vector, else a finite number."""
    text = F.trim(c)
    listed = F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x.try_cast("double"))
    bits = F.transform(F.split(text, ""), lambda x: x.try_cast("double"))
    number = text.try_cast("double")
    vector = F.when(text.startswith("["), listed).when(text.rlike("^[01]{2,}$"), bits)
    scalar = F.when(vector.isNull() & ~F.isnan(number) & (F.abs(number) < float("inf")), number)
    return F.struct(scalar.alias("label"), vector.alias("label_vec"))


def stable_id(*cols: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256), 1, 24)


def encode(c: Column) -> Column:
    """Codes 0 to 4 of A, C, G, T, N; null for any other letter."""
    return F.transform(F.split(F.translate(c, "ACGTN", "01234"), ""), lambda x: x.try_cast("int"))


def decode(codes: Column) -> Column:
    return F.translate(F.array_join(F.transform(codes, lambda x: x.cast("string")), ""), "01234", "ACGTN")


def signature(c: Column, second: Column | None = None) -> Column:
    one = F.sha2(c, 256)
    return one if second is None else F.when(second.isNull(), one).otherwise(F.concat_ws(":", one, F.sha2(second, 256)))


def center_crop(c: Column, size: int) -> Column:
    start = F.greatest(F.lit(0), F.floor((F.length(c) - size) / 2)).cast("int")
    return F.substr(c, start + 1, F.lit(size))


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGT", "TGCA"))


def canonical(c: Column) -> Column:
    return F.least(c, reverse_complement(c))


def _share(c: Column, letters: str, of: Column) -> Column:
    return F.coalesce((F.length(c) - F.length(F.translate(c, letters, ""))) / F.nullif(of, F.lit(0)), F.lit(0.0))


def composition(c: Column) -> Column:
    """Struct of GC share among ACGT, length / 8192 and N share."""
    bases = F.length(c) - F.length(F.translate(c, "ACGT", ""))
    return F.struct(_share(c, "GC", bases).alias("gc"), (F.length(c) / 8192).alias("rel_length"), _share(c, "N", F.length(c)).alias("n_share"))


def window_at(c: Column, center: Column, size: int) -> Column:
    """The ``size`` letters around a 0-based centre, null where they would run over an end."""
    start = center - size // 2
    return F.when((start >= 0) & (start + size <= F.length(c)), F.substr(c, start + 1, F.lit(size)))


def parse_attributes(c: Column) -> Column:
    return F.str_to_map(F.rtrim(c, F.lit(";")), F.lit(";"), F.lit("="))


def any_positive(labels: Column) -> Column:
    return F.when((F.size(labels) > 0) & F.forall(labels, lambda x: x.isin(0, 1)), F.exists(labels, lambda x: x == 1).cast("int"))


def allele_label(ac: Column, an: Column) -> Column:
    """1 for a single carrier, 0 for a minor frequency of at least 0.05, else null."""
    af = ac / F.nullif(an, F.lit(0))
    return F.when(an <= 0, None).when(ac == 1, 1).when(F.least(af, 1 - af) >= 0.05, 0)


def join_pair(a: Column, b: Column, spacer: int = 50) -> Column:
    return F.concat(a, F.lit("N" * spacer), b)


def hash_bucket(key: Column, buckets: int) -> Column:
    """First 32 bits of the key's SHA-256 modulo ``buckets``."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def hash_uniform(key: Column, part: int = 0) -> Column:
    """A draw in [0, 1) from 32 bits of the key's SHA-256; ``part`` 0 to 7 names which 32 bits."""
    return F.conv(F.substring(F.sha2(key, 256), part * 8 + 1, 8), 16, 10).cast("double") / 4294967296.0


def superfamily(c: Column) -> Column:
    """The last ``/`` part of a class name, up to its first ``_``."""
    return F.split_part(F.element_at(F.split(c, "/"), -1), F.lit("_"), F.lit(1))


def vocab_id(c: Column, names: tuple[str, ...], ignore: int = -100) -> Column:
    """Place of a name in a fixed vocabulary; unknown and null names take ``ignore``."""
    known = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    return F.coalesce(F.try_element_at(known, c), F.lit(ignore))


def record_json(**cols: Column) -> Column:
    """JSON object with its keys in order; null values are left out."""
    return F.to_json(F.struct(*[cols[k].alias(k) for k in sorted(cols)]))


def true_bases(c: Column, positions: list[int]) -> Column:
    """Codes 0 to 3 of the letters at 0-based positions; any other letter, or none, is 4."""
    at = F.array(*[F.instr(F.lit("ACGT"), F.substring(c, p + 1, 1)) for p in positions])
    seen = F.array(*[F.length(c) > p for p in positions])
    return F.zip_with(at, seen, lambda i, s: F.when(s & (i > 0), i - 1).otherwise(4))
