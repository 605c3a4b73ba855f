"""The sample store: rows are normalised, written to a staging folder, validated there and moved into place with a manifest, or not at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import AMBIGUOUS, norm_dna, norm_split, signature
from ..operators.quality import CROSSING, key_groups, of_kind, validate_samples
from . import files

STANDARD = ("sample_id", "split", "sequence", "sequence_b", "label", "label_vec", "species", "assembly_id", "group_id")
SPLITS = ("train", "validation", "test")
UNKNOWN = "unknown_plant"


class InvalidSamples(ValueError):
    """What is wrong with the samples: rule to number of rows."""

    def __init__(self, found: dict[str, int]) -> None:
        super().__init__(", ".join(f"{k}: {n}" for k, n in sorted(found.items())))
        self.found = found


def normalised(df: DataFrame) -> DataFrame:
    """The columns of the store, whatever ``df`` has of them; all its other columns become JSON in ``metadata``, null ones left out."""
    have = lambda name, kind: F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
    text = lambda name: F.trim(F.coalesce(have(name, "string"), F.lit("")))
    blank = lambda c: F.when(c == "", None).otherwise(c)
    one, two = norm_dna(have("sequence", "string")), norm_dna(blank(text("sequence_b")))
    rest = [c for c in df.columns if c not in STANDARD]
    species = F.coalesce(blank(text("species")), F.lit(UNKNOWN))
    x = df.select(
        text("sample_id").alias("sample_id"), norm_split(have("split", "string")).alias("split"), one.alias("one"), two.alias("two"), blank(text("sequence_b")).isNotNull().alias("paired"),
        have("label", "double").alias("label"), have("label_vec", "array<double>").alias("label_vec"), species.alias("species"), F.coalesce(blank(text("assembly_id")), species).alias("assembly_id"), text("group_id").alias("group_id"),
        (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("metadata"), *(F.regexp_replace(F.upper(F.coalesce(have(c, "string"), F.lit(""))), f"[^{AMBIGUOUS}]", "").alias(f"ambiguous_{c}") for c in ("sequence", "sequence_b")),
    )
    second = F.when(F.col("paired"), F.col("two.sequence"))
    return x.select(
        "sample_id", "split", F.col("one.sequence").alias("sequence"), second.alias("sequence_b"), "label", "label_vec", "species", "assembly_id", "group_id", "metadata",
        signature(F.col("one.sequence")).alias("sequence_sha256"), F.concat("ambiguous_sequence", "ambiguous_sequence_b").alias("ambiguous"),
        (F.coalesce("one.n_u", F.lit(0)) + F.when(F.col("paired"), F.coalesce("two.n_u", F.lit(0))).otherwise(0)).alias("n_u"), "paired",
        (F.col("one.valid") & (~F.col("paired") | F.coalesce("two.valid", F.lit(False)))).alias("valid"),
    )


def findings(store: DataFrame, required: tuple[str, ...] = SPLITS, allow_copies: bool = False, allow_groups: bool = False) -> dict[str, int]:
    """Broken rules of normalised rows: those of ``validate_samples``, label vectors of several widths or not finite, paired beside unpaired rows, no rows at all.

    ``allow_copies`` and ``allow_groups`` let sequences and groups cross splits.
    """
    known = store.withColumn("group_id", F.nullif("group_id", F.lit(""))).withColumn("label", F.when(F.col("label_vec").isNull(), F.col("label")).otherwise(0.0))
    known = known.withColumn("sequence", F.when(F.col("valid"), F.col("sequence")))
    found = {r["rule"]: r["rows"] for r in validate_samples(known, required).collect()}
    finite = F.forall("label_vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    wide = F.size("label_vec")
    seen = store.agg(F.count("*").alias("n"), F.count_if("paired").alias("pairs"), F.min(F.when(F.col("label_vec").isNotNull(), wide)).alias("low"), F.max(F.when(F.col("label_vec").isNotNull(), wide)).alias("high"), F.count_if(F.col("label_vec").isNotNull() & ~(finite & (wide > 0))).alias("bad")).first()
    found |= {"no_rows": 1} if not seen["n"] else {}
    found |= {"bad_label_vector": seen["bad"]} if seen["bad"] else {}
    found |= {"label_widths": 1} if seen["low"] != seen["high"] else {}
    found |= {"mixed_pairing": seen["pairs"]} if 0 < seen["pairs"] < seen["n"] else {}
    allowed = {"cross_split_signature"} if allow_copies else set()
    return {k: n for k, n in found.items() if k not in allowed | ({"cross_split_group_id"} if allow_groups else set())}


def manifest_of(store: DataFrame) -> dict:
    """Rows, bases, splits, label width, pairing, replaced letters and groups over several splits, from two passes over the normalised rows."""
    letters = {c: F.coalesce(F.sum(F.length("ambiguous") - F.length(F.translate("ambiguous", c, ""))), F.lit(0)).alias(f"n_{c}") for c in AMBIGUOUS}
    one = store.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("bases"), *(F.count_if(F.col("split") == s).alias(s) for s in SPLITS),
        F.max(F.size("label_vec")).alias("width"), F.coalesce(F.bool_or("paired"), F.lit(False)).alias("paired"), F.count_if(F.col("ambiguous") != "").alias("rows_with_iupac"), F.coalesce(F.sum("n_u"), F.lit(0)).alias("u"), *letters.values(),
    ).first()
    groups = key_groups(store, {"group_id": F.nullif("group_id", F.lit(""))}).agg(of_kind("group_id", CROSSING)).first()[0]
    symbols = {c: one[f"n_{c}"] for c in sorted(AMBIGUOUS) if one[f"n_{c}"]}
    return {
        "rows": one["rows"], "total_bases": one["bases"], "split_counts": {s: one[s] for s in SPLITS if one[s]}, "vector_label_width": one["width"] if (one["width"] or -1) >= 0 else None, "paired_sequences": one["paired"],
        "iupac_symbols_to_n": symbols, "iupac_bases_to_n": sum(symbols.values()), "rows_with_iupac": one["rows_with_iupac"], "u_bases_to_t": one["u"], "cross_split_groups": groups,
    }


def write_samples(df: DataFrame, path: str, task_id: str, task_kind: str, required: tuple[str, ...] = SPLITS, allow_copies: bool = False, allow_groups: bool = False) -> dict:
    """Normalise ``df`` and put it at ``path`` with a manifest, which is returned.

    A target that holds anything is an error.  Rows are written once, to a folder beside the target, and are validated and counted there; broken rules raise ``InvalidSamples`` and nothing is left.  Readers
    see the whole store or none: the folder is renamed when its manifest is written.
    """
    spark = df.sparkSession
    if files.is_filled(spark, path):
        raise FileExistsError(f"{path} is not empty")
    staged = files.staging_of(path)
    try:
        normalised(df).write.partitionBy("split").parquet(f"{staged}/samples")
        store = _samples(spark, staged)
        if found := findings(store, required, allow_copies, allow_groups):
            raise InvalidSamples(found)
        manifest = {"status": "ok", "task_id": task_id, "task_kind": task_kind} | manifest_of(store)
        manifest |= {"cross_split_copies": "allowed_and_disclosed" if allow_copies else "forbidden", "cross_split_group_policy": "official_split_informational" if allow_groups else "forbidden"}
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{staged}/manifest")
        files.move(spark, staged, path)
    except BaseException:
        files.remove(spark, staged)
        raise
    return manifest


_STORED = "sample_id string, sequence string, sequence_b string, label double, label_vec array<double>, species string, assembly_id string, group_id string, metadata string, sequence_sha256 string, ambiguous string, n_u bigint, paired boolean, valid boolean, split string"


def _samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(f"{path}/samples")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def read_samples(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The rows of a store, with ``metadata`` as a map; one split alone reads only its files.  A letter that is no base or N is an error, as is a folder without a manifest."""
    read_manifest(spark, path)
    x = _samples(spark, path)
    x = x if split is None else x.where(F.col("split") == split)
    bad = ~F.col("sequence").rlike("^[ACGTN]+$") | F.coalesce(~F.col("sequence_b").rlike("^[ACGTN]+$"), F.lit(False))
    sequence = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("a letter that is no base: "), F.col("sample_id")))).otherwise(F.col("sequence"))
    return x.select("sample_id", "split", sequence.alias("sequence"), "sequence_b", "label", "label_vec", "species", "assembly_id", "group_id", "sequence_sha256", F.from_json("metadata", "map<string,string>").alias("metadata"))
