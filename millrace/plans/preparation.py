"""Queries that turn raw rows into samples and model rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import features, metrics, rows
from . import fixtures as X
from .registry import query

_SITE = "SELECT sample_id, sequence, row_no % length(sequence) + 1 AS pos1, substr(sequence, row_no % length(sequence) + 1, 1) AS base, row_no FROM v_samples"


@query(f"""SELECT sample_id, status, CASE WHEN status = 'ok' THEN substr(sequence, pos1 - 16, 32) END AS ref_window, CASE WHEN status = 'ok' THEN substr(sequence, pos1 - 16, 16) || alt || substr(sequence, pos1 + 1, 15) END AS alt_window
  FROM (SELECT *, CASE WHEN pos1 - 17 < 0 OR pos1 - 17 + 32 > length(sequence) THEN 'edge' WHEN ref = 'N' OR alt = 'N' THEN 'not_snv' WHEN base <> ref THEN 'mismatch' ELSE 'ok' END AS status
  FROM (SELECT *, CASE WHEN row_no % 10 = 0 THEN 'A' ELSE base END AS ref, translate(base, 'ACGT', 'CGTA') AS alt FROM ({_SITE})))""")
def p11_snv_windows(spark, d):
    at = (F.col("row_no") % F.length("sequence") + 1).alias("pos1")
    s = X.samples(spark, d).select("sample_id", "sequence", "row_no", at).withColumn("base", F.substr("sequence", F.col("pos1").cast("int"), F.lit(1)))
    s = s.withColumns({"ref": F.when(F.col("row_no") % 10 == 0, "A").otherwise(F.col("base")), "alt": F.translate("base", "ACGT", "CGTA")})
    return rows.snv_windows(s, 32).select("sample_id", "status", "ref_window", "alt_window")


@query("SELECT doc_id, source AS id, lang AS superfamily FROM documents")
def p12_parse_attributes(spark, d):
    attrs = F.concat(F.lit("ID="), "source", F.lit(";Class=TE/"), "lang", F.lit("_7;"))
    a = X.table(spark, d, "documents").select("doc_id", S.parse_attributes(attrs).alias("a"))
    return a.select("doc_id", F.col("a")["ID"].alias("id"), S.superfamily(F.col("a")["Class"]).alias("superfamily"))


@query("SELECT vec_id, CASE WHEN label % 5 < 2 THEN (label % 2 = 1 OR label // 2 % 2 = 1)::INT END AS any_positive FROM embeddings WHERE label IS NOT NULL")
def p13_any_positive(spark, d):
    e = X.table(spark, d, "embeddings").where("label IS NOT NULL")
    bits = F.when(F.col("label") % 5 < 2, F.expr("array(label % 2, label div 2 % 2)")).when(F.col("label") % 5 == 2, F.expr("array(2, 1)")).otherwise(F.expr("filter(array(1), x -> x > 1)"))
    return e.select("vec_id", S.any_positive(bits).alias("any_positive"))


@query("""SELECT doc_id, '{' || concat_ws(',', '"lang":"' || lang || '"', '"n_chars":"' || n_chars || '"', '"source":"' || source || '"') || '}' AS metadata FROM documents""")
def p16_pack_metadata(spark, d):
    return X.table(spark, d, "documents").select("doc_id", S.record_json(source=F.col("source"), lang=F.col("lang"), n_chars=F.col("n_chars").cast("string")).alias("metadata"))


@query("SELECT c_custkey, coalesce(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE'], c_mktsegment) - 1, -100)::INT AS region_id FROM customer")
def p17_vocab_id(spark, d):
    return X.table(spark, d, "customer").select("c_custkey", S.vocab_id(F.col("c_mktsegment"), ("AUTOMOBILE", "BUILDING", "FURNITURE")).alias("region_id"))


@query("""SELECT o_orderkey, sha256('{"custkey":' || o_custkey || ',"orderkey":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS record_hash FROM orders""")
def p18_record_hash(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", F.sha2(S.record_json(status=F.col("o_orderstatus"), orderkey=F.col("o_orderkey"), custkey=F.col("o_custkey")), 256).alias("record_hash"))


@query("""SELECT sample_id, max(length(sequence)) OVER (PARTITION BY row_no // 32) AS padded, length(sequence) AS n_valid, 6 * (max(length(sequence)) OVER (PARTITION BY row_no // 32) - length(sequence))
  + list_sum(list_transform(string_split(translate(sequence, 'ACGTN', '01234'), ''), lambda x: x::BIGINT))::BIGINT AS code_sum FROM v_samples""")
def p19_pad_and_mask(spark, d):
    s = X.samples(spark, d).select("sample_id", F.expr("row_no div 32").alias("batch"), S.encode(F.col("sequence")).alias("codes"))
    p = rows.pad_and_mask(s, "batch")
    return p.select("sample_id", F.size("codes").cast("long").alias("padded"), F.size(F.filter("valid", lambda v: v)).cast("long").alias("n_valid"), F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a + c).alias("code_sum"))


@query("""SELECT sample_id, count(*) FILTER (m) AS n_masked, count(*) FILTER (m AND v < 0.8) AS n_hidden, coalesce(sum(CASE WHEN v < 0.8 THEN 5 WHEN v < 0.9 THEN floor(w * 5) ELSE c END) FILTER (m), 0)::BIGINT AS input_sum, coalesce(sum(c) FILTER (m), 0)::BIGINT AS target_sum
  FROM (SELECT *, c < 4 AND (u < 0.15 OR u = min(u) FILTER (c < 4) OVER (PARTITION BY sample_id)) AND (u < 0.15 OR min(u) FILTER (c < 4) OVER (PARTITION BY sample_id) >= 0.15) AS m
    FROM (SELECT sample_id, c, ('0x' || substr(h, 1, 8))::BIGINT / 4294967296 AS u, ('0x' || substr(h, 9, 8))::BIGINT / 4294967296 AS v, ('0x' || substr(h, 17, 8))::BIGINT / 4294967296 AS w
      FROM (SELECT sample_id, instr('ACGTN', substr(sequence, i + 1, 1)) - 1 AS c, sha256('7|' || sample_id || '|' || i) AS h FROM v_samples, unnest(range(length(sequence))) r(i)))) GROUP BY sample_id""")
def p20_mask_tokens(spark, d):
    s = X.samples(spark, d).select("sample_id", S.encode(F.col("sequence")).alias("codes"))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x)
    hit = F.transform("targets", lambda t: (t != rows.IGNORE).cast("int"))
    m = rows.mask_tokens(s, 7)
    return m.select(
        "sample_id", add(hit).alias("n_masked"), F.size(F.filter("inputs", lambda x: x == rows.MASK)).cast("long").alias("n_hidden"),
        add(F.zip_with("inputs", "targets", lambda x, t: F.when(t != rows.IGNORE, x).otherwise(0))).alias("input_sum"), add(F.filter("targets", lambda t: t != rows.IGNORE)).alias("target_sum"),
    )


@query("SELECT sample_id, CASE WHEN ('0x' || substr(sha256('7|' || sample_id), 1, 8))::BIGINT / 4294967296 < 0.5 THEN reverse(translate(sequence, 'ACGT', 'TGCA')) ELSE sequence END AS sequence FROM v_samples")
def p21_strand_augment(spark, d):
    return rows.strand_augment(X.samples(spark, d), 7).select("sample_id", "sequence")


@query("SELECT vec_id, dim, round((embedding[dim + 1]::DOUBLE + embedding[len(embedding) - dim]::DOUBLE) / 2, 9) AS value FROM embeddings, unnest(range(len(embedding))) r(dim)")
def p22_strand_average(spark, d):
    e = X.table(spark, d, "embeddings").select("vec_id", F.posexplode(features.strand_average("embedding", "embedding")).alias("dim", "v"))
    return e.select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("v", 9).alias("value"))


@query("SELECT label, dim, round(coalesce(sum(embedding[dim + 1]::DOUBLE) FILTER (vec_id % 5 <> 0), 0) / greatest(count(*) FILTER (vec_id % 5 <> 0), 1), 7) AS mean FROM embeddings, unnest(range(len(embedding))) r(dim) WHERE label IS NOT NULL GROUP BY label, dim")
def p23_mean_pool(spark, d):
    e = X.table(spark, d, "embeddings").where("label IS NOT NULL").withColumn("valid", F.col("vec_id") % 5 != 0)
    return rows.mean_pool(e, ["label"], "embedding", "valid").select("label", F.col("dim").cast("long").alias("dim"), F.round("mean", 7).alias("mean"))


@query("SELECT sample_id, label FROM v_samples WHERE split = 'test'")
def p25_sealed_test(spark, d):
    return X.samples(spark, d).where("split = 'test'").select("sample_id", "label")


@query("SELECT sample_id, concat_ws(',', CASE WHEN instr('ACGT', substr(sequence, 4, 1)) > 0 AND length(sequence) > 3 THEN instr('ACGT', substr(sequence, 4, 1)) - 1 ELSE 4 END, CASE WHEN length(sequence) > 17 AND instr('ACGT', substr(sequence, 18, 1)) > 0 THEN instr('ACGT', substr(sequence, 18, 1)) - 1 ELSE 4 END) AS truth FROM v_samples WHERE split = 'test'")
def s05_zero_shot_panel(spark, d):
    return X.samples(spark, d).where("split = 'test'").select("sample_id", F.concat_ws(",", S.true_bases(F.col("sequence"), [3, 17]).cast("array<string>")).alias("truth"))


@query("SELECT o_orderkey, ntile(6) OVER (PARTITION BY o_orderkey // 64 ORDER BY o_orderkey) - 1 AS rank FROM orders")
def w16_rank_slices(spark, d):
    o = X.table(spark, d, "orders").select("o_orderkey", F.expr("o_orderkey div 64").alias("batch"))
    return rows.rank_slices(o, "batch", "o_orderkey", 6).select("o_orderkey", "rank")


@query("SELECT source, row_number() OVER (ORDER BY f, source) - 1 AS class_id FROM (SELECT source, min(doc_id) AS f FROM documents WHERE source IS NOT NULL GROUP BY source)")
def w19_class_ids(spark, d):
    return rows.class_ids(X.table(spark, d, "documents"), "source", "doc_id")


@query("SELECT lang, list(doc_id ORDER BY doc_id)[1:5]::VARCHAR AS first FROM documents GROUP BY lang")
def w20_preview(spark, d):
    p = rows.preview(X.table(spark, d, "documents"), ["lang"], "doc_id")
    return p.select("lang", F.concat(F.lit("["), F.array_join("first", ", "), F.lit("]")).alias("first"))


@query("""SELECT label, replicate, sum(times)::BIGINT AS n_rows, count(*) AS unique_rows, sum(times * (row_id % 97))::BIGINT AS checksum FROM (SELECT d.label, d.replicate, r.vec_id AS row_id, count(*) AS times FROM
  (SELECT label, replicate, ('0x' || substr(sha256('11|' || replicate || '|' || label || '|' || k), 1, 12))::BIGINT % n AS k FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label IS NOT NULL), range(20) b(replicate)) d
  JOIN (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings WHERE label IS NOT NULL) r USING (label, k) GROUP BY ALL) GROUP BY label, replicate""")
def w21_bootstrap_draws(spark, d):
    b = rows.bootstrap_draws(X.table(spark, d, "embeddings").where("label IS NOT NULL"), "label", "vec_id", 20, 11)
    return b.groupBy("label", "replicate").agg(F.sum("times").alias("n_rows"), F.count("*").alias("unique_rows"), F.sum(F.col("times") * (F.col("vec_id") % 97)).alias("checksum"))


@query("SELECT l_orderkey, l_linenumber, s_name, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def j11_window_shard(spark, d):
    """Rows with their shard's payload; Spark broadcasts the shards while they are below its threshold."""
    shards = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(shards, "l_suppkey").drop("l_suppkey")


@query("SELECT p_partkey, p_brand AS chrom, CASE WHEN p_size = 1 THEN 1 ELSE 0 END AS label FROM part WHERE p_partkey % 9 > 0 AND (p_size = 1 OR least(p_size / (p_partkey % 9 * 20), 1 - p_size / (p_partkey % 9 * 20)) >= 0.05)")
def s06_population_variants(spark, d):
    v = X.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("chrom"), S.allele_label(F.col("p_size"), F.col("p_partkey") % 9 * 20).cast("int").alias("label"))
    return v.where("label IS NOT NULL")


@query()
def m10_boundary_match(spark, d):
    """Letters N as true and T as found boundaries of contexts of 512 letters, by species."""
    s = X.samples(spark, d).select("species", F.col("sample_id").alias("contig"), "sequence")
    c = features.chunks(s.drop("species"), 512, 0).join(s.select("species", "contig"), "contig")
    return metrics.boundary_match(c.select("species", features.letter_places("seq", "N").alias("truth"), features.letter_places("seq", "T").alias("found")), ["species"], "truth", "found")
