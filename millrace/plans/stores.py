"""Queries that write files from the test tables to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequences import hash_bucket
from ..operators import features, heads, metrics, quality
from ..sources import readers
from ..sources.store import shared_dir
from ..streaming import logs
from . import fixtures as X
from .registry import query


@query("SELECT doc_id AS row_no, source AS group_id, lang AS species, text AS sequence FROM documents")
def s04_parquet_samples(spark, d):
    return readers.read_parquet_samples(spark, f"{d}/documents.parquet", {"row_no": "doc_id", "group_id": "source", "species": "lang", "sequence": "text"})


@query("SELECT (l_suppkey % 5)::VARCHAR AS chrom, l_partkey AS pos, l_linestatus AS ref, l_returnflag AS alt, max((l_linenumber = 1)::INT) AS label FROM lineitem GROUP BY ALL")
def s07_gwas_hits(spark, d):
    """Odd lines under one header, even ones under the other, gzipped."""
    li, path = X.table(spark, d, "lineitem"), shared_dir(spark)
    said = F.when(F.col("l_linenumber") == 1, "True").otherwise("false")
    for odd, names in enumerate(readers.HIT_COLUMNS):
        part = li.where(F.col("l_linenumber") % 2 == odd).select(F.col("l_suppkey") % 5, "l_partkey", "l_linestatus", "l_returnflag", said)
        order = part.toDF(*names, "overPermutation") if odd else part.toDF(*names, "overPermutation").select("overPermutation", *[f"`{n}`" for n in reversed(names)])
        order.write.mode("append").option("header", True).option("compression", "gzip").csv(path)
    return readers.read_gwas_hits(spark, path)


_PLAN = "plan-1"


def _receipts(spark, d):
    """A receipt for each order as a line: every 7th cut off, every 5th of another plan, every 11th with a wrong hash, every 13th not ok."""
    o, path = X.table(spark, d, "orders"), shared_dir(spark)
    key = F.col("o_orderkey")
    x = o.select(key, key.cast("string").alias("run_key"), F.when(key % 13 == 0, "failed").otherwise("ok").alias("status"), F.when(key % 5 == 0, "plan-0").otherwise(_PLAN).alias("plan_sha256"), F.array(F.struct(F.col("o_custkey").cast("string").alias("path"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("sha256"))).alias("artifacts"))
    text = readers.receipt_text("artifacts", "plan_sha256", "run_key", "status")
    x = x.withColumn("receipt_sha256", F.sha2(F.when(key % 11 == 0, F.concat(text, F.lit(" "))).otherwise(text), 256))
    line = F.to_json(F.struct("artifacts", "plan_sha256", "receipt_sha256", "run_key", "status"))
    x.select(F.when(key % 7 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return readers.read_receipts(spark, path)


_BODY = """'{"artifacts":[{"path":"' || o_custkey || '","sha256":"' || sha256(o_custkey::VARCHAR) || '"}],"plan_sha256":"' || CASE WHEN o_orderkey % 5 = 0 THEN 'plan-0' ELSE 'plan-1' END || '","run_key":"' || o_orderkey || '","status":"' || CASE WHEN o_orderkey % 13 = 0 THEN 'failed' ELSE 'ok' END || '"}'"""


@query(f"SELECT o_orderkey::VARCHAR AS run_key, CASE WHEN o_orderkey % 13 = 0 THEN 'failed' ELSE 'ok' END AS status, sha256({_BODY}) AS own_sha256 FROM orders WHERE o_orderkey % 7 <> 0")
def s15_read_receipts(spark, d):
    return _receipts(spark, d).select("run_key", "status", "own_sha256")


@query("SELECT o_orderkey::VARCHAR AS run_key, CASE WHEN o_orderkey % 13 = 0 THEN 'status' WHEN o_orderkey % 5 = 0 THEN 'plan' WHEN o_orderkey % 11 = 0 THEN 'self_hash' WHEN c_custkey IS NULL OR c_custkey % 9 = 0 THEN 'artifact' ELSE 'ok' END AS state FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 <> 1 WHERE o_orderkey % 7 <> 0")
def q06_verify_receipts(spark, d):
    c = X.table(spark, d, "customer").where("c_custkey % 4 <> 1")
    key = F.col("c_custkey").cast("string")
    return quality.verify_receipts(_receipts(spark, d), _PLAN, c.select(key.alias("path"), F.sha2(F.when(F.col("c_custkey") % 9 == 0, F.lit("other")).otherwise(key), 256).alias("sha256")))


@query("""SELECT path, CASE WHEN NOT f THEN 'missing' WHEN NOT m THEN 'unlisted' WHEN doc_id % 11 = 0 THEN 'size' ELSE 'sha256' END AS finding FROM (SELECT doc_id, 'd/' || doc_id AS path, doc_id % 5 <> 0 AS m, doc_id % 7 <> 0 AS f FROM documents WHERE text IS NOT NULL)
  WHERE (m OR f) AND (NOT m OR NOT f OR doc_id % 11 = 0 OR doc_id % 13 = 0)""")
def q05_verify_artifacts(spark, d):
    t = X.table(spark, d, "documents").where("text IS NOT NULL")
    a = t.select("doc_id", F.concat(F.lit("d/"), "doc_id").alias("path"), F.octet_length("text").alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
    changed = a.withColumns({"size_bytes": F.col("size_bytes") + (F.col("doc_id") % 11 == 0).cast("int"), "sha256": F.when(F.col("doc_id") % 13 == 0, F.reverse("sha256")).otherwise(F.col("sha256"))})
    return quality.verify_artifacts(changed.where("doc_id % 5 <> 0"), a.where("doc_id % 7 <> 0"))


@query("SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL")
def s18_embeddings(spark, d):
    e, path = X.table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", "label", "embedding"), shared_dir(spark)
    for part in range(2):
        readers.append_embeddings(e.where(F.col("vec_id") % 2 == part), path)
    return readers.read_embeddings(spark, path, 64, e.count())


_EVALS = "SELECT user_id AS run_key, event_id AS step, round(value, 4) AS value FROM events"


@query(f"SELECT run_key, step, value, b IS NULL OR value < b AS new, best, n - max(CASE WHEN b IS NULL OR value < b THEN n END) OVER (PARTITION BY run_key ORDER BY step) AS stale FROM (SELECT *, min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(value) OVER (w ROWS UNBOUNDED PRECEDING) AS best, row_number() OVER w AS n FROM ({_EVALS}) WINDOW w AS (PARTITION BY run_key ORDER BY step))")
def st02_best_so_far(spark, d):
    """The events in two halves by id, each as it arrives: the second query starts from the first one's checkpoint."""
    e = X.table(spark, d, "events").selectExpr("user_id AS run_key", "event_id AS step", "round(value, 4) AS value")
    middle = e.agg(F.avg("step")).first()[0] or 0
    path = shared_dir(spark)
    for half in (F.col("step") <= middle, F.col("step") > middle):
        e.where(half).write.mode("append").parquet(f"{path}/in")
        rows = logs.best_so_far(spark.readStream.schema(e.schema).parquet(f"{path}/in"))
        rows.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL")
def st04_append_vectors(spark, d):
    e, path = X.table(spark, d, "embeddings"), shared_dir(spark)
    stream = spark.readStream.schema(e.schema).parquet(f"{d}/embeddings.parque[t]").where("embedding IS NOT NULL").select("vec_id", "label", "embedding")
    logs.append_vectors(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return readers.read_embeddings(spark, f"{path}/out", 64, e.where("embedding IS NOT NULL").count()).drop("batch")


_REGION = "list_value('intergenic', 'CDS', 'intron', 'three_prime_UTR', 'five_prime_UTR', 'ncRNA_gene', 'Repeat')"


@query(f"""SELECT substr(sha256('D01|' || sample_id || '|' || a || '|' || (a + 50)), 1, 24) AS sample_id, 'test' AS split, substr(sequence, a + 1, 50) AS sequence, (a // 30 % 7)::INT AS label, {_REGION}[a // 30 % 7 + 1] AS class_name, sample_id AS group_id
  FROM (SELECT sample_id, sequence, unnest(range(0, length(sequence), 30)) AS a FROM v_samples) WHERE a + 50 <= length(sequence)""")
def s08_region_windows(spark, d):
    """A window of 50 letters every 30, of each region in turn, written as a table of windows."""
    s, path = X.samples(spark, d), shared_dir(spark)
    w = s.select("sample_id", F.explode(F.sequence(F.lit(0), F.length("sequence") - 1, F.lit(30))).alias("a"))
    names = F.array(*map(F.lit, readers.REGIONS))
    w.select(F.concat(F.lit("Chr"), "sample_id").alias("chrom"), F.col("a").alias("center_start"), (F.col("a") + 50).alias("center_end"), F.get(names, (F.col("a") / 30).cast("int") % 7).alias("Region")).write.parquet(path)
    return readers.read_region_windows(spark, path, features.chunks(s.select(F.col("sample_id").alias("contig"), "sequence"), 256, 64), 256, 64)


def _token_cache(spark, d):
    """Each vector as 16 tokens of four values: the class is the greatest value's place, and 255 where the first is negative and the second too."""
    e, path = X.table(spark, d, "embeddings").where("embedding IS NOT NULL"), shared_dir(spark)
    hidden = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    label = F.transform("hidden", lambda h: F.when((h[0] < 0) & (h[1] < 0), heads.IGNORED).otherwise(F.array_position(h, F.array_max(h)).cast("int") - 1))
    b = hash_bucket(F.concat(F.lit("42|"), F.col("vec_id").cast("string")), 10)
    e.select(F.col("vec_id").alias("sample_id"), F.when(b < 2, "test").when(b < 4, "validation").otherwise("train").alias("split"), hidden.alias("hidden")).withColumn("labels", label).write.parquet(path)
    return readers.read_token_cache(spark, path)


@query("""SELECT sample_id, split, pos, CASE WHEN h[1] < 0 AND h[2] < 0 THEN 255 ELSE list_position(h, list_max(h)) - 1 END::INT AS label FROM (SELECT vec_id AS sample_id, pos::INT AS pos, embedding[pos * 4 + 1 : pos * 4 + 4] AS h,
  CASE WHEN b < 2 THEN 'test' WHEN b < 4 THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, ('0x' || substr(sha256('42|' || vec_id::VARCHAR), 1, 8))::BIGINT % 10 AS b FROM embeddings WHERE embedding IS NOT NULL), range(16) r(pos))""")
def s19_token_cache(spark, d):
    return _token_cache(spark, d).drop("embedding")


@query("""SELECT split, round(sum(h) / sum(t), 9) AS accuracy, round(avg(CASE WHEN t > 0 THEN h / t END), 9) AS balanced_accuracy, round(avg(2 * h / (t + p)), 9) AS macro_f1, round((sum(h) * sum(t) - sum(t * p)) / (sqrt(sum(t) * sum(t) - sum(p * p)) * sqrt(sum(t) * sum(t) - sum(t * t))), 9) AS mcc FROM
  (WITH x AS MATERIALIZED (SELECT split, list_position(h, list_max(h)) AS label, list_position(g, list_max(g)) AS pred FROM (SELECT split, h, list_transform(h, lambda v: abs(v)) AS g FROM (SELECT embedding[pos * 4 + 1 : pos * 4 + 4] AS h,
    CASE WHEN b < 2 THEN 'test' WHEN b < 4 THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, ('0x' || substr(sha256('42|' || vec_id::VARCHAR), 1, 8))::BIGINT % 10 AS b FROM embeddings WHERE embedding IS NOT NULL), range(16) r(pos))) WHERE NOT (h[1] < 0 AND h[2] < 0))
   SELECT split, c, sum(t)::DOUBLE AS t, sum(p)::DOUBLE AS p, sum(h)::DOUBLE AS h FROM (SELECT split, label AS c, 1 AS t, 0 AS p, (label = pred)::INT AS h FROM x UNION ALL SELECT split, pred, 0, 1, 0 FROM x) GROUP BY ALL) GROUP BY split""")
def m10_token_metrics(spark, d):
    """The place of the greatest magnitude as the prediction of each token's class."""
    size = F.transform("embedding", lambda v: F.abs(v))
    t = _token_cache(spark, d).withColumn("pred", F.array_position(size, F.array_max(size)).cast("int") - 1)
    return metrics.token_metrics(t, ["split"]).select("split", *[F.round(c, 9).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "mcc")])


@query()
def f10_token_head(spark, d):
    return heads.token_head(_token_cache(spark, d)).select("sample_id", "pos", "label", "pred")
