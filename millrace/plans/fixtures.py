"""Views over the test tables, defined alike for Spark (functions) and DuckDB (common table expressions)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import hash_bucket


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OTHERS = bytes(b for b in range(256) if b not in b"ACGTN")


def letters(text: str) -> Column:
    """The letters A, C, G, T, N of an upper-cased text; one Arrow pass, as a regular expression costs far more and is evaluated again by the filter on it."""

    @F.pandas_udf("string")
    def left(parts: pd.Series) -> pd.Series:
        return parts.map(lambda t: None if t is None else t.upper().encode("utf-8", "surrogatepass").translate(None, _OTHERS).decode())

    return left(F.col(text))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as DNA samples: the letters A, C, G, T, N of the text, split by hash."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sid = F.col("doc_id").cast("string")
    b = hash_bucket(F.concat(F.lit("42|"), sid), 10)
    rows = docs.join(labels, "doc_id", "left").select(
        sid.alias("sample_id"), F.col("doc_id").alias("row_no"), F.when(b < 2, "test").when(b < 4, "validation").otherwise("train").alias("split"),
        letters("text").alias("sequence"), F.col("quality").cast("double").alias("label"), F.col("source").alias("group_id"), F.col("lang").alias("species"),
    )
    return rows.where("sequence <> ''")


def pred_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    s = F.round(1 / (1 + F.exp(-F.get("embedding", F.lit(0)).cast("double"))), 2)
    return e.select((F.col("vec_id") % 3).alias("run_key"), F.col("vec_id").alias("row_no"), (F.col("label") < 5).cast("double").alias("label"), s.alias("score"))


def pred_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").withColumn("seed", F.explode(F.array(*map(F.lit, range(5)))))
    scores = F.slice(F.col("embedding"), F.col("seed") * 10 + 1, F.lit(10))
    return e.select("seed", F.col("vec_id").alias("row_no"), F.col("label").cast("long").alias("label"), (F.array_position(scores, F.array_max(scores)) - 1).alias("pred"))


def pred_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run_key"), F.col("l_extendedprice").cast("double").alias("label"), (F.col("l_quantity").cast("double") * 1000).alias("score"))


def pred_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") % 4).alias("run_key"), F.col("l_orderkey").alias("group_id"), (F.col("l_linenumber") == 1).cast("int").alias("label"), F.col("l_discount").cast("double").alias("score"), F.struct("l_partkey", "l_suppkey", "l_linenumber").alias("row_no"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price by nation (model), priority (task) and order key modulo 5 (seed)."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    task = F.col("o_orderpriority")
    return j.groupBy(F.col("n_name").alias("model_id"), task.alias("task_id"), (F.col("o_orderkey") % 5).alias("seed")).agg(F.round(F.avg(F.col("o_totalprice").cast("double")) / 500000, 6).alias("value")).withColumn("category", F.substring("task_id", 1, 1).cast("int") % 2)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("shard"), F.concat_ws(",", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("window_id"), (F.lit(4096) * F.pow(F.lit(2), F.col("l_linenumber") % 5)).cast("long").alias("length"), (F.col("l_partkey") % 7).alias("region"))


SQL = {
    "v_samples": """SELECT doc_id::VARCHAR AS sample_id, doc_id AS row_no, CASE WHEN b < 2 THEN 'test' WHEN b < 4 THEN 'validation' ELSE 'train' END AS split, sequence, quality::DOUBLE AS label, source AS group_id, lang AS species
      FROM (SELECT *, ('0x' || substr(sha256('42|' || doc_id::VARCHAR), 1, 8))::BIGINT % 10 AS b, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS sequence FROM documents LEFT JOIN labels USING (doc_id)) WHERE sequence <> ''""",
    "v_pred_bin": "SELECT vec_id % 3 AS run_key, vec_id AS row_no, (label < 5)::INT::DOUBLE AS label, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 2) AS score FROM embeddings WHERE label IS NOT NULL",
    "v_pred_multi": "SELECT seed, vec_id AS row_no, label::BIGINT AS label, list_position(s, list_max(s)) - 1 AS pred FROM (SELECT *, embedding[seed * 10 + 1 : seed * 10 + 10] AS s FROM embeddings, range(5) AS r(seed) WHERE label IS NOT NULL)",
    "v_pred_reg": "SELECT l_returnflag AS run_key, l_extendedprice::DOUBLE AS label, l_quantity::DOUBLE * 1000 AS score FROM lineitem",
    "v_pred_rank": "SELECT l_orderkey % 4 AS run_key, l_orderkey AS group_id, (l_linenumber = 1)::INT AS label, l_discount::DOUBLE AS score, (l_partkey, l_suppkey, l_linenumber) AS row_no FROM lineitem",
    "v_results": "SELECT *, substr(task_id, 1, 1)::INT % 2 AS category FROM (SELECT n_name AS model_id, o_orderpriority AS task_id, o_orderkey % 5 AS seed, round(avg(o_totalprice::DOUBLE) / 500000, 6) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)",
    "v_windows": "SELECT l_suppkey AS shard, concat_ws(',', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS window_id, (4096 * 2 ** (l_linenumber % 5))::BIGINT AS length, l_partkey % 7 AS region FROM lineitem",
}


def with_views(body: str) -> str:
    """``body`` after the definitions of the views that it names."""
    used = [f"{k} AS ({v})" for k, v in SQL.items() if k in body]
    return f"WITH {', '.join(used)} {body}" if used else body
