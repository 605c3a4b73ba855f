"""Sharding into contiguous shards of near equal bytes, by global prefix sums from per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row, in the order of doc_id (then of the scan).

    Size is the text's UTF-8 bytes plus 1 (null: 1).  The rows are sorted by range once; the totals of the ranges, one row for each
    partition, give every range its first byte and row, and running sums inside the ranges do the rest.  A row belongs to the
    shard in which its middle byte falls, so a shard is off the mean by at most one row.  Rows with a null doc_id come first; repeated
    rows follow the scan.  No range holds more than its part of the rows, however many share a doc_id.  An empty table gives no rows.
    """
    # The scan's row number breaks ties, so that one doc_id can spread over ranges.
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    slim = materialize(slim.withColumn("row", F.monotonically_increasing_id()))
    ranged = slim.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    ranged = materialize(ranged.withColumn("range_no", F.spark_partition_id()))
    totals = ranged.groupBy("range_no").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range: as many as there are partitions, however many rows they hold.
    starts = materialize(totals.select("range_no", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0")))
    total = totals.agg(F.sum("bytes")).first()[0] or 1
    inside = Window.partitionBy("range_no").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumns({"upto": F.sum("size").over(inside), "nth": F.count(F.lit(1)).over(inside)}).join(F.broadcast(starts), "range_no")
    middle = 2 * (F.col("byte0") + F.col("upto")) - F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / F.lit(2 * total).cast("decimal(38,0)"))).cast("int")
    placed = materialize(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("row0") + F.col("nth") - 1).alias("position")))
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"))


def shard_digest(docs: DataFrame) -> DataFrame:
    out = shard_documents(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

