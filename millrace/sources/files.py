"""Files by Spark's own file systems: staging, renaming, small texts; and the place of a row in its file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_filled(spark: SparkSession, path: str) -> bool:
    """Whether there is a file at ``path``, or a folder that holds something."""
    fs, p = _at(spark, path)
    return fs.exists(p) and (fs.getFileStatus(p).isFile() or len(fs.listStatus(p)) > 0)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename; an empty folder at ``target`` gives way."""
    fs, p = _at(spark, target)
    if fs.exists(p) and not fs.delete(p, False):
        raise OSError(f"{target} is in the way")
    fs.mkdirs(p.getParent())
    if not fs.rename(_at(spark, source)[1], p):
        raise OSError(f"{source} can't be renamed to {target}")


def staging_of(path: str) -> str:
    """A folder beside ``path``, so that renaming it is no copy; Spark's readers skip its name."""
    top, _, name = path.rstrip("/").rpartition("/")
    return f"{top}/.{name}.staging.{uuid.uuid4().hex}"


def write_named(df: DataFrame, path: str, stem: str, ending: str, **options: str) -> None:
    """One text column of ``df`` as files ``path``/<stem part><ending>, one for each partition; ``stem`` holds a star for the part."""
    spark, staged = df.sparkSession, staging_of(f"{path}/x")
    df.write.options(**options).text(staged)
    fs, p = _at(spark, staged)
    for status in fs.listStatus(p):
        if (name := status.getPath().getName()).startswith("part-"):
            move(spark, f"{staged}/{name}", f"{path}/{stem.replace('*', name[5:10])}{ending}")
    remove(spark, staged)


def in_file_order(raw: DataFrame) -> DataFrame:
    """``raw``, straight from a reader of files, with ``_file`` and ``_index``, the row's number in its file.

    Spark cuts files into byte ranges; a row's number is its place in its range and the rows of the ranges before (one count for each range).  Nothing is sorted.
    """
    rows = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_row", F.monotonically_increasing_id())
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    ranges = materialize(ranges.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    placed = rows.join(F.broadcast(ranges), ["_file", "_block"])  # a row for each range of a file
    return placed.withColumn("_index", F.col("_row") - F.col("_first") + F.col("_before")).drop("_block", "_row", "_first", "_before")
