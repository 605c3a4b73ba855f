"""The tables of ``sf_dir``, and the library's tables in the shared folder under the names used here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import materialize, shared_dir

__all__ = ["materialize", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
