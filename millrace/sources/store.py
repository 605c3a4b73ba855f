"""Tables that cut a plan's lineage, kept in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_ENDING: set[str] = set()


def _until_end(spark: SparkSession, path: str) -> None:
    """Make the application's folder, and have its file system delete it when the driver ends."""
    if path not in _ENDING:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _ENDING.add(path)


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below the application's own in ``spark.checkpoint.dir``; where that is unset, one is made and set in local mode, and a cluster is an error.

    The application's folder goes when its driver ends in order, with all tables in it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    own = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"
    _until_end(spark, own)
    return f"{own}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later stages survive lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
