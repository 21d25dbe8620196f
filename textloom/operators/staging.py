"""Tables written between jobs, in the folder that all executors share.

Cutting lineage this way survives the loss of executors. The folder is the
cluster's ``spark.checkpoint.dir``; only where that is unset, as in local
tests, a temporary folder of this machine takes its place.
"""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local: str | None = None


def shared_folder(spark: SparkSession) -> str:
    global _local
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local = _local or "file://" + tempfile.mkdtemp(prefix="textloom-")
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and read back from the shared folder. The files go when the session's JVM ends.

    ``counted`` tells their number without another job.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    _fs(spark, path)[0].deleteOnExit(_fs(spark, path)[1])
    out = spark.read.schema(df.schema).parquet(path)
    out._stage, out._seen = path, seen
    return out


def counted(df: DataFrame) -> int:
    """Rows of what ``written`` wrote."""
    return df._seen.get["n"]


def discard(df: DataFrame) -> None:
    """Delete what ``written`` wrote; nothing may read it later."""
    remove(df.sparkSession, df._stage)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
