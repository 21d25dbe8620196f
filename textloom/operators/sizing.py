"""How many partitions a table needs, by its size."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Sizes beyond this stand for "not known", as of rows that come from memory.
UNKNOWN = 1 << 60


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files a frame reads, all columns; None if they are not known. Looks at file listings only, runs no job."""
    found = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(found.apply(i).stats().sizeInBytes())) for i in range(found.size())]
    return None if not sizes or max(sizes) > UNKNOWN else sum(sizes)


def partitions(df: DataFrame, share: float = 0.5) -> int:
    """So many that each holds about ``share`` of the session's advisory partition size, and no fewer than its shuffle partitions.

    For what is grouped by hash, which leaves some partitions twice as large
    as others and which the engine cannot split later.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    if size is None:
        return least
    advised = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    return max(least, -(-size // max(1, int(advised * share))))
