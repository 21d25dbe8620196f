"""Row numbers over a whole result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.staging import written

_ROW_BITS = 33  # of monotonically_increasing_id: the row in its partition


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with numbers from 1 in a total order, without bringing it to one task.

    Rows are sorted by range; each partition numbers its own, and what is
    summed up in one place is a row per partition. Runs a job when called.
    """
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _ROW_BITS).alias("_part_")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_size"))
    w = Window.orderBy("_part_").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part_", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_part_", part).join(F.broadcast(before), "_part_")  # a row per partition
    return placed.select((F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1).cast("int").alias(name), *df.columns)
