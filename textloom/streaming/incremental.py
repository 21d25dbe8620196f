"""Postings of documents that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.index import Analysis, documents, postings


def append_postings(arriving: DataFrame, analysis: Analysis, folder: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Writes postings of a stream (doc_id, title, text), a folder per batch, so that a batch that is run again replaces itself.

    A document is expected once; readers of the folder aggregate over all
    batches. Each batch is planned like a table, with its own shuffle.
    """

    def batch(rows: DataFrame, number: int) -> None:
        lists = postings(documents(rows), analysis)
        lists.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream = arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def arrivals(events: DataFrame, at: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window, n): rows per window of event time, as a stream; rows later than ``late`` are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("window")).agg(F.count(F.lit(1)).alias("n"))
