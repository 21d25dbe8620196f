"""Writers."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("textloom")


def mediawiki(pages: DataFrame, path: str) -> None:
    """(title, ns, id, redirect, text) as a dump that ``readers.mediawiki`` reads."""
    rows = pages.select("title", "ns", "id", "redirect", F.struct(F.lit(None).cast("long").alias("id"), F.col("text")).alias("revision"))
    rows.write.mode("overwrite").format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)


def append_log(spark: SparkSession, text: str, folder: str) -> None:
    """Adds a block to a log: a text file of its own in the folder, so that writers at the same time lose nothing."""
    spark.createDataFrame([(text + "\n",)], "block string").coalesce(1).write.mode("append").text(folder)


def result_log(query: str, seconds: float, results: DataFrame, ndcg: float | None, k: int) -> str:
    """A log block of one search: query, time, ranking, quality. ``results`` has at most k rows, or the links of one title."""
    lines = [f"query: {query}", f"seconds: {seconds:.3f}"]
    lines += [f"{r.rank}. {r.title}" for r in results.orderBy("rank").limit(max(k, 0)).collect()]
    if ndcg is not None:
        lines.append(f"ndcg@{k}: {ndcg:.6f}")
    text = "\n".join(lines)
    log.info(text)
    return text
