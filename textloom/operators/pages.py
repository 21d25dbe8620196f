"""Current states of pages, and articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.sizing import partitions


def latest_rows(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """One row per key: the first by ``newest_first``.

    Rows with a null key are left out. One shuffle by key carries the columns
    that are still there, so project before. Rows that tie come out once, any
    one of them.
    """
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    nth = "_nth"
    while nth in df.columns:
        nth += "_"
    return df.withColumn(nth, F.row_number().over(w)).filter(F.col(nth) == 1).drop(nth)


def article_flag() -> Column:
    """Namespace 0, no redirect element at all, title and text there and not empty."""
    there = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    return (F.coalesce(F.col("ns") == 0, F.lit(False)) & F.col("redirect").isNull() & there(F.col("title")) & there(F.col("text")))


def current(page: DataFrame, **columns: Column) -> DataFrame:
    """Current rows (highest revision per id): ``id`` and the columns asked for.

    The columns are computed before the shuffle, so only what is needed of a
    row moves. Extra columns of the table are not touched; rows without id
    drop out; an empty table gives an empty result.
    """
    rows = page.select("id", F.col("revision.id").alias("_rev"), F.col("loaded_at").alias("_at"), *(c.alias(k) for k, c in columns.items()))
    return latest_rows(rows, ["id"], [F.desc_nulls_last("_rev"), F.asc_nulls_last("_at")]).drop("_rev", "_at")


def bucketed(rows: DataFrame, key: str, n: int, buckets: int = 1) -> DataFrame:
    """Adds ``_bucket``, a hash of the key, and partitions by it: n partitions of about so many buckets each."""
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(n * buckets)).cast("int")).repartition(n, "_bucket")


def article_buckets(page: DataFrame, buckets: int = 4) -> DataFrame:
    """(_bucket, id, text) of the articles, moved once: the shuffle by bucket also brings the states of a page together. The number of partitions follows the size of the table."""
    flag = article_flag()
    rows = page.filter(F.col("id").isNotNull()).select(
        "id", F.col("revision.id").alias("_rev"), F.col("loaded_at").alias("_at"), flag.alias("_ok"), F.when(flag, F.col("text")).alias("text")
    )
    newest = [F.desc_nulls_last("_rev"), F.asc_nulls_last("_at")]
    return latest_rows(bucketed(rows, "id", partitions(page), buckets), ["_bucket", "id"], newest).filter("_ok").select("_bucket", "id", "text")


def articles(page: DataFrame, **columns: Column) -> DataFrame:
    """Articles: ``id`` and the columns asked for (``text`` by default).

    Whether a row can be an article is decided before the shuffle, and the
    columns of rows that cannot are nulled there, so that they weigh nothing;
    such a row still takes part, as it may replace an older state.
    """
    columns = columns or {"text": F.col("text")}
    flag = article_flag()
    rows = current(page, _ok=flag, **{k: F.when(flag, c) for k, c in columns.items()})
    return rows.filter("_ok").drop("_ok")
