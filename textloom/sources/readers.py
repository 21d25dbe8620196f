"""Readers: MediaWiki XML dumps, stop-word lines, result pages, head samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What is read of a page. The first id of a page is its own; those of revision and contributor are nested.
DUMP = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("ns", T.IntegerType()),
        T.StructField("id", T.LongType()),
        T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])),
        T.StructField("revision", T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])),
    ]
)


def mediawiki(spark: SparkSession, path: str) -> DataFrame:
    """(title, ns, id, redirect, text) of every page element, in any order of its fields.

    ``redirect`` is a struct where the element is there, with or without a
    title, else null. Elements that are missing give null.
    """
    pages = spark.read.format("xml").option("rowTag", "page").option("nullValue", "").option("ignoreSurroundingSpaces", False).schema(DUMP).load(path)
    return pages.select("title", "ns", "id", "redirect", F.col("revision.text").alias("text"))


def articles(pages: DataFrame) -> DataFrame:
    """(doc_id, title, text) of namespace 0, without redirects, with id, title and text."""
    from textloom.operators.pages import article_flag

    return pages.filter(article_flag() & F.col("id").isNotNull()).select(F.col("id").alias("doc_id"), "title", "text")


def stop_words(lines: DataFrame, *, literal: bool = False) -> list[str]:
    """Entries of the first line of a table (line_no, line): one row, however large the collection."""
    from textloom.functions.analyzer import parse_stop_words

    first = lines.orderBy("line_no").select("line").first()
    return parse_stop_words(first.line if first else "", literal=literal)


def stop_word_rows(lines: DataFrame) -> DataFrame:
    """(word): the same as rows."""
    words = lines.select(F.explode(F.split("line", ",")).alias("w")).select(F.lower(F.trim("w")).alias("word"))
    return words.filter("word <> ''").distinct()


def gold_titles(pages: DataFrame) -> DataFrame:
    """(query, rank, title): of result pages (query, html) the first title attribute of every line that begins a list item, in order."""
    lines = pages.select("query", F.posexplode(F.split("html", "\n")).alias("at", "line"))
    found = lines.filter(F.col("line").startswith("<li>") & F.col("line").rlike('title="[^"]*"'))
    titles = found.select("query", "at", F.regexp_extract("line", 'title="([^"]*)"', 1).alias("title"))
    ranked = titles.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("at", "title"))).alias("ts"))
    return ranked.select("query", F.posexplode("ts").alias("n", "t")).select("query", (F.col("n") + 1).alias("rank"), "t.title")


def gold_cached(pages: DataFrame, folder: str) -> DataFrame:
    """``gold_titles`` of the queries of ``pages``, kept in a folder: only queries that are not there yet are worked out, and added.

    A query whose page has no title is kept as one row with null rank and
    title, so that it is not asked for again, and comes out as no row.
    """
    spark = pages.sparkSession
    kind = "query string, rank int, title string"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    new = pages.filter("query IS NOT NULL")
    if there:
        new = new.join(spark.read.schema(kind).parquet(folder).select("query").distinct(), "query", "left_anti")
    found = gold_titles(new)
    (new.select("query").distinct().join(found, "query", "left").select("query", "rank", "title").write.mode("append").parquet(folder))
    asked = pages.select("query").distinct()
    return spark.read.schema(kind).parquet(folder).filter("rank IS NOT NULL").join(asked, "query", "left_semi")


def head(spark: SparkSession, path: str, n: int = 2001) -> DataFrame:
    """The first n lines of one text file, as a sample of a dump."""
    return spark.read.text(path).limit(n)
