"""Frequency of every distinct term over a collection, with bounds for use."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.words import words


def term_counts(records: DataFrame, text: str = "text") -> DataFrame:
    """(term, occurrences, records): every distinct word, how often it occurs and in how many records.

    A record's words are sorted in place, so the first of each run marks the
    record as having the word: no table of (record, word) is ever built or
    moved. Counts are combined by hash in each task before the one shuffle by
    term, so a word that is everywhere arrives as one row per task. Null and
    empty texts, and texts without words, add nothing; equal records count
    each; other columns are not read.
    """
    ordered = records.select(F.sort_array(words(F.col(text))).alias("_w"))
    marked = F.transform("_w", lambda w, i: F.struct(w.alias("term"), ((i == 0) | (F.get("_w", i - 1) != w)).alias("first")))
    each = ordered.select(F.explode(marked).alias("_t")).select("_t.term", "_t.first")
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("occurrences"), F.sum(F.col("first").cast("bigint")).alias("records"))


def mark(counts: DataFrame, n_records: Column, *, least: int = 3, most: str = "0.4") -> DataFrame:
    """Adds ``mark``: ``rare`` in fewer than ``least`` records, ``common`` in more than ``most`` of all, else null (rare comes first)."""
    common = F.col("records") > F.lit(Decimal(most)) * n_records
    return counts.withColumn("mark", F.when(F.col("records") < least, "rare").when(common, "common"))
