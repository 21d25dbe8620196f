"""Pages tied together by titles spelled alike and by redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.wikitext import title_key
from textloom.llm.components import components
from textloom.operators.pages import current
from textloom.operators.skew import spread_join
from textloom.operators.staging import written


def title_groups(page: DataFrame) -> DataFrame:
    """(id, group_id): the pages of each group of two or more, with the least id of the group.

    Over current rows with a non-empty title. Pages of one title key stand in
    the graph as one vertex, and a key or redirect title that a third of all
    pages share is folded, or its rows stay where they are and meet the little
    there is to know of it; a redirect whose title no page bears, or is null,
    ties nothing. An empty table gives no rows.
    """
    there = F.length("title") > 0
    rows = current(page, key=F.when(there, title_key(F.col("title"))), to=F.when(there, title_key(F.col("redirect._title"))))
    rows = written(rows.filter("key IS NOT NULL"))
    keys = rows.groupBy("key").agg(F.min("id").alias("vertex"), F.count(F.lit(1)).alias("n"))
    ties = written(rows.filter("`to` <> key").select("key", "to").distinct())
    u = keys.select("key", F.col("vertex").alias("u"))
    v = keys.select(F.col("key").alias("to"), F.col("vertex").alias("v"))
    near = spread_join(ties, v, ["to"])
    linked = components(near.join(u, "key").select("u", "v"))
    # a vertex is its key's least id, so the least vertex of a component is its least id
    of = keys.join(linked, "vertex", "left").select("key", F.coalesce("component", "vertex").alias("group_id"), ((F.col("n") > 1) | F.col("component").isNotNull()).alias("tied"))
    return spread_join(rows.select("id", "key"), of.filter("tied").drop("tied"), ["key"]).select("id", "group_id")
