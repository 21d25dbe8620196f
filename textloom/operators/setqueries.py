"""Queries that give sets of documents: terms, prefixes, phrases, links, and their combinations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.config import DEFAULTS, Settings
from textloom.functions import wikitext
from textloom.operators.index import Index
from textloom.plans import parser


def nothing(index: Index) -> DataFrame:
    return index.spark.createDataFrame([], index.postings.select("doc_id").schema)


def term(index: Index, text: str) -> DataFrame:
    """Documents with the first analysed term of a text."""
    terms = index.analysis.terms(index.spark, text)
    return index.postings.filter(F.col("term") == terms[0]).select("doc_id") if terms else nothing(index)


def prefix(index: Index, start: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Documents with one of the first terms that begin so; if none does, with one that begins as the analysed prefix."""

    def some(p: str) -> DataFrame:
        return index.vocabulary.filter(F.col("term").startswith(p)).orderBy("term").limit(settings.prefix_terms).select("term")

    if not start:
        return nothing(index)
    found = some(start.lower())
    if found.isEmpty():
        terms = index.analysis.terms(index.spark, start)
        if not terms:
            return nothing(index)
        found = some(terms[0])
    return index.postings.join(F.broadcast(found), "term", "left_semi").select("doc_id").distinct()  # at most prefix_terms rows


def phrase(index: Index, text: str) -> DataFrame:
    """Documents in which the terms of a text follow each other; terms may repeat."""
    terms = index.analysis.terms(index.spark, text)
    return phrase_of(index.postings, terms) if terms else nothing(index)


def phrase_of(postings: DataFrame, terms: list[str]) -> DataFrame:
    """One scan: each position votes for the place where the phrase would begin, and only a place with all votes counts."""
    if len(terms) == 1:
        return postings.filter(F.col("term") == terms[0]).select("doc_id")
    offsets: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        offsets.setdefault(t, []).append(i)
    shifts = reduce(lambda c, kv: c.when(F.col("term") == kv[0], F.array(*map(F.lit, kv[1]))), list(offsets.items())[1:], F.when(F.col("term") == terms[0], F.array(*map(F.lit, offsets[terms[0]]))))
    votes = postings.filter(F.col("term").isin(list(offsets))).select("doc_id", "positions", F.explode(shifts).alias("shift"))
    starts = votes.select("doc_id", "shift", F.explode(F.transform("positions", lambda p: p - F.col("shift"))).alias("start"))
    whole = starts.groupBy("doc_id", "start").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(terms))
    return whole.select("doc_id").distinct()


def linking(links: DataFrame, documents: DataFrame, title: str) -> DataFrame:
    """(doc_id, source_norm): documents that link to a title, with the least title they link under.

    A linking title stands for the document that bears it; of several with one
    title, for the last read.
    """
    target = F.translate(F.lower(wikitext.trim(F.lit(title))), wikitext.KEY_DROPS, "")
    sources = links.filter(F.col("target_norm") == target).select("source_norm").distinct()
    bearing = documents.select("norm_title", "doc_id", "seq").join(sources, F.col("norm_title") == F.col("source_norm"))
    bearer = bearing.groupBy("source_norm").agg(F.max_by("doc_id", "seq").alias("doc_id"))
    return bearer.groupBy("doc_id").agg(F.min("source_norm").alias("source_norm"))


def evaluate(index: Index, tree) -> DataFrame:
    """(doc_id), distinct, of a tree of the query language without ranking."""
    match tree:
        case parser.And(a, b):
            return evaluate(index, a).intersect(evaluate(index, b))
        case parser.Or(a, b):
            return evaluate(index, a).union(evaluate(index, b)).distinct()
        case parser.ButNot(a, b):
            return evaluate(index, a).subtract(evaluate(index, b))
        case parser.Prefix(text):
            return prefix(index, text)
        case parser.Phrase(text):
            return phrase(index, text)
        case parser.Term(text):
            return term(index, text)
        case parser.Link(title):
            return linking(index.links, index.documents, title).select("doc_id")
    raise TypeError(f"no set query: {tree!r}")
