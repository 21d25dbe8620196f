"""BM25, pseudo relevance feedback, and evaluation of rankings."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.config import DEFAULTS, Settings
from textloom.operators.index import Index
from textloom.operators.skew import salted_join

SCORE_DIGITS = 9


def weight(n_docs: Column, df: Column, tf: Column, qf: Column, s: Settings = DEFAULTS) -> Column:
    """Share of one term in a document's score; negative where more than half of the documents have the term."""
    idf = F.log((n_docs - df + 0.5) / (df + 0.5))
    return idf * ((s.k1 + 1) * tf) / (s.k1 * (1 - s.b) + tf) * ((s.k2 + 1) * qf) / (s.k2 + qf)


def ranking_terms(vocabulary: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(term, df) of the terms that count: those in no more than ``max_df`` documents."""
    return vocabulary.filter(F.col("df") <= settings.max_df).select("term", "df")


def scores(postings: DataFrame, vocabulary: DataFrame, stats: DataFrame, terms: Counter, settings: Settings = DEFAULTS) -> DataFrame:
    """(doc_id, score) of every document with a query term. Terms in more than ``max_df`` documents are left out.

    The terms of one query are literals: they reach the scan of the postings,
    and the vocabulary comes down to a row per term before it is joined.
    """
    spark = postings.sparkSession
    if not terms:
        return spark.createDataFrame([], "doc_id long, score double")
    asked = F.col("term").isin(list(terms))
    q = spark.createDataFrame(sorted(terms.items()), "term string, qf int")
    known = F.broadcast(ranking_terms(vocabulary, settings).filter(asked).join(F.broadcast(q), "term"))  # a row per query term
    hits = postings.filter(asked).select("term", "doc_id", "tf").join(known, "term")
    n = stats.select("n_docs").scalar()
    each = hits.select("doc_id", weight(n, F.col("df"), F.col("tf"), F.col("qf"), settings).alias("w"))
    return each.groupBy("doc_id").agg(F.round(F.sum("w"), SCORE_DIGITS).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best; of equal scores the smaller id."""
    return scored.orderBy(F.desc("score"), "doc_id").limit(max(k, 0))


def restricted(scored: DataFrame, allowed: DataFrame, mode: str = "semi") -> DataFrame:
    """Only the allowed documents; in mode ``union``, all scored ones and the allowed others with score 0."""
    if mode == "semi":
        return scored.join(allowed, "doc_id", "left_semi")
    return scored.unionByName(allowed.join(scored, "doc_id", "left_anti").select("doc_id", F.lit(0.0).alias("score")))


def batch(postings: DataFrame, vocabulary: DataFrame, stats: DataFrame, query_terms: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, rank, doc_id, score): top ``topk`` of many queries in one plan. ``query_terms``: (query_id, topk, term), a row per occurrence.

    Postings of a common term meet the queries in places by document. Each
    task keeps of a query no more than the largest ``topk`` before these rows
    move on to be ranked. Runs a job when it is called, for that number.
    """
    most = query_terms.agg(F.max("topk")).first()[0] or 0
    q = query_terms.groupBy("query_id", "topk", "term").agg(F.count(F.lit(1)).alias("qf"))
    known = q.join(ranking_terms(vocabulary, settings), "term")
    n = stats.select("n_docs").scalar()
    each = salted_join(postings.select("term", "doc_id", "tf"), known, "term", "doc_id")
    each = each.select("query_id", "topk", "doc_id", weight(n, F.col("df"), F.col("tf"), F.col("qf"), settings).alias("w"))
    scored = each.groupBy("query_id", "topk", "doc_id").agg(F.round(F.sum("w"), SCORE_DIGITS).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= most) & (F.col("rank") <= F.col("topk"))).select("query_id", "rank", "doc_id", "score")


def feedback_terms(index: Index, answers: DataFrame, terms: Counter, settings: Settings = DEFAULTS) -> DataFrame:
    """(term, count): new terms of the answers' texts, most frequent first, then by term. ``answers``: (answer)."""
    plain = F.regexp_replace("answer", r"\.\.\.", "")
    found = answers.select(F.explode(F.transform(index.analysis.words(plain), index.analysis.term)).alias("term"))
    new = found.filter(~F.col("term").isin(list(terms))) if terms else found
    return new.groupBy("term").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "term").limit(settings.feedback_terms)


def gain(x: Column) -> Column:
    return F.floor(F.lit(10.0) * F.pow(F.lit(0.5), F.lit(0.1) * x))


def _discounted(g: Column, rank: Column) -> Column:
    return F.lit(1.0) + F.when(rank == 1, g.cast("double")).otherwise(g / F.log(rank.cast("double")))


def ndcg(ranking: DataFrame, gold: DataFrame, at: DataFrame) -> DataFrame:
    """(query_id, ndcg).

    ``ranking``: (query_id, rank, title); ``gold``: (query_id, rank, title); ``at``: (query_id, at).
    Only the gain is discounted, not the 1, so that the value may exceed 1. A
    title counts with its best gold rank; a rank without gold title adds
    nothing. ``at`` of 0 or less gives NaN.
    """
    best = gold.filter("title IS NOT NULL").groupBy("query_id", "title").agg(F.min("rank").alias("g"))
    hits = ranking.join(at, "query_id").filter(F.col("rank").between(F.lit(1), F.col("at"))).join(best, ["query_id", "title"])
    dcg = hits.groupBy("query_id").agg(F.sum(_discounted(gain(F.col("g")), F.col("rank"))).alias("dcg"))
    ranks = at.filter("at > 0").select("query_id", F.explode(F.sequence(F.lit(1), F.col("at"))).alias("rank"))
    ideal = ranks.groupBy("query_id").agg(F.sum(_discounted(gain(F.col("rank")), F.col("rank"))).alias("idcg"))
    both = at.join(ideal, "query_id", "left").join(dcg, "query_id", "left")
    value = F.when(F.col("at") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(F.lit(float("nan")))
    return both.select("query_id", F.round(value, SCORE_DIGITS).alias("ndcg"))
