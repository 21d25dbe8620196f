"""The search facade: open or build an index, search, evaluate."""

from __future__ import annotations

import time
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.config import DEFAULTS, Settings
from textloom.functions.snippet import snippet
from textloom.operators import index as ix
from textloom.operators import ranking, setqueries
from textloom.operators.numbering import numbered as all_numbered
from textloom.operators.staging import written
from textloom.plans import parser
from textloom.sources import sinks

RESULT = "rank int, doc_id long, score double, title string, snippet string"


def ranked(index: ix.Index, tree: parser.Keyword, k: int, prf: int = 0, settings: Settings = DEFAULTS, candidates: str = "semi", compat: bool = False) -> DataFrame:
    """(rank, doc_id, score) of a keyword query.

    Documents that have the whole query as a phrase come first, the others
    after them, by score in both. Phrases and prefixes in the query restrict
    the others; one without terms restricts nothing. If a query is nothing but
    phrases and prefixes, or has no terms, the documents these allow come by id, unranked. ``compat``: also a
    single term is tried as a phrase; phrase hits come by id, and if there are
    k of them nothing is ranked.
    """
    terms = Counter(index.analysis.terms(index.spark, parser.plain(tree.text)))
    allowed = None
    for r in tree.restrictions:
        if isinstance(r, parser.Phrase) and not index.analysis.terms(index.spark, r.text):
            continue
        found = setqueries.evaluate(index, r)
        allowed = found if allowed is None else allowed.intersect(found)
    if not terms or (tree.restrictions and not tree.rest):
        base = allowed if allowed is not None else setqueries.nothing(index)
        return numbered(base.select("doc_id", F.lit(0.0).alias("score"), F.lit(1).alias("tier")), k)
    scored = bounded(index, terms, allowed, settings, candidates)
    if prf > 0:
        best = ranking.top(scored, prf)
        texts = answers(index, numbered(best.withColumn("tier", F.lit(1)), prf), list(terms), settings, prf)
        new = ranking.feedback_terms(index, texts.select(F.concat_ws("\n", F.coalesce("title", F.lit("")), "snippet").alias("answer")), terms, settings)
        extra = [r.term for r in new.collect()]  # at most feedback_terms rows
        scored = bounded(index, terms + Counter(extra), allowed, settings, candidates)
    rows = scored.withColumn("tier", F.lit(1))
    in_order = index.analysis.terms(index.spark, parser.plain(tree.text))
    if len(in_order) >= (1 if compat else 2):
        whole = setqueries.phrase_of(index.postings, in_order)
        if compat:
            first = whole.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("tier"))
            if whole.limit(k).count() < k:
                first = first.unionByName(rows.join(whole, "doc_id", "left_anti"))
            return numbered(first, k)
        if allowed is None:
            return numbered(scored.join(whole.withColumn("tier", F.lit(0)), "doc_id", "left").withColumn("tier", F.coalesce("tier", F.lit(1))), k)
        first = ranking.scores(index.postings, index.vocabulary, index.stats, terms, settings).join(whole, "doc_id", "left_semi")
        rows = rows.unionByName(first.withColumn("tier", F.lit(0))).groupBy("doc_id").agg(F.min("tier").alias("tier"), F.max("score").alias("score"))
    return numbered(rows, k)


def bounded(index, terms, allowed, settings, candidates) -> DataFrame:
    scored = ranking.scores(index.postings, index.vocabulary, index.stats, terms, settings)
    return scored if allowed is None else ranking.restricted(scored, allowed, candidates)


def numbered(rows: DataFrame, k: int) -> DataFrame:
    """(rank, doc_id, score) of the first k by tier, score and id. Only the k rows that a distributed top-k leaves are numbered."""
    order = [F.col("tier"), F.desc("score"), F.col("doc_id")]
    best = rows.orderBy(*order).limit(max(k, 0))
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "doc_id", "score")


def answers(index: ix.Index, results: DataFrame, terms: list[str], settings: Settings = DEFAULTS, cut: int | None = None) -> DataFrame:
    """(rank, doc_id, score, title, snippet): results with their titles and snippets; these are made after the cut, of the results alone.

    ``cut``: the number of results, where it is bounded. Up to ``fetch`` of
    them are worked out first; their ids then reach the scan of the documents.
    """
    docs = index.documents.select("doc_id", "title", "clean_text")
    if cut is not None and cut <= settings.fetch:
        rows = results.select("rank", "doc_id", "score").collect()  # at most cut
        results = index.spark.createDataFrame(rows, "rank int, doc_id long, score double")
        docs = F.broadcast(docs.filter(F.col("doc_id").isin([r.doc_id for r in rows])))
    with_text = results.join(docs, "doc_id", "left")
    first = lambda piece: index.analysis.first_likely(piece, terms)
    wanted = F.array(*map(F.lit, terms)).cast("array<string>")
    return with_text.select("rank", "doc_id", "score", "title", snippet(F.col("clean_text"), first, wanted, settings).alias("snippet"))


class Engine:
    """Search over one index. ``strict``: boolean operators count; else they are dropped and the query is ranked. ``candidates``, ``compat``: see ``ranked``."""

    def __init__(self, index: ix.Index, *, strict: bool = False, candidates: str = "semi", compat: bool = False, settings: Settings = DEFAULTS):
        self.index, self.strict, self.candidates, self.compat, self.settings = index, strict, candidates, compat, settings

    @classmethod
    def open_or_build(cls, spark: SparkSession, folder: str, rows: DataFrame, analysis: ix.Analysis, **options) -> Engine:
        """Opens the index in a folder; if it is not there or incomplete, builds it from (doc_id, title, text) first."""
        if not ix.exists(spark, folder):
            ix.save(ix.build(rows, analysis), folder)
        return cls(ix.load(spark, folder, analysis), **options)

    def search(self, query: str | None, k: int = 10, prf: int = 0) -> DataFrame:
        """(rank, doc_id, score, title, snippet). A null query or k <= 0 gives nothing; links and strict boolean queries are not cut at k."""
        tree = parser.parse(query, strict=self.strict)
        if tree is None or k <= 0:
            return self.index.spark.createDataFrame([], RESULT)
        cut = None
        terms = list(dict.fromkeys(self.index.analysis.terms(self.index.spark, parser.plain(query))))
        if isinstance(tree, parser.Link):
            found = setqueries.linking(self.index.links, self.index.documents, tree.title)
            hits = all_numbered(found.select("doc_id", F.lit(None).cast("double").alias("score"), "source_norm"), [F.col("source_norm"), F.col("doc_id")])
        elif isinstance(tree, parser.Keyword):
            hits, cut = ranked(self.index, tree, k, prf, self.settings, self.candidates, self.compat), k
        else:
            found = setqueries.evaluate(self.index, tree)
            hits = all_numbered(found.select("doc_id", F.lit(None).cast("double").alias("score")), [F.col("doc_id")])
        return answers(self.index, hits, terms, self.settings, cut)

    def evaluate(self, query: str, k: int, prf: int, gold: DataFrame, log: str | None = None) -> tuple[DataFrame, float]:
        """Results, and their quality against ``gold`` (rank, title); both go to the log with the time taken, and to the folder ``log`` if there is one."""
        began = time.perf_counter()
        results = written(self.search(query, k, prf))
        seconds = time.perf_counter() - began
        spark = self.index.spark
        one = F.lit(1).alias("query_id")
        at = spark.createDataFrame([(1, k)], "query_id int, at int")
        value = ranking.ndcg(results.select(one, "rank", "title"), gold.select(one, "rank", "title"), at).first().ndcg
        text = sinks.result_log(query, seconds, results, value, k)
        if log:
            sinks.append_log(spark, text, log)
        return results, value


def title_of(answer):
    """Title of an answer ``title\\nsnippet``: what stands before the first line end."""
    return F.substring_index(answer, "\n", 1)
