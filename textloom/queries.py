"""Registered queries of the core; each covers its whole tables."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.config import Settings
from textloom.functions import analyzer, snippet, wikitext
from textloom.operators import index as ix
from textloom.operators import pages, ranking, setqueries, skew
from textloom.operators.numbering import numbered
from textloom.oracles import SQL  # noqa: F401
from textloom.plans import engine, parser
from textloom.sources import readers, sinks
from textloom.tables import table

#: Queries that are run, in the words of the test articles.
RANKED = "Brücke Siedlung Brücke"
PHRASE_2, PHRASE_3 = "Bau und Nutzung", "Liste der Flüsse Ostmarkens"
PREFIX = "brück"
LINKED = "Großraum Norderwiek"


def article_rows(spark, folder):
    """(doc_id, title, text) of the articles."""
    page = table(spark, folder, "page")
    return pages.articles(page, title=F.col("title"), text=F.col("text")).withColumnRenamed("id", "doc_id")


def analysis(spark, folder, steps=analyzer.LIGHT):
    return ix.Analysis(readers.stop_words(table(spark, folder, "stop_word")), steps)


def index(spark, folder, steps=analyzer.LIGHT):
    return ix.build(article_rows(spark, folder), analysis(spark, folder, steps))


def article_links(page):
    """(target_norm, source_doc_id) per link occurrence in article texts; the links are taken out before rows move."""
    keys = F.filter(F.transform(wikitext.wiki_links(F.col("text")), wikitext.title_key), lambda k: F.length(k) > 0)
    return pages.articles(page, targets=keys).select(F.explode("targets").alias("target_norm"), F.col("id").alias("source_doc_id"))


def p1_found(spark, folder):
    return skew.heavy_pairs(article_links(table(spark, folder, "page")), "target_norm", "source_doc_id", "0.02")


def p1_summary(spark, folder):
    """Per link target: occurrences, linking articles, and the article that links most."""
    pairs = skew.compress(article_links(table(spark, folder, "page")), "target_norm", "source_doc_id")
    return skew.key_summary(pairs, "target_norm", "source_doc_id")


def p1_percentiles(spark, folder):
    """Quartiles of the linking articles' ids per target."""
    pairs = skew.compress(article_links(table(spark, folder, "page")), "target_norm", "source_doc_id")
    return skew.key_percentiles(pairs, "target_norm", "source_doc_id", [0.25, 0.5, 0.75])


def articles(spark, folder):
    return article_rows(spark, folder).select("doc_id", "title", wikitext.title_key(F.col("title")).alias("norm_title"), F.length("text").alias("chars"))


def title_norms(spark, folder):
    return table(spark, folder, "page").select("title", wikitext.title_key(F.col("title")).alias("norm_title")).distinct()


def tokenize(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.posexplode(analyzer.tokens(F.col("text"))).alias("pos", "word"))


def stop_words(spark, folder):
    return readers.stop_word_rows(table(spark, folder, "stop_word"))


def stopword_filter(spark, folder):
    return ix.words(table(spark, folder, "documents"), analysis(spark, folder))


def stem_light(spark, folder):
    words = ix.words(article_rows(spark, folder), analysis(spark, folder)).select("word").distinct()
    return words.select("word", analyzer.normalized(F.col("word")).alias("normal"), analyzer.term(F.col("word"), analyzer.LIGHT).alias("term"))


def stem_full(spark, folder):
    words = ix.words(article_rows(spark, folder), analysis(spark, folder)).select("word").distinct()
    return words.select("word", analyzer.term(F.col("word")).alias("term"))


def postings(spark, folder):
    lists = index(spark, folder).postings
    return lists.select("term", "doc_id", "tf", F.concat_ws(",", F.transform("positions", lambda p: p.cast("string"))).alias("positions"))


def posting_lists(spark, folder):
    return ix.posting_text(index(spark, folder).postings)


def posting_round_trip(spark, folder):
    back = ix.posting_rows(ix.posting_text(index(spark, folder).postings))
    return back.select("term", "doc_id", "tf")


def vocabulary_df(spark, folder):
    return index(spark, folder).vocabulary


def corpus_stats(spark, folder):
    return index(spark, folder).stats


def df_cutoff(spark, folder):
    """Terms that count in ranking, at a cut that these tables reach."""
    return ranking.ranking_terms(index(spark, folder).vocabulary, Settings(max_df=100))


def _set(query):
    return lambda spark, folder: setqueries.evaluate(index(spark, folder), parser.boolean(query)).select("doc_id")


def bm25_topk(spark, folder):
    i = index(spark, folder)
    terms = Counter(i.analysis.terms(spark, RANKED))
    return ranking.top(ranking.scores(i.postings, i.vocabulary, i.stats, terms), 10).select("doc_id", F.round("score", 6).alias("score"))


def bm25_restricted(spark, folder):
    i = index(spark, folder)
    scored = ranking.scores(i.postings, i.vocabulary, i.stats, Counter(i.analysis.terms(spark, RANKED)))
    allowed = setqueries.phrase(i, PHRASE_2)
    return ranking.top(ranking.restricted(scored, allowed), 10).select("doc_id", F.round("score", 6).alias("score"))


def bm25_union(spark, folder):
    i = index(spark, folder)
    scored = ranking.scores(i.postings, i.vocabulary, i.stats, Counter(i.analysis.terms(spark, RANKED)))
    allowed = setqueries.phrase(i, PHRASE_2)
    return ranking.restricted(scored, allowed, "union").select("doc_id", F.round("score", 6).alias("score"))


def logged_queries(spark, folder):
    """(query_id, query, topk, prf): the first logged row of each id that has a query."""
    rows = table(spark, folder, "query_case").filter("query IS NOT NULL AND query_id IS NOT NULL")
    return pages.latest_rows(rows, ["query_id"], [F.asc_nulls_last("asked_at"), F.col("query"), F.col("topk")])


def query_types(spark, folder):
    """What kind of query each logged one is."""
    q = F.col("query")
    kind = (
        F.when(q.isNull(), "none")
        .when(q.contains("LINKTO "), "link")
        .when(q.contains(" AND ") | q.contains(" OR ") | q.contains(" BUT NOT "), "boolean")
        .when(q.contains("*"), "prefix")
        .when(q.rlike("(?sU)" + parser.PHRASE), "phrase")
        .otherwise("keyword")
    )
    return table(spark, folder, "query_case").select("query", kind.alias("kind")).distinct()


def plain_query(q):
    """An expression for ``parser.plain``."""
    for op in parser.OPERATORS:
        q = F.replace(q, F.lit(op), F.lit(" "))
    return F.regexp_replace(F.replace(q, F.lit(parser.LINKTO), F.lit("")), "['\"*]", "")


def bm25_batch(spark, folder):
    """All logged queries that rank, in one plan."""
    i = index(spark, folder)
    asked = logged_queries(spark, folder).filter("topk > 0 AND NOT contains(query, 'LINKTO ')")
    terms = asked.select("query_id", "topk", F.explode(i.analysis.words(plain_query(F.col("query")))).alias("word"))
    terms = terms.select("query_id", "topk", i.analysis.term(F.col("word")).alias("term"))
    return ranking.batch(i.postings, i.vocabulary, i.stats, terms).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def prf_terms(spark, folder):
    """Feedback terms of the three best, from titles and whole clean texts."""
    i = index(spark, folder)
    terms = Counter(i.analysis.terms(spark, RANKED))
    best = ranking.top(ranking.scores(i.postings, i.vocabulary, i.stats, terms), 3)
    texts = best.join(i.documents, "doc_id").select(F.concat_ws("\n", "title", "text").alias("answer"))
    return ranking.feedback_terms(i, texts, terms).select("term", F.col("count").alias("n"))


def bm25_prf(spark, folder):
    e = engine.Engine(index(spark, folder))
    return e.search(RANKED, 10, prf=3).select("rank", "doc_id", F.round("score", 6).alias("score"), "title")


def keyword_pipeline(spark, folder):
    e = engine.Engine(index(spark, folder))
    return e.search(f'{PHRASE_2} "{PHRASE_3}"', 20).select("rank", "doc_id", F.round("score", 6).alias("score"), "title", "snippet")


def keyword_full(spark, folder):
    """The same with the full analysis of two stemmers."""
    e = engine.Engine(index(spark, folder, analyzer.FULL))
    return e.search(RANKED, 10).select("rank", "doc_id", F.round("score", 6).alias("score"), "title", "snippet")


def strict_boolean(spark, folder):
    e = engine.Engine(index(spark, folder), strict=True)
    return e.search(f'"{PHRASE_2}" AND {PREFIX}* BUT NOT Kapelle', 10).select("rank", "doc_id", "title")


def snippet_head(spark, folder):
    docs = ix.documents(article_rows(spark, folder))
    return docs.filter(F.length("clean_text") > 0).select("doc_id", snippet.head_snippet(F.col("clean_text")).alias("snippet"))


def snippet_hit(spark, folder):
    """Snippets of all articles for one unstemmed word."""
    docs = ix.documents(article_rows(spark, folder))
    first = lambda piece: F.try_element_at(analyzer.tokens(piece), F.lit(1))
    return docs.select("doc_id", snippet.snippet(F.col("clean_text"), first, F.array(F.lit("nutzung"))).alias("snippet")).filter("snippet IS NOT NULL")


def clean_markup(spark, folder):
    return ix.documents(article_rows(spark, folder)).select("doc_id", "clean_text")


def link_extract(spark, folder):
    return ix.links(ix.documents(article_rows(spark, folder)))


def link_lists(spark, folder):
    return ix.link_lists(link_extract(spark, folder))


def link_round_trip(spark, folder):
    return ix.link_list_rows(link_lists(spark, folder))


def operator_strip(spark, folder):
    """Logged queries without operators and quotes."""
    return table(spark, folder, "query_case").select("query", plain_query(F.col("query")).alias("plain")).distinct()


def answer_titles(spark, folder):
    """Answers of all articles, title and snippet in one text, and the title back from it."""
    docs = ix.documents(article_rows(spark, folder))
    answer = F.concat_ws("\n", F.coalesce("title", F.lit("")), snippet.head_snippet(F.col("clean_text")))
    return docs.filter(F.length("clean_text") > 0).select("doc_id", answer.alias("answer")).withColumn("title", engine.title_of(F.col("answer")))


def link_query(spark, folder):
    docs = ix.documents(article_rows(spark, folder))
    return setqueries.linking(ix.links(docs), docs, LINKED)


def result_pages(spark, folder):
    """(query, html): gold rankings as result pages with list items."""
    gold = table(spark, folder, "gold_ranking").filter("query IS NOT NULL AND title IS NOT NULL AND gold_rank IS NOT NULL")
    item = F.concat(F.lit('<li><a href="/wiki" title="'), F.translate("title", '"', ""), F.lit('">hit</a></li>'))
    items = gold.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("gold_rank", item.alias("item")))).alias("items"))
    lines = F.concat(F.array(F.lit("<ul>")), F.transform("items", lambda i: i["item"]), F.array(F.lit("<li>none</li>"), F.lit("</ul>")))
    return items.select("query", F.array_join(lines, "\n").alias("html"))


def gold_extract(spark, folder):
    return readers.gold_titles(result_pages(spark, folder))


def gold_kept(spark, folder):
    """The same from where they are kept, once they were asked for."""
    from textloom.operators.staging import shared_folder

    path = f"{shared_folder(spark)}/gold-{uuid4().hex}"
    asked = result_pages(spark, folder)
    readers.gold_cached(asked, path)
    return readers.gold_cached(asked, path)


def ndcg(spark, folder):
    """Quality of the logged hits of every query at its own cut, against the gold ranking of its text."""
    asked = logged_queries(spark, folder)
    hits = table(spark, folder, "search_result").filter("query_id IS NOT NULL AND result_rank IS NOT NULL AND title IS NOT NULL")
    hits = hits.groupBy("query_id", F.col("result_rank").alias("rank")).agg(F.min("title").alias("title"))
    gold = table(spark, folder, "gold_ranking").select("query", F.col("gold_rank").alias("rank"), "title").filter("rank IS NOT NULL")
    gold = asked.select("query_id", "query").join(gold, "query").select("query_id", "rank", "title")
    return ranking.ndcg(hits, gold, asked.select("query_id", F.col("topk").alias("at")))


def xml_pages(spark, folder):
    """Pages written as a wiki dump and read back; articles among them."""
    from textloom.operators.staging import shared_folder

    page = pages.current(table(spark, folder, "page"), title=F.col("title"), ns=F.col("ns"), redirect=F.col("redirect"), text=F.col("text"))
    path = f"{shared_folder(spark)}/dump-{spark.sparkContext.applicationId}.xml"
    sinks.mediawiki(page, path)
    return readers.articles(readers.mediawiki(spark, path)).select("doc_id", "title", F.length("text").alias("chars"))


def index_round_trip(spark, folder):
    """The index written, read and searched."""
    from textloom.operators.staging import shared_folder

    path = f"{shared_folder(spark)}/index-{spark.sparkContext.applicationId}-{abs(hash(folder))}"
    e = engine.Engine.open_or_build(spark, path, article_rows(spark, folder), analysis(spark, folder))
    return e.search(RANKED, 10).select("rank", "doc_id", F.round("score", 6).alias("score"), "title")


def evaluation(spark, folder):
    """A search and its quality against the first articles with its term, as logged."""
    i = index(spark, folder)
    first = i.postings.filter(F.col("term") == i.analysis.terms(spark, "Brücke")[0]).orderBy("doc_id").limit(100).select("doc_id")
    gold = numbered(first.join(i.documents.select("doc_id", "title"), "doc_id"), [F.col("doc_id")]).select("rank", "title")
    results, value = engine.Engine(i).evaluate(RANKED, 10, 0, gold)
    return results.select("rank", "title", F.round(F.lit(value), 6).alias("ndcg"))


def unranked_limit(spark, folder):
    """A query of nothing but a prefix: the first by id."""
    return engine.Engine(index(spark, folder)).search(f"{PREFIX}*", 25).select("rank", "doc_id")


def empty_restriction(spark, folder):
    """Phrases without terms restrict nothing."""
    return engine.Engine(index(spark, folder)).search('Brücke "" "der"', 10).select("rank", "doc_id", F.round("score", 6).alias("score"))


def argument_guards(spark, folder):
    """Results of calls that have none."""
    e = engine.Engine(index(spark, folder))
    calls = {"null query": (None, 10), "no results wanted": (RANKED, 0), "fewer than none": (RANKED, -1), "nothing asked": ("", 10)}
    return reduce(DataFrame.unionAll, (e.search(q, k).agg(F.lit(name).alias("arguments"), F.count(F.lit(1)).alias("n")) for name, (q, k) in calls.items()))


def head_sample(spark, folder):
    """The first lines of a text file: here of one with the titles of the first articles, one to a line."""
    from textloom.operators.staging import shared_folder

    titles = pages.articles(table(spark, folder, "page"), title=F.col("title")).filter(~F.contains("title", F.lit("\n")))
    path = f"{shared_folder(spark)}/titles-{spark.sparkContext.applicationId}"
    titles.orderBy("id").limit(2001).select("title").coalesce(1).write.mode("overwrite").text(path)
    return readers.head(spark, path, 101)


QUERIES = {
    f.__name__: f
    for f in (
        articles, title_norms, tokenize, stop_words, stopword_filter, stem_light, stem_full, postings, posting_lists, posting_round_trip, vocabulary_df,
        corpus_stats, df_cutoff, bm25_topk, bm25_restricted, bm25_union, query_types, bm25_batch, prf_terms, bm25_prf, keyword_pipeline, keyword_full,
        strict_boolean, snippet_head, snippet_hit, clean_markup, link_extract, link_lists, link_round_trip, link_query, operator_strip, answer_titles, gold_extract, gold_kept, ndcg, xml_pages, index_round_trip,
        evaluation, unranked_limit, empty_restriction, argument_guards, head_sample, p1_found, p1_summary, p1_percentiles,
    )
} | {
    "term_query": _set("Brücke"),
    "prefix_query": _set(f"{PREFIX}*"),
    "phrase_query_2": _set(f'"{PHRASE_2}"'),
    "phrase_query_3": _set(f'"{PHRASE_3}"'),
    "boolean_and": _set("Burg AND Brücke"),
    "boolean_or": _set("Burg OR Kapelle"),
    "boolean_but_not": _set("Burg BUT NOT Brücke"),
    "boolean_chain": _set("Burg AND Brücke OR Kapelle BUT NOT Siedlung"),
}
