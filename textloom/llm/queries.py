"""Registered queries of the training-data operators; each covers its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.llm import distinctive, frequency, leakage, markup, mixing, nearduplicates, pieces, titles, truncation
from textloom.llm.oracles import SQL  # noqa: F401
from textloom.operators import pages
from textloom.operators.staging import written
from textloom.tables import table


def article_texts(spark, folder):
    return pages.articles(table(spark, folder, "page"))


def p2_clean(spark, folder):
    return markup.cleaned(article_texts(spark, folder))


def p2_found(spark, folder):
    return markup.elements(article_texts(spark, folder)).select("id", "kind", "content").distinct()


def p2_structure(spark, folder):
    """How many elements of each kind an article has, repeats counted."""
    return markup.elements(article_texts(spark, folder)).groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n"))


def p3_terms(spark, folder, by="z"):
    return distinctive.distinctive(pages.article_buckets(table(spark, folder, "page")), by=by)


def p3_log_odds(spark, folder):
    return p3_terms(spark, folder).select("id", "term", "tf", "occurrences", "records", F.round("z", 6).alias("z"))


def p3_found(spark, folder):
    return p3_terms(spark, folder, "tf_idf").select("id", "term")


def titled_texts(spark, folder):
    return pages.articles(table(spark, folder, "page"), text=F.concat_ws(" ", "title", "text"))


def p4_pairs(spark, folder):
    return nearduplicates.alike(titled_texts(spark, folder), width=3, least=0.6)


def text_classes(spark, folder, **columns):
    """(id, f0, f1, …): fingerprints of the same, made before rows move."""
    text = F.concat_ws(" ", "title", "text")
    return pages.articles(table(spark, folder, "page"), **{c: f(text) for c, f in nearduplicates.PRINTS.items()}, **{c: f(text) for c, f in columns.items()})


def p4_found(spark, folder):
    members = text_classes(spark, folder, ok=lambda t: nearduplicates.has_run(3, t)).filter("ok").drop("ok")
    return nearduplicates.expand(p4_pairs(spark, folder), nearduplicates.same(written(members)))


def p4_groups(spark, folder):
    return nearduplicates.linked(nearduplicates.same(written(text_classes(spark, folder))), nearduplicates.alike(titled_texts(spark, folder)))


def p5_found(spark, folder):
    return titles.title_groups(table(spark, folder, "page"))


def p6_pieces(spark, folder):
    return pieces.split(article_texts(spark, folder))


def p6_found(spark, folder):
    return p6_pieces(spark, folder).select("id").distinct()


def p6_tiling(spark, folder):
    """Of each text cut up: the digest of its new parts put together again, whether every piece is within the limit, and every overlap."""
    each = p6_pieces(spark, folder).withColumn("fresh", F.expr("substring(content, new_from - start + 1, length(content))"))
    whole = each.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("piece", "fresh"))).alias("ps"), (F.max(F.length("content")) <= 4000).alias("within"), (F.max(F.expr("new_from - start")) <= 200).alias("overlaps")
    )
    return whole.select("id", F.md5(F.concat_ws("", F.transform("ps", lambda p: p["fresh"]))).alias("digest"), "within", "overlaps")


def p7_terms(spark, folder):
    page = table(spark, folder, "page")
    n = pages.articles(page, one=F.lit(1)).agg(F.count(F.lit(1))).scalar()
    return frequency.mark(frequency.term_counts(pages.articles(page)), n)


def p7_found(spark, folder):
    return p7_terms(spark, folder).filter("mark IS NOT NULL").select("term", "mark")


def p8_spans(spark, folder):
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p8_found(spark, folder):
    return p8_spans(spark, folder).select("item_id", "doc_id").distinct()


def p9_mix(spark, folder):
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_target"))[0]


def p9_shares(spark, folder):
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_target"))[1]


def p9_limits(spark, folder):
    """Of each source: its documents, whether no record is used more often than it may be, and whether its share is reached."""
    targets = table(spark, folder, "mix_target")
    used, shares = mixing.mix(table(spark, folder, "documents"), targets)
    most = used.groupBy("source").agg(F.max("copies").alias("most"), F.count_distinct("doc_id").alias("ids"), F.count(F.lit(1)).alias("rows"))
    there = shares.agg(F.sum(F.when(F.col("documents") > 0, F.col("target_share")))).scalar()
    wanted = F.when(F.col("documents") > 0, F.col("target_share") / there).otherwise(F.lit(0.0))
    rows = shares.join(most, "source", "left")
    within = F.coalesce((F.col("most") <= F.col("max_repeats")) & (F.col("ids") == F.col("rows")), F.lit(True))
    return rows.select("source", "documents", within.alias("within"), (F.abs(F.col("share") - wanted) <= 0.01).alias("reached"))


def p10_truncated(spark, folder):
    return truncation.truncated(table(spark, folder, "documents"))


def p10_found(spark, folder):
    return p10_truncated(spark, folder).select("doc_id").distinct()


def p10_rates(spark, folder):
    return truncation.rates(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p2_clean, p2_found, p2_structure, p3_log_odds, p3_found, p4_pairs, p4_found, p4_groups, p5_found, p6_pieces, p6_tiling, p6_found, p7_terms, p7_found, p8_spans, p8_found, p9_mix, p9_shares, p9_limits, p10_truncated, p10_found, p10_rates)}
