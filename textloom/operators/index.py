"""The inverted index as tables: documents, postings, vocabulary, links, statistics."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import analyzer, wikitext
from textloom.functions.bind import let
from textloom.operators.skew import salted_join

PARTS = ("documents", "postings", "vocabulary", "links", "stats")


@dataclass
class Analysis:
    """Stop words and the steps from a word to a term."""

    stop: list[str]
    steps: tuple[str, ...] = analyzer.FULL
    known: dict[str, list[str]] = field(default_factory=dict, repr=False, compare=False)

    def words(self, text):
        return analyzer.without(analyzer.tokens(text), self.stop)

    def term(self, word):
        return analyzer.term(word, self.steps)

    def first_likely(self, text, terms: list[str]):
        """The first term of a text if it can be one of ``terms``, else mostly null: no step changes a word's first letter but for its accent, so most texts need not be analysed."""
        letters = sorted({t[0] for t in terms if t})
        accented = "".join(a for a, b in zip(*analyzer.FIRST) if b in letters)
        begins = F.lit(rf"(?iu)(?<![\p{{L}}\p{{M}}\p{{N}}])[{re.escape(''.join(letters) + accented)}]") if letters else F.lit("(?!)")
        return F.when(F.rlike(text, begins), let(F.try_element_at(self.words(text), F.lit(1)), self.term))

    def terms(self, spark: SparkSession, text: str) -> list[str]:
        """Terms of a short text, such as a query, in order. A local row, which the optimizer folds without a job."""
        if text not in self.known:
            if len(self.known) >= 1000:
                self.known.clear()
            row = spark.sql("SELECT * FROM VALUES (:text) AS t(text)", args={"text": text})
            self.known[text] = row.select(F.transform(self.words(F.col("text")), self.term).alias("t")).first().t or []
        return list(self.known[text])


@dataclass
class Index:
    documents: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    links: DataFrame
    stats: DataFrame
    analysis: Analysis
    wiki: bool = True

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession


def documents(rows: DataFrame, *, wiki: bool = True) -> DataFrame:
    """(doc_id, title, norm_title, text, clean_text, seq) from (doc_id, title, text[, seq]); seq (by default doc_id) tells which of two equal titles came last."""
    seq = F.col("seq") if "seq" in rows.columns else F.col("doc_id")
    clean = wikitext.clean_text(F.col("text")) if wiki else F.col("text")
    return rows.select("doc_id", "title", wikitext.title_key(F.col("title")).alias("norm_title"), "text", clean.alias("clean_text"), seq.alias("seq"))


def words(docs: DataFrame, analysis: Analysis, text: str = "text") -> DataFrame:
    """(doc_id, pos, word): positions count the words that are left once stop words are gone."""
    return docs.select("doc_id", F.posexplode(analysis.words(F.col(text))).alias("pos", "word"))


def stems(occurring: DataFrame, analysis: Analysis) -> DataFrame:
    """(word, term): every distinct word with its term, computed once.

    The term looks at the count, so that a filter on terms is not moved to the
    words in the texts, which would stem each of them.
    """
    once = occurring.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return once.select("word", analysis.term(F.when(F.col("n") > 0, F.col("word"))).alias("term"))


def postings(docs: DataFrame, analysis: Analysis) -> DataFrame:
    """(term, doc_id, positions sorted, tf).

    Positions are gathered per word and document first, so that what is joined
    to the stems and moved on by term is a row per pair, not per token. A
    common word's rows are joined in places by document, so it is spread.
    """
    occurring = words(docs, analysis).groupBy("word", "doc_id").agg(F.collect_list("pos").alias("p"))
    by_term = salted_join(occurring, stems(occurring, analysis), "word", "doc_id").groupBy("term", "doc_id")
    lists = by_term.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("p")))).alias("positions"))
    return lists.select("term", "doc_id", "positions", F.size("positions").alias("tf"))


def vocabulary(lists: DataFrame) -> DataFrame:
    """(term, df, cf). df looks at tf, so that it reads what the postings read: in one plan with them, both come from one shuffle."""
    return lists.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"), F.sum("tf").alias("cf"))


def links(docs: DataFrame, *, decode_urls: bool = False) -> DataFrame:
    """(target_norm, source_norm, source_doc_id), distinct; self links stay, redirects are not resolved, empty targets go."""
    targets = F.explode(wikitext.link_targets(F.col("text"), decode_urls=decode_urls)).alias("target")
    rows = docs.select(targets, F.col("norm_title").alias("source_norm"), F.col("doc_id").alias("source_doc_id"))
    return rows.select(wikitext.title_key(F.col("target")).alias("target_norm"), "source_norm", "source_doc_id").filter(F.length("target_norm") > 0).distinct()


#: Lists are written in parts by ranges of so many ids, so that none grows with the collection.
PART = 10_000


def _part(doc_id: str):
    return F.floor(F.col(doc_id) / PART).alias("part")


def link_lists(link_rows: DataFrame) -> DataFrame:
    """(target_norm, part, sources): sorted distinct linking titles of a target, a line per part of the linking ids."""
    lists = link_rows.groupBy("target_norm", _part("source_doc_id")).agg(F.sort_array(F.collect_set("source_norm")).alias("s"))
    return lists.select("target_norm", "part", F.concat_ws(",", "s").alias("sources"))


def link_list_rows(lists: DataFrame) -> DataFrame:
    """(target_norm, source_norm), distinct: back from ``link_lists``."""
    return lists.select("target_norm", F.explode(F.split("sources", ",")).alias("source_norm")).distinct()


def stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"))


def build(rows: DataFrame, analysis: Analysis, *, wiki: bool = True) -> Index:
    """The index of (doc_id, title, text) rows, not yet written."""
    docs = documents(rows, wiki=wiki)
    lists = postings(docs, analysis)
    return Index(docs, lists, vocabulary(lists), links(docs), stats(docs), analysis, wiki)


def save(index: Index, folder: str) -> None:
    """Writes all tables; the pages are read, deduplicated and cleaned once, as the others are made from the written documents.

    Documents lie in the order of their ids and postings in that of terms, so a
    query reads the row groups of its terms and of the documents it shows only;
    a term that is everywhere spans several files.
    """
    # texts are cleaned after they have moved: ranges are found by a run over what is moved, which would clean them, too
    rows = index.documents.select("doc_id", "title", "text", "seq").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    documents(rows, wiki=index.wiki).write.mode("overwrite").parquet(f"{folder}/documents")
    docs = index.spark.read.parquet(f"{folder}/documents")
    postings(docs, index.analysis).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")
    lists = index.spark.read.parquet(f"{folder}/postings")
    vocabulary(lists).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/vocabulary")
    links(docs).repartitionByRange("target_norm", "source_doc_id").sortWithinPartitions("target_norm", "source_doc_id").write.mode("overwrite").parquet(f"{folder}/links")
    stats(docs).write.mode("overwrite").parquet(f"{folder}/stats")


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether every table of an index was written to the end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return all(fs.exists(path(f"{folder}/{p}/_SUCCESS")) for p in PARTS)


def load(spark: SparkSession, folder: str, analysis: Analysis) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{p}") for p in PARTS), analysis)


def posting_text(lists: DataFrame) -> DataFrame:
    """(term, part, line): each term's list as ``doc:pos,pos;doc:pos``, documents ascending, a line per part of the ids."""
    entry = F.concat_ws(":", "doc_id", F.concat_ws(",", F.transform("positions", lambda p: p.cast("string"))))
    each = lists.groupBy("term", _part("doc_id")).agg(F.sort_array(F.collect_list(F.struct("doc_id", entry.alias("e")))).alias("es"))
    return each.select("term", "part", F.concat_ws(";", F.transform("es", lambda e: e["e"])).alias("line"))


def posting_rows(lines: DataFrame) -> DataFrame:
    """Back from ``posting_text``."""
    entry = lines.select("term", F.explode(F.split("line", ";")).alias("e"))
    numbers = F.transform(F.split(F.substring_index("e", ":", -1), ","), lambda p: p.cast("int"))
    return entry.select("term", F.substring_index("e", ":", 1).cast("long").alias("doc_id"), numbers.alias("positions")).withColumn("tf", F.size("positions"))
