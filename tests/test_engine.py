from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import largest_partition
from textloom import queries
from textloom.config import Settings
from textloom.functions import analyzer
from textloom.operators import index as ix
from textloom.operators import ranking, setqueries, skew
from textloom.operators.numbering import numbered
from textloom.plans import parser
from textloom.plans.engine import Engine, title_of
from textloom.sources import readers, sinks
from textloom.streaming.incremental import append_postings, arrivals

CORPUS = [(1, "A", "apfel rot rot"), (2, "B", "apfel gelb"), (3, "C", "birne gelb saft"), (4, "D", "birne saft apfel saft"), (5, "E", "saft")]
SCHEMA = "doc_id long, title string, text string"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    analysis = ix.Analysis([], ())
    assert not ix.exists(spark, folder)
    return Engine.open_or_build(spark, folder, spark.createDataFrame(CORPUS, SCHEMA), analysis).index, folder


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("gelb", [2, 3]), ("s*", [3, 4, 5]), ('"birne saft"', [4]), ('"saft apfel saft"', [4]), ("apfel AND saft", [4]), ("apfel OR rot", [1, 2, 4]), ("saft BUT NOT birne", [5]),
        ("apfel AND saft OR gelb", [2, 3, 4]), ('""', []), ("fehlt", []), ("*", []), ("", []), ("'rot rot'", [1]), ("zz*", []),
    ],
)
def test_sets(index, query, ids):
    assert sorted(r.doc_id for r in setqueries.evaluate(index[0], parser.boolean(query)).collect()) == ids


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("rot", {1: 1.510592}), ("gelb birne", {3: 0.672944, 2: 0.336472, 4: 0.336472}), ("gelb gelb birne", {3: 1.002819, 2: 0.666347, 4: 0.336472}),
        ("saft rot", {1: 1.510592, 3: -0.336472, 5: -0.336472, 4: -0.462649}), ("fehlt", {}),
    ],
)
def test_bm25(index, query, found):
    i = index[0]
    got = ranking.top(ranking.scores(i.postings, i.vocabulary, i.stats, Counter(query.split())), 10).collect()
    assert [(r.doc_id, round(r.score, 6)) for r in got] == list(found.items())
    # a top-k is the beginning of every longer one
    assert ranking.top(ranking.scores(i.postings, i.vocabulary, i.stats, Counter(query.split())), 2).collect() == got[:2]


def test_restrictions(index):
    i = index[0]
    scored = ranking.scores(i.postings, i.vocabulary, i.stats, Counter(["gelb"]))
    allowed = setqueries.evaluate(i, parser.boolean("saft"))
    assert [r.doc_id for r in ranking.restricted(scored, allowed).collect()] == [3]
    union = {r.doc_id: r.score for r in ranking.restricted(scored, allowed, "union").collect()}
    assert set(union) == {2, 3, 4, 5} and union[5] == 0


def test_search(index, spark):
    e = Engine(index[0])
    assert [r.doc_id for r in e.search("birne saft", 10).orderBy("rank").collect()] == [4, 3, 5]  # the phrase first
    assert [r.doc_id for r in e.search('"birne saft" apfel', 10).collect()] == [4]
    assert [r.doc_id for r in e.search("saft BUT NOT birne", 10).orderBy("rank").collect()][0] == 3  # weak: ranked
    assert [r.doc_id for r in Engine(index[0], strict=True).search("saft BUT NOT birne", 1).collect()] == [5]
    assert [r.doc_id for r in e.search("bir*", 10).orderBy("rank").collect()] == [3, 4]  # nothing to rank by
    assert [r.doc_id for r in e.search('"saft" ap*', 10).collect()] == [4]
    assert [r.doc_id for r in e.search('s*', 2).orderBy("rank").collect()] == [3, 4]
    assert e.search(None, 10).count() == 0 and e.search("rot", 0).count() == 0 and e.search("", 5).count() == 0
    row = e.search("rot", 10).first()
    assert (row.title, row.snippet) == ("A", "apfel rot rot...")


def test_compat(index):
    e = Engine(index[0], compat=True)
    ids = lambda q, k: [r.doc_id for r in e.search(q, k).orderBy("rank").collect()]
    assert ids("saft", 2) == [3, 4]  # enough phrase hits: by id
    assert ids("birne saft", 10) == [4, 3, 5]
    assert ids("saft", 10) == [3, 4, 5]


def test_feedback(index):
    i = index[0]
    texts = i.spark.createDataFrame([("D\nbirne saft apfel saft...",)], "answer string")
    got = ranking.feedback_terms(i, texts, Counter(["birne"])).collect()
    assert [(r.term, r["count"]) for r in got] == [("saft", 2), ("apfel", 1), ("d", 1)]
    e = Engine(i)
    assert e.search("rot", 10, prf=1).count() >= e.search("rot", 10).count()


def test_batch_is_as_single(index, spark):
    i = index[0]
    asked = spark.createDataFrame([(1, 2, "gelb"), (1, 2, "birne"), (2, 5, "rot"), (3, 5, "fehlt")], "query_id int, topk int, term string")
    got = {(r.query_id, r.rank): r.doc_id for r in ranking.batch(i.postings, i.vocabulary, i.stats, asked).collect()}
    assert got == {(1, 1): 3, (1, 2): 2, (2, 1): 1}


def test_round_trips(index, spark):
    i, folder = index
    assert ix.exists(spark, folder)
    back = ix.posting_rows(ix.posting_text(i.postings))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, i.postings.select("term", "doc_id", "positions", "tf").collect()))
    words = sum(len(t.split()) for _, _, t in CORPUS)
    assert i.postings.agg(F.sum("tf")).first()[0] == words == i.vocabulary.agg(F.sum("cf")).first()[0]


def test_postings_are_pruned(index):
    plan = setqueries.evaluate(index[0], parser.Term("saft"))._jdf.queryExecution().toString()
    assert "EqualTo(term,saft)" in plan


@pytest.mark.parametrize(("ranked", "gold", "at", "value"), [("ABC", "ABC", 3, 1.0), ("BA", "ABC", 3, 0.745674), ("BA", "AB", 2, 1.019639), ("", "AB", 2, 0.0), ("AB", "ABA", 2, 1.0), ("A", "A", 0, None)])
def test_ndcg(spark, ranked, gold, at, value):
    table = lambda s: spark.createDataFrame([(1, i, t) for i, t in enumerate(s, 1)], "query_id int, rank int, title string")
    got = ranking.ndcg(table(ranked), table(gold), spark.createDataFrame([(1, at)], "query_id int, at int")).first().ndcg
    assert got != got if value is None else round(got, 6) == value or (value == 0.0 and got == 0)


@pytest.mark.parametrize(
    ("query", "tree"),
    [
        (None, None), ("LINKTO A b", parser.Link("A b")), ("a LINKTO", parser.Keyword("a LINKTO")), ("a AND b", parser.Keyword("a b")), ("a and b", parser.Keyword("a and b")),
        ("x \"p (a+b) q\"", parser.Keyword("x \"p (a+b) q\"", (parser.Phrase("p (a+b) q"),))), ("Nertbän's x", parser.Keyword("Nertbän's x")),
        ("'p q' Ger*", parser.Keyword("'p q' Ger*", (parser.Phrase("p q"), parser.Prefix("ger")))), ('""', parser.Keyword('""', (parser.Phrase(""),))),
    ],
)
def test_parser(query, tree):
    assert parser.parse(query) == tree


def test_strict_parser_goes_left_to_right():
    t = parser.Term
    assert parser.parse("a AND b OR c BUT NOT d", strict=True) == parser.ButNot(parser.Or(parser.And(t("a"), t("b")), t("c")), t("d"))


def test_numbers_over_partitions(spark):
    rows = [(i * 37 % 101, "x") for i in range(101)]
    df = spark.createDataFrame(rows, "k int, _part string").repartition(7)
    assert {r.rank: r.k for r in numbered(df, [F.desc("k")]).collect()} == {i + 1: 100 - i for i in range(101)}
    assert numbered(df.filter("false"), [F.col("k")]).count() == 0


def test_lists_come_in_parts(spark):
    rows = spark.createDataFrame([(i * 6000, "T", "wort") for i in range(4)], SCHEMA)
    lines = ix.posting_text(ix.build(rows, ix.Analysis([], ())).postings).collect()
    assert sorted((r.part, r.line) for r in lines) == [(0, "0:0;6000:0"), (1, "12000:0;18000:0")]


def test_links(spark):
    rows = [(1, "Ort A", "[[Ort B]] [[ort-b|x]] [[Ort A]]"), (2, "Ort B", "[[Fehlt]]"), (3, "Ort. A", "[[Ort B#s]]"), (4, "C", None)]
    docs = ix.documents(spark.createDataFrame(rows, SCHEMA))
    links = ix.links(docs)
    assert sorted(map(tuple, links.select("target_norm", "source_doc_id").collect())) == [("fehlt", 2), ("orta", 1), ("ortb", 1), ("ortb", 3)]
    # of two documents with one title the later stands for it
    assert [r.doc_id for r in setqueries.linking(links, docs, "Ort-B").collect()] == [3]
    assert {r.target_norm: r.sources for r in ix.link_lists(links).collect()}["ortb"] == "orta"
    assert {tuple(r) for r in ix.link_list_rows(ix.link_lists(links)).collect()} == {tuple(r) for r in links.select("target_norm", "source_norm").collect()}


def test_xml_source(spark, tmp_path):
    dump = """<mediawiki>
<page><title>Müll</title><ns>0</ns><id>1</id><revision><id>77</id><contributor><id>5</id></contributor><text xml:space="preserve">a	b [[X]]</text></revision></page>
<page><title>W</title><ns>0</ns><id>2</id><redirect title="Z" /><revision><text>x</text></revision></page>
<page><title>V</title><ns>0</ns><id>3</id><redirect /><revision><text>x</text></revision></page>
<page><revision><text>erst Text</text></revision><id>4</id><title>U</title><ns>0</ns></page>
<page><title>T</title><ns>1</ns><id>5</id><revision><text>x</text></revision></page>
<page><title>S</title><ns>0</ns><revision><id>9</id><text>ohne id</text></revision></page>
<page><title></title><ns>0</ns><id>7</id><revision><text>x</text></revision></page>
<page><title>R</title><ns>0</ns><id>8</id><revision><text></text></revision></page>
</mediawiki>"""
    path = tmp_path / "dump.xml"
    path.write_text(dump, encoding="utf-8")
    pages = readers.mediawiki(spark, str(path))
    assert sorted(map(tuple, readers.articles(pages).collect())) == [(1, "Müll", "a\tb [[X]]"), (4, "U", "erst Text")]
    assert pages.count() == 8
    out = str(tmp_path / "again")
    sinks.mediawiki(pages, out)
    assert sorted(map(tuple, readers.articles(readers.mediawiki(spark, out)).collect())) == [(1, "Müll", "a\tb [[X]]"), (4, "U", "erst Text")]
    assert readers.head(spark, str(path), 2).count() == 2


def test_gold_titles(spark):
    html = '<ul>\n<li><a title="B" title="x">\nkein\n<li>ohne</li>\n<li><a title="A">\n <li title="eingerückt">'
    got = readers.gold_titles(spark.createDataFrame([("q", html), ("r", None), ("s", "")], "query string, html string")).collect()
    assert sorted((r.query, r.rank, r.title) for r in got) == [("q", 1, "B"), ("q", 2, "A")]


def test_evaluate_logs(index, spark, caplog):
    gold = spark.createDataFrame([(1, "A")], "rank int, title string")
    with caplog.at_level("INFO", "textloom"):
        results, value = Engine(index[0]).evaluate("rot", 1, 0, gold)
    assert value == 1.0 and results.count() == 1 and "ndcg@1: 1.000000" in caplog.text


def test_empty_corpus(spark):
    i = ix.build(spark.createDataFrame([], SCHEMA), ix.Analysis([], ()))
    assert Engine(i).search("rot saft", 5).count() == 0 and i.vocabulary.count() == 0 and i.stats.first().n_docs == 0


def test_title_of(spark):
    got = spark.createDataFrame([("A\nx",), ("A",), ("\nx",)], "a string").select(title_of(F.col("a")).alias("t")).collect()
    assert [r.t for r in got] == ["A", "A", ""]


def test_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    analysis = ix.Analysis([], ())
    for part in (CORPUS[:2], CORPUS[2:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        append_postings(spark.readStream.schema(SCHEMA).parquet(source), analysis, out, str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(out).select("term", "doc_id", "tf")
    want = ix.build(spark.createDataFrame(CORPUS, SCHEMA), analysis).postings.select("term", "doc_id", "tf")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_arrivals(spark, tmp_path):
    source = str(tmp_path / "events")
    spark.sql("SELECT timestamp'2024-01-01 01:00:00' AS at UNION ALL SELECT timestamp'2024-01-01 02:00:00' UNION ALL SELECT timestamp'2024-01-03 02:00:00'").write.parquet(source)
    stream = arrivals(spark.readStream.schema("at timestamp").parquet(source), "at")
    q = stream.writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("arrived").collect()) == [1, 2]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_results_are_looked_up_by_id(index):
    shown = Engine(index[0]).search("saft", 2)
    assert "In(doc_id, [3,5])" in plan_of(shown) and [r.doc_id for r in shown.orderBy("rank").collect()] == [3, 5]
    # beyond ``fetch`` they are joined; the rows are the same
    other = Engine(index[0], settings=Settings(fetch=1)).search("saft", 2)
    assert "In(doc_id" not in plan_of(other) and other.orderBy("rank").collect() == shown.orderBy("rank").collect()


def test_batch_cuts_in_tasks(index, spark):
    i = index[0]
    asked = spark.createDataFrame([(1, 2, "gelb"), (2, 5, "rot")], "query_id int, topk int, term string")
    assert "WindowGroupLimit" in plan_of(ranking.batch(i.postings, i.vocabulary, i.stats, asked))
    assert ranking.batch(i.postings, i.vocabulary, i.stats, asked.filter("false")).count() == 0


def test_saved_tables_are_in_order(spark, tmp_path):
    folder = str(tmp_path / "i")
    rows = spark.createDataFrame([(k * 7 % 101, f"T{k}", f"wort{k % 9} alle [[T{k % 5}]]") for k in range(101)], SCHEMA).repartition(5)
    ix.save(ix.build(rows, ix.Analysis([], ())), folder)
    for part, key in (("documents", "doc_id"), ("postings", "term"), ("links", "target_norm")):
        spans = spark.read.parquet(f"{folder}/{part}").groupBy(F.input_file_name()).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy("lo").collect()
        assert all(a.hi <= b.lo for a, b in zip(spans, spans[1:]))
    i = ix.load(spark, folder, ix.Analysis([], ()))
    assert i.stats.first().n_docs == 101 and i.vocabulary.filter("term = 'alle'").first().df == 101 and i.links.count() == 101


@pytest.mark.parametrize(("query", "ids"), [('rot ""', [1]), ('rot "..."', [1]), ('gelb "birne" ""', [3, 4]), ('""', []), ('"..." s*', [3, 4, 5])])
def test_phrases_without_terms_restrict_nothing(index, query, ids):
    assert sorted(r.doc_id for r in Engine(index[0]).search(query, 10).collect()) == ids


@pytest.mark.parametrize(("query", "kind"), [("l'eau d'or", "keyword"), ("'a b' c", "phrase"), ('a "b', "keyword"), ('"b"', "phrase"), ("a* 'b'", "prefix"), ("Nertbän's x'", "keyword"), (None, "none")])
def test_query_kinds_follow_the_parser(spark, tmp_path, query, kind):
    spark.createDataFrame([(query,)], "query string").write.parquet(f"{tmp_path}/query_case.parquet")
    assert queries.query_types(spark, str(tmp_path)).first().kind == kind
    if kind in ("phrase", "keyword"):
        tree = parser.parse(query)
        assert any(isinstance(r, parser.Phrase) for r in tree.restrictions) == (kind == "phrase")


def test_gold_titles_are_kept(spark, tmp_path):
    folder = str(tmp_path / "gold")
    pages = [("q", '<li><a title="A">\n<li><a title="B">'), ("leer", "<ul>"), (None, '<li><a title="N">')]
    make = lambda rows: spark.createDataFrame(rows, "query string, html string")
    first = sorted(map(tuple, readers.gold_cached(make(pages), folder).collect()))
    assert first == [("q", 1, "A"), ("q", 2, "B")]
    # what is kept holds, and only what is new is added
    again = readers.gold_cached(make([("q", '<li><a title="anders">'), ("r", '<li><a title="C">'), ("leer", '<li><a title="X">')]), folder)
    assert sorted(map(tuple, again.collect())) == [*first, ("r", 1, "C")]
    assert readers.gold_cached(make([]), str(tmp_path / "none")).count() == 0


def test_log_folder_grows(index, spark, tmp_path):
    folder = str(tmp_path / "log")
    for q in ("rot", "gelb"):
        Engine(index[0]).evaluate(q, 2, 0, spark.createDataFrame([(1, "A")], "rank int, title string"), log=folder)
    lines = [r.value for r in spark.read.text(folder).collect()]
    assert {"query: rot", "query: gelb", "1. A"} <= set(lines) and sum(x.startswith("ndcg@2") for x in lines) == 2


def test_a_word_of_every_document_is_spread(spark, no_skew_join):
    docs = ix.documents(spark.createDataFrame([(k, "T", f"alle w{k}") for k in range(4000)], SCHEMA).repartition(8))
    joined = skew.salted_join(ix.words(docs, ix.Analysis([], ())), spark.createDataFrame([("alle", 1)], "word string, x int"), "word", "doc_id")
    assert joined.count() == 4000 and largest_partition(joined) < 2000


@pytest.mark.parametrize("steps", [(), analyzer.LIGHT, analyzer.FULL])
def test_likely_first_terms(spark, steps):
    """What the look at first letters leaves out is no query term."""
    analysis = ix.Analysis(["der"], steps)
    texts = ["Öfen", "öfen", "der-Ofen", "Ähre 1", "ßa", "Schule", "schön", "Überfluss", "ueber", "éa", "12,5", "d.h.", "x(Ofen)", "_Ofen", "Straße", "", "..."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    terms = [r.x for r in rows.select(F.explode(F.transform(analysis.words(F.col("t")), analysis.term)).alias("x")).distinct().collect()]
    full = F.try_element_at(F.transform(analysis.words(F.col("t")), analysis.term), F.lit(1))
    for some in ([t] for t in terms):
        got = rows.select(full.alias("a"), analysis.first_likely(F.col("t"), some).alias("b")).collect()
        assert all((r.a in some) == (r.b in some) for r in got)
    assert rows.select(analysis.first_likely(F.col("t"), []).alias("b")).filter("b IS NOT NULL").count() == 0
