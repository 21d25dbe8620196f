"""Texts that were cut off before their end, in SQL alone.

Trigrams of words are counted inside texts, and how often they stand at the
end of a sentence or line; a text whose last trigram is frequent inside but
almost never at an end was cut. Words are counted by their form, so that names
and numbers do not thin the counts out: a number counts as ``0``, a capitalised
word of over five letters as ``N``, a lower-case one of over six by its last
three. What stands last in a text without a stop is not counted, as it is what
has to be judged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.skew import salted_join, spread_join
from textloom.operators.staging import written

#: Words, sentence ends, line ends.
TOKEN = r"[\p{L}\p{N}]+|[.?!]+(?:\s|\z)|\n"
SPACE = " \t\n\r\f\v\u00a0"
#: What stands for a missing rest at the very end.
STAND_INS = ("…", "...", "[…]", "[...]", "\ufffd")
#: Such signs, and those that something has to follow, are no part of the last trigram.
BRACKETED, DOTS, SIGNS = "[…].", "….", ",;:–-\ufffd"
#: Openers whose closer must follow later in the text: opener, what shows that it is closed.
PAIRED = (("[[", "]]"), ("{{", "}}"), ("{|", "|}"), ("<!--", "-->"), ("\\begin{", "\\end{"))
#: Elements that must be closed; those closed in themselves hold nothing.
ELEMENTS = ("ref", "pre", "source", "syntaxhighlight", "math", "nowiki", "gallery", "table", "code")
#: An end of the text inside a tag, or an entity.
OPEN_TEXT = r"<[\p{L}/!][^<>]*\z|&#?[\p{L}\p{N}]*\z"
#: Ends of a last paragraph inside a link, a bracket, or a quotation.
OPEN_PARAGRAPH = r"\[[^\[\]]*\z|\([^()]*\z|»[^»«]*\z|„[^„“”]*\z"
#: Ends of a last line inside a heading, or a table.
OPEN_LINE = r"^=+[^=]+=?\z|^\|([^}]|\z)"
#: Marks that come in pairs within a line, and within a paragraph.
TWINS = (("line", "'{2,}"), ("para", '"'))
#: A last line that is a list entry.
ENTRY = r"^[ \t]*([*#+-]|[0-9]+\.)[ \t]"
#: Ends with a word or number, or with a sign that something has to follow.
LOOSE = r"[\p{L}\p{N}]\z"
DANGLING = r"[,;:–-]\z"


def token_class(x: str) -> str:
    first = f"substring({x}, 1, 1)"
    return f"""CASE WHEN {x} IS NULL OR {first} IN ('.', '?', '!', '\\n') THEN '.' WHEN {first} BETWEEN '0' AND '9' THEN '0'
        WHEN length({x}) > 5 AND {first} <> lower({first}) THEN 'N' WHEN length({x}) <= 6 THEN {x} ELSE concat('~', right({x}, 3)) END"""


def trigram(a: str, b: str, c: str) -> list[str]:
    """Classes of three tokens in a row; what lies before a sentence end is not looked at."""
    return [f"CASE WHEN {token_class(b)} = '.' THEN '.' ELSE {token_class(a)} END AS a", f"{token_class(b)} AS b", f"{token_class(c)} AS c"]


def counts(texts: DataFrame) -> DataFrame:
    """(a, b, c, word, n, ends): of every trigram of classes (word null) and every word (a, b, c null) that something follows its occurrences, and those that a sentence or line end follows.

    ``texts``: (t string). One pass: each text's tokens are zipped with
    themselves, shifted, and both groupings are combined by hash in the task.
    """
    tokens = texts.select(F.concat(F.array(F.lit("."), F.lit(".")), F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0))).alias("k"))
    shifted = tokens.selectExpr("k AS p", *(f"slice(k, {i}, size(k)) AS {x}" for i, x in ((2, "q"), (3, "r"), (4, "s"))))
    rows = shifted.select(F.explode(F.arrays_zip("p", "q", "r", "s")).alias("z")).select("z.*")
    rows = rows.filter("s IS NOT NULL AND substring(r, 1, 1) NOT IN ('.', '?', '!', '\\n')")
    each = rows.selectExpr(*trigram("p", "q", "r"), "r AS word", "substring(s, 1, 1) IN ('.', '?', '!', '\\n') AS e")
    keys = [F.col(x) for x in ("a", "b", "c", "word")]
    return each.groupingSets([keys[:3], keys[3:]], *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e").cast("bigint")).alias("ends"))


def judged(
    documents: DataFrame, *, rare: float = 0.1, rare_at_limit: float = 0.9, least: int = 3, broken: int = 50, limit_share: float = 0.02, limit_least: int = 5
) -> DataFrame:
    """(doc_id, source, reason): every document with a text; one whose text breaks off has a reason, all others null.

    The first of these that holds: ``trigram``: the last trigram is at an end
    in less than ``rare`` of its occurrences inside texts; ``word``: for each
    time the last word stands whole inside a text, longer words that begin with
    it do over ``broken`` times; ``stand-in``: the end says that something is
    missing; ``open``: markup, a bracket or a quotation is left open;
    ``sign``: it ends with a comma or the like, or with a blank after a word.

    Trigrams seen fewer than ``least`` times elsewhere give way to their last
    two words, then to the last, then to the two before it; the rates of these
    are over all trigrams, however rare. Other texts that end so without a stop
    count as ends. A last word that is no whole one is judged by the two before
    it. Stand-ins and signs at the end are no part of the trigram.
    Where ``limit_share`` of a source's different texts, and ``limit_least`` at
    least, have the same length in characters or bytes, that length is a limit
    (in bytes, also up to three under it, where a character of several was
    hit), and ``rare_at_limit`` holds. List entries need no sentence end, so no
    trigram is asked for, but a word broken off counts in them, too. Null and
    empty texts are left out. Other columns are not read; equal texts are
    judged alike. Runs jobs when it is called, for the counts and the ends.
    """
    docs = documents.select(
        "doc_id", "source", F.rtrim("text", F.lit(SPACE)).alias("t"), F.col("text").endswith(" ").alias("blank"),
        F.length("text").alias("chars"), F.octet_length("text").alias("bytes"),
    ).filter("length(t) > 0")
    # all of them, as the rates of fewer words are sums over them
    counted = written(counts(docs.select("t")))
    tri = counted.filter("word IS NULL")
    sums = [F.sum("ends").alias("ends"), F.sum("n").alias("n")]
    # Merged, never broadcast: the engine takes the size of written files for that of their rows, and takes it before rows
    # are cut into beginnings or repeated for places, so it would bring far more to the driver than it allows.
    known = lambda df, k: df.withColumnsRenamed({"n": f"n{k}", "ends": f"ends{k}"}).hint("merge")
    # how often what begins a word is a word, and how often it goes on
    begins = counted.filter("word IS NOT NULL").select("word", "n")
    begins = begins.select(F.explode(F.expr("transform(sequence(1, length(word)), k -> substring(word, 1, k))")).alias("last"), (F.length("word") > F.length("last")).alias("on"), "n")
    begins = begins.groupBy("last").agg(F.sum(F.when(F.col("on"), F.col("n")).otherwise(-broken * F.col("n"))).alias("lack"))
    begins = begins.filter("lack > 0").select("last", F.lit(True).alias("part")).hint("merge")

    ends = docs.withColumns({"line": F.substring_index("t", "\n", -1), "para": F.substring_index("t", "\n\n", -1)})
    ends = ends.withColumn("core", F.when(F.col("t").endswith("…]") | F.col("t").endswith("...]"), F.rtrim("t", F.lit(BRACKETED + SPACE))).when(F.col("t").endswith("…") | F.col("t").endswith("..."), F.rtrim("t", F.lit(DOTS + SPACE))).otherwise(F.col("t")))
    ends = ends.withColumn("core", F.rtrim("core", F.lit(SIGNS + SPACE)))
    odd = [f"size(regexp_extract_all({x}, {quoted(p)}, 0)) % 2 = 1" for x, p in TWINS]
    unclosed = [f"(contains(t, {quoted(x)}) AND NOT contains(substring_index(t, {quoted(x)}, -1), {quoted(y)}))" for x, y in PAIRED]
    unclosed += [f"(contains(t, '<{x}') AND substring_index(t, '<{x}', -1) rlike '^(>|[ \\t]([^<>]*[^<>/])?>)' AND NOT contains(substring_index(t, '<{x}', -1), '</{x}'))" for x in ELEMENTS]
    patterns = [f"t rlike {quoted(OPEN_TEXT)}", f"para rlike {quoted(OPEN_PARAGRAPH)}", f"line rlike {quoted(OPEN_LINE)}"]
    shape = ends.select(
        "doc_id", "source", F.coalesce("source", F.lit("")).alias("source_"), "chars", "bytes",
        F.xxhash64("t").alias("h"), F.col("line").rlike(LOOSE).cast("int").alias("own"),
        F.expr(" OR ".join(f"endswith(t, '{x}')" for x in STAND_INS)).alias("stand_in"),
        F.expr(" OR ".join(patterns + odd + unclosed)).alias("open"),
        F.col("line").rlike(ENTRY).alias("entry"),
        (F.col("line").rlike(DANGLING) | (F.col("blank") & F.col("line").rlike(LOOSE) & ~F.col("line").rlike(ENTRY))).alias("sign"),
        F.when(F.col("core").rlike(LOOSE), F.regexp_extract_all(F.substring_index("core", "\n", -1), F.lit(TOKEN), F.lit(0))).alias("k"),
    ).withColumns({"p": F.expr("try_element_at(k, -3)"), "q": F.expr("try_element_at(k, -2)"), "last": F.expr("try_element_at(k, -1)")})
    # a short row for each document, so that texts are read here and for the counts only
    shape = written(shape.selectExpr("*", *trigram("p", "q", "last")).drop("k", "p", "q"))
    all_ = shape.groupBy("source").agg(F.count_distinct("h").alias("of"))
    limits = []
    for k, under in (("chars", 0), ("bytes", 3)):
        sizes = shape.select("source", k, "h").distinct().groupBy("source", k).count()
        found = sizes.join(all_, sizes["source"].eqNullSafe(all_["source"])).filter((F.col("count") >= limit_least) & (F.col("count") >= F.lit(limit_share) * F.col("of")))
        near = F.explode(F.sequence(F.col(k) - under, F.col(k))).alias(k)
        limits.append(found.select(F.coalesce(sizes["source"], F.lit("")).alias("source_"), near, F.lit(True).alias(f"at_{k}")).distinct())
    loose = shape.filter("last IS NOT NULL")
    # each different end is judged once, however many copies it has
    ends = loose.select("h", "a", "b", "c", "last", "own").distinct()
    tails = ends.filter("own = 1").groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n")).withColumn("ends", F.col("n"))
    # read for three, two and one words: as a plan it would be worked out for each of them
    whole = written(tri.select("a", "b", "c", "n", "ends").unionByName(tails).groupBy("a", "b", "c").agg(*sums))
    out = ends.join(known(whole, 3), ["a", "b", "c"], "left").join(known(whole.groupBy("b", "c").agg(*sums), 2), ["b", "c"], "left")
    out = out.join(known(tri.groupBy("a", "b").agg(*sums), 0), ["a", "b"], "left").join(begins, "last", "left")
    # some classes, as that of names, stand at the end of most texts
    out = salted_join(out, known(whole.groupBy("c").agg(*sums), 1), "c", "h", "left")
    p3, p2, p1 = (f"CASE WHEN n{k} - own >= {least} THEN (ends{k} - own) / (n{k} - own) END" for k in (3, 2, 1))
    p0 = f"CASE WHEN n0 >= {least} THEN ends0 / n0 END"
    part = F.coalesce(F.col("part") & (F.col("c") != "0"), F.lit(False)).alias("part")
    rated = written(out.withColumn("part", part).select("h", "part", F.expr(f"CASE WHEN part THEN coalesce({p0}, 1.0) ELSE coalesce({p3}, {p2}, {p1}, {p0}, 1.0) END").alias("rate")))

    marks = "WHEN stand_in THEN 'stand-in' WHEN open THEN 'open' WHEN sign THEN 'sign' END"
    closed = shape.filter("last IS NULL").select("doc_id", "source", F.expr(f"CASE {marks}").alias("reason"))
    each = spread_join(loose.drop("a", "b", "c", "last", "own"), rated.hint("merge"), ["h"]).join(limits[0], ["source_", "chars"], "left").join(limits[1], ["source_", "bytes"], "left")
    judgement = f"CASE WHEN NOT entry AND rate < CASE WHEN at_chars OR at_bytes THEN {rare_at_limit} ELSE {rare} END THEN 'trigram' WHEN part THEN 'word' {marks}"
    return closed.unionByName(each.select("doc_id", "source", F.expr(judgement).alias("reason")))


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, reason): the documents whose text breaks off."""
    return judged(documents).filter("reason IS NOT NULL")


def rates(documents: DataFrame) -> DataFrame:
    """(source, documents, truncated, rate): how often each source truncates; documents without source count as one, those without text as whole."""
    found = judged(documents).groupBy("source").agg(F.count("reason").alias("truncated"))
    n = documents.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    joined = n.join(found, n["source"].eqNullSafe(found["source"]), "left")
    return joined.select(n["source"], "documents", F.coalesce("truncated", F.lit(0)).alias("truncated"), F.round(F.coalesce("truncated", F.lit(0)) / F.col("documents"), 6).alias("rate"))
