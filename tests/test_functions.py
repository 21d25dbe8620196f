import pytest
from pyspark.sql import functions as F

from textloom.functions import analyzer, snippet, wikitext


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("title", "key"), [(" Große Flut ", "großeflut"), ("St. Odral-Stift", "stodralstift"), ("a:b,c;d", "abcd"), ("\tX\n", "x"), (".", ""), ("", ""), (None, None)]
)
def test_title_key(spark, title, key):
    assert one(spark, wikitext.title_key(F.col("t")), t=title) == key


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("[[A]] [[B|b]] [[C#s]] [[D#s|d]]", ["A", "B", "C", "D"]),
        ("[[Kategorie:X]] [[#s]] [[|x]] [A]", []),
        ("[[A]] [[A]]", ["A", "A"]),
        ("", []),
        (None, None),
    ],
)
def test_wiki_links(spark, text, found):
    assert one(spark, wikitext.wiki_links(F.col("t")), t=text) == found


def test_link_targets_take_urls_into_the_wiki(spark):
    text = "[[A]] [http://de.wikipedia.org/wiki/B_c Text] [http://x.example/D d] [[A]]"
    assert one(spark, wikitext.link_targets(F.col("t")), t=text) == ["A", "B_c"]
    assert one(spark, wikitext.link_targets(F.col("t"), decode_urls=True), t=text) == ["A", "B c"]


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("'''fett''' und ''kursiv''", "fett und kursiv"),
        ("== Lage ==\nText", "Lage \nText"),
        ("[[Datei:a.jpg|b]]x [[Ziel|Name]] [[Ort]]", "x Name Ort"),
        ("[http://a.example Name] {{Vorlage|x}}<ref>r</ref>", "Name"),
        ("a  b&nbsp;c", "ab c"),
        ("\t x \n", "x"),
        ("", ""),
        (None, ""),
    ],
)
def test_clean_text(spark, text, plain):
    assert one(spark, wikitext.clean_text(F.col("t")), t=text) == plain


@pytest.mark.parametrize(
    ("word", "normal", "light", "full"),
    [
        ("häuser", "hauser", "haus", "hau"), ("haeuser", "hauser", "haus", "hau"), ("quelle", "quelle", "quell", "quell"), ("steuer", "steuer", "steu", "steu"),
        ("flüsse", "flusse", "fluss", "fluss"), ("straße", "strasse", "strass", "strass"), ("kindern", "kindern", "kind", "kind"), ("matrizen", "matrizen", "matriz", "matrix"),
        ("3d", "3d", "3d", "3d"), ("ab", "ab", "ab", "ab"),
    ],
)
def test_stems(spark, word, normal, light, full):
    w = F.col("w")
    assert one(spark, F.array(analyzer.normalized(w), analyzer.term(w, analyzer.LIGHT), analyzer.term(w)), w=word) == [normal, light, full]


def strip_reference(w):
    """The second stemmer, step by step on a list of letters."""
    if not w.isalpha():
        return w
    s = []
    for c in w.replace("ß", "ss").translate(str.maketrans("äöü", "aou")):
        s.append("*" if s and s[-1] == c else c)
    t, hidden = "".join(s), 0
    for group, sign in analyzer.GROUPS:
        hidden += t.count(group) * (len(group) - 1)
        t = t.replace(group, sign)

    def strip(t):
        while len(t) > 3:
            n = len(t) + hidden
            if n > 5 and t.endswith("nd") or n > 4 and t.endswith(("em", "er")):
                t = t[:-2]
            elif t[-1] in "esnt":
                t = t[:-1]
            else:
                break
        return t

    t = strip(t)
    if len(t) > 5 and t.endswith("erin*"):
        t = strip(t[:-1])
    if t.endswith("z"):
        t = t[:-1] + "x"
    out = ""
    for c in t:
        out += out[-1] if c == "*" and out else c
    for group, sign in analyzer.GROUPS:
        out = out.replace(sign, group)
    return out.replace("gege", "ge", 1) if len(out) > 4 else out


def test_second_stem_against_steps(spark):
    words = "lehrerinnen gegessen schiffe wasser fahrrad bauern schwestern kirchen zeiten hund hundes leitend gerade matrizen ei tee see gegend b2b büßer".split()
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", analyzer.second_stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in rows} == {w: strip_reference(w) for w in words}


def test_stop_words(spark):
    line = "aber, Alle, , oder?, aber,z.b"
    assert analyzer.parse_stop_words(line) == ["aber", "alle", "oder?", "z.b"]
    assert " Alle" in analyzer.parse_stop_words(line, literal=True)
    kept = analyzer.without(analyzer.tokens(F.col("t")), ["und"])
    assert one(spark, kept, t="Und rot und rot") == ["rot", "rot"]
    assert one(spark, kept, t=None) is None


def snippet_reference(text, hit):
    def blank(k):
        return text.rfind(" ", 0, k + 1) if k >= 0 else -1

    if hit is None:
        end = min(240, len(text))
        if (s := blank(end - 1)) > 200:
            end = s
        return text[:end].replace("\n", " ") + "..."
    p, start = text.find(hit), 0
    if p > 100:
        start = blank(p - 100) + 1
        if p - start > 140:
            start = p - 100
    end = min(p + 120, len(text))
    if (s := blank(end - 1)) - start > 200:
        end = s
    return ("..." if start else "") + text[start:end].replace("\n", " ") + "..."


def test_snippets(spark):
    words = [f"wort{i}" for i in range(120)]
    texts = [" ".join(words), "ziel " + " ".join(words), " ".join(words[:60]) + " ziel, " + " ".join(words), "x" * 400 + " ziel", "kurz", "a\nb ziel"]
    first = lambda piece: F.try_element_at(analyzer.tokens(piece), F.lit(1))
    column = snippet.snippet(F.col("t"), first, F.array(F.lit("ziel")))
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column.alias("s")).collect()]
    hits = [next((p for p in t.split(" ") if p.strip(",").split("\n")[0].lower() == "ziel"), None) for t in texts]
    assert got == [snippet_reference(t, h) for t, h in zip(texts, hits)]
    assert one(spark, column, t="") is None and one(spark, column, t=None) is None


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("d.h. z.B.", ["d.h", "z.b"]), ("3,14 und 1.000.000, 5", ["3,14", "und", "1.000.000", "5"]), ("can't o’clock 'x'", ["can't", "o’clock", "x"]), ("Kategorie:Ort : x", ["kategorie:ort", "x"]),
        ("a,b a.1 1.a a1.b2", ["a", "b", "a", "1", "1", "a", "a1", "b2"]), ("foo_bar __", ["foo_bar", "__"]), ("e\u0301te\u0301", ["e\u0301te\u0301"]), ("... ,,, ", []), ("", []),
    ],
)
def test_word_breaks(spark, text, words):
    assert spark.createDataFrame([(text,)], "t string").select(analyzer.tokens(F.col("t")).alias("w")).first().w == words
