import time
from collections import Counter

import pytest

from textloom.llm import markup


def elements(text):
    return [(k, c) for _, k, c in markup.read(text)[1]]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("== Lage ==\nText", [("heading", "Lage")]),
        ("=== ''Bau'' [[Ziel|und]] [[Nutzung]]&nbsp;II === ", [("heading", "Bau und Nutzung II")]),
        ("== [http://a.example/1 Name] &amp; Umland ==", [("heading", "Name & Umland")]),
        ("## **Name** ##\n### Bau `und` Nutzung", [("heading", "Name"), ("heading", "Bau und Nutzung")]),
        ("# Erster\n# Zweiter", [("item", "Erster"), ("item", "Zweiter")]),
        ("Siehe [auch](http://b.example)\n=====\n\n**Aufbau**\n-----", [("heading", "Siehe auch"), ("heading", "Aufbau")]),
        ("Text.\n\n----\n\nText.", []),
        ("`Umland`\n----\n\n<!-- x -->Ort `a`\n===\n\n<pre>b</pre>\n----\n$c$\n----", [("heading", "Umland"), ("heading", "Ort a"), ("code", "b"), ("formula", "c")]),
        ("* a\n** b\n*c\n:* d\n:*e", [("item", x) for x in "abcde"]),
        ("- a\n+ `b` c\n1. d\n2) *e* f", [("item", "a"), ("item", "b c"), ("item", "d"), ("item", "e f")]),
        ("<h2 id='s'>\n  Fluss <a href='/w'>der</a> Stadt\n</h2>", [("heading", "Fluss der Stadt")]),
        ("<ul><li class='k'><b>a</b> b</li>\n<LI>c\n</LI></ul>", [("item", "a b"), ("item", "c")]),
        (r"\section*{Bau \textbf{und} Nutzung}" "\n" r"\paragraph{\emph{X}}", [("heading", "Bau und Nutzung"), ("heading", "X")]),
        ("\\begin{itemize}\n\\item \\emph{a} b\n\\item c\n\\end{itemize}", [("item", "a b"), ("item", "c")]),
        ('<source lang="c">1. Schritt\n  x += i\n== E ==</source>', [("code", "1. Schritt x += i == E ==")]),
        ("```python\n* a\n# b\n```\n~~~\n$x$\n~~~", [("code", "* a # b"), ("code", "$x$")]),
        ("\\begin{verbatim}\n\\item x\n\\end{verbatim}", [("code", "\\item x")]),
        ("<pre class='z'>\n&lt;b&gt;\n</pre>", [("code", "&lt;b&gt;")]),
        ("Es gilt $a_1 = b$ und \\(c\\), auch <math>d < e</math>.", [("formula", "a_1 = b"), ("formula", "c"), ("formula", "d < e")]),
        ("$$\nx\n$$\n\\[ y \\]\n:<math display='block'>\nz\n</math>\n\\begin{equation}\nw\n\\end{equation}", [("formula", x) for x in "xyzw"]),
        ("Kostet US$ 809; siehe C# und A_1. Kostet US$ 5.", []),
        ("3 * 4 Grad<ref>R: a, 1.</ref> und\t-5 Grad", []),
        ("<!-- == X ==\n* y\n-->Text", []),
        ("<!-- <pre> -->\n* a\n<pre>\n<!-- b -->\n</pre>", [("item", "a"), ("code", "<!-- b -->")]),
        ("{| class='x'\n! Ort\n|-\n| a || b\n|}\n{{Infobox\n| Name = x\n}}\n<gallery>\na.png|b\n</gallery>", []),
        ("", []),
        ("== ==\n*\n* ", []),
    ],
)
def test_elements(text, found):
    assert elements(text) == found


def test_clean_text():
    sentence = "Der Ort liegt am Fluss, der im Jahr 1900 begradigt wurde. " * 5
    text = f"{sentence}\n\n== Lage ==\n* [[Ziel|a]]\n\n{sentence}Es gilt $x$.\n\n{{| class='t'\n| a || b\n|}}\n[[Kategorie:X]]"
    clean = markup.read(text)[0]
    assert "## Lage" in clean and "- a" in clean and "$x$" in clean and sentence.strip() in clean
    assert "```\na = 1\n  b\n```" in markup.read("<pre>\na = 1\n  b\n</pre>")[0]  # code keeps its lines
    assert "[[" not in clean and "{|" not in clean and "Kategorie" not in clean


def test_table(spark):
    rows = [(1, "* a", "x"), (1, "* a", "x"), (2, None, "x"), (3, "", "x"), (None, "* b", "x")]
    df = spark.createDataFrame(rows, "id long, text string, leaves string")
    assert sorted((r.id or 0, r.clean_text) for r in markup.cleaned(df).collect()) == [(0, "- b"), (1, "- a"), (1, "- a"), (3, "")]
    assert sorted((r.id or 0, r.kind, r.content) for r in markup.elements(df).collect()) == [(0, "item", "b"), (1, "item", "a"), (1, "item", "a")]
    assert markup.cleaned(df.filter("false")).count() == 0 and markup.elements(df.filter("false")).count() == 0


SENTENCE = "Der Ort liegt am Fluss, der im Jahr 1900 begradigt wurde, und ist alt. " * 3
BIG_CODE = "<pre>\n" + "x = foo(1, 2); y = x.z\n" * 300 + "</pre>"
BIG_TABLE = "{| class='x'\n" + "|-\n| Ort || 12 || 1900\n" * 200 + "|}"


@pytest.mark.parametrize("extra", [BIG_CODE, BIG_TABLE, BIG_CODE + "\n" + BIG_TABLE, "<gallery>\n" + "a.png|b\n" * 500 + "</gallery>", "{{X\n" + "| a = 1\n" * 500 + "}}"])
def test_one_large_leaf_does_not_tilt_the_choice(extra):
    text = "\n\n".join([SENTENCE] * 10) + "\n" + extra
    clean = markup.read(text)[0]
    assert clean.count(SENTENCE.strip()) == 10
    assert not any(x in clean for x in ("{|", "|-", "{{", ".png", "||")) and ("x = foo" in clean) == (BIG_CODE in extra)


def test_paths_are_chosen_over_the_collection(spark):
    """A record of nothing but a table has no running text to compare with; over the collection its path goes all the same."""
    rows = [(i, f"{SENTENCE}\n\n== Lage ==\n* a\n\n{SENTENCE}\n[[Kategorie:X]]") for i in range(20)] + [(100, BIG_TABLE), (101, "{{Kasten\n| a = 1\n}}"), (102, SENTENCE)]
    got = {r.id: r.clean_text for r in markup.cleaned(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got[100] == got[101] == "" and got[102] == SENTENCE.strip() and all("## Lage" in got[i] and "Kategorie" not in got[i] for i in range(20))
    sums, beside, kinds = markup.paths(markup.leaves(spark.createDataFrame(rows, "id long, text string")))
    by_hand: Counter = Counter()
    for _, t in rows:
        s, b = markup.ratios(markup.leaves_of(t))
        by_hand.update(b)
        for path, (n, size, marks) in s.items():
            have = sums[path]
            sums[path] = (have[0] - n, have[1] - size, have[2] - marks)
    assert by_hand == beside and kinds == {"body/h2", "body/ul/li"}
    assert all(n == 0 and abs(x) < 1e-6 and abs(y) < 1e-6 for n, x, y in sums.values())


def test_paths_stay_few():
    text = "<table>" + "".join(f"<ref>{{{{X|$a_{i}$}}}}</ref>" for i in range(50)) + "</table>"
    assert all(p.count("/") < markup.DEPTH for p, _, _ in markup.leaves_of(text))
    assert markup.clipped("body/table/ref/template/ul/li") == "body/template/ul/li"


def test_long_text_takes_linear_time():
    text = "Ein Satz mit [[Ziel|Wort]]. " * 20_000 + "\n* a\n" * 5_000
    assert len(elements(text)) == 5_000


@pytest.mark.parametrize("bit", ["<pre>", "<pre", "<math>", "$$ x ", "$x ", "{{", "{| ", "\n{|", "<ref>", "<h2>", "<li>", r"\item[", r"\section{", "**a ", "[[", "`", r"\begin{equation}", "<!-", "__a "])
def test_openers_that_are_never_closed_take_linear_time(bit):
    began = time.perf_counter()
    markup.read(bit * 20_000 + " Ende.")
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("{| class='x'\n! Ort\n|-\n| <math>a</math> || b\n|\n* [[Ziel|c]]\n== D ==\n|}", [("formula", "a"), ("item", "c"), ("heading", "D")]),
        ("<table><tr><td><h3>A</h3>\n<ul><li>b</li></ul>\n<pre>c</pre></td></tr></table>", [("heading", "A"), ("item", "b"), ("code", "c")]),
        ("Text<ref>Siehe $a$.\n# b\n</ref> und {{Kasten\n| x = \\(c\\)\n* d\n}}", [("formula", "a"), ("item", "b"), ("formula", "c"), ("item", "d")]),
        ("<table>\n<td>a<ref>{{X|$b$}}</ref></td></table>", [("formula", "b")]),
        ("<gallery>\n1. Bild.png|a $b$\n* c.png|d\n</gallery>", [("formula", "b")]),
        ("Text<ref>1. Mose 3</ref><ref>* a</ref><ref>== a ==</ref><ref>a\n---\n</ref><ref><!-- $a$ --></ref>", []),
    ],
)
def test_elements_in_wholes(text, found):
    assert elements(text) == found
    clean = markup.read(text, 0)[0]
    assert "\x02" not in clean and "\x03" not in clean and all(clean.count(c) >= 1 for _, c in found)


def test_running_text_of_a_whole_is_left_to_the_ratio():
    clean = markup.read("Der Ort liegt am Fluss, der im Jahr 1900 begradigt wurde. " * 5 + "\n\n{|\n| y\n|\n* b\n|}\n\nEnde, im Jahr 1900.")[0]
    assert "- b" in clean and "y" not in clean
