"""Clean text from wiki markup, Markdown, HTML and LaTeX, mixed as they come.

A text is read into leaves, each with its path of tags from the root (wiki,
Markdown and LaTeX constructs count as the tags they stand for). Content is
chosen by tag-path ratios: text length and punctuation are aggregated per path
over the whole collection, smoothed with the paths that stand beside it, fused,
and paths under a share of the running text's go. Logarithms are summed, so
that no single large leaf tilts a path. Headings, list items, code blocks and
formulas are short or bare of punctuation by nature, so their paths stay: the
threshold is for all others.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Collection, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.staging import written

#: Of the running text's fused ratio, what a path needs to be content.
SHARE = 0.6

HEADING, ITEM, CODE, FORMULA = "heading", "item", "code", "formula"

#: Where something begins that is taken whole: comments, code, formulas, and things that are no running text. The first to begin holds.
OPENER = re.compile(
    r"""
    (?P<comment><!--)
  | <(?P<code>source|syntaxhighlight|pre|listing|xmp)\b[^<>]*>
  | ^[ \t]{0,3}(?P<fence>`{3,}|~{3,})[^\n`]*\n
  | \\begin\{(?P<codeenv>verbatim\*?|lstlisting|minted)\}(?:\[[^\[\]\n]*\])?
  | <(?P<literal>nowiki)>
  | `(?P<ticks>[^`\n]+)`
  | <(?P<math>math)\b[^<>]*(?<!/)>
  | \\begin\{(?P<mathenv>(?:equation|align|gather|multline|displaymath|math|eqnarray)\*?)\}
  | (?<!\\)(?P<dollars>\$\$)
  | (?P<display>\\\[)
  | (?P<inline>\\\()
  | (?<![\\\w$])\$(?=[^\s$])(?P<dollar>[^$\n]*)(?<![\s\\])\$(?![\d$])
  | <(?P<aside>gallery|ref|table)\b[^<>]*(?<!/)>
  | ^(?P<wtable>\{\|)
  | (?P<template>\{\{[^{}]*\}\})
    """,
    re.X | re.M | re.I,
)
#: How each ends; ``{}`` stands for the name in the opener.
CLOSERS = {
    "comment": "-->", "code": r"</{}\s*>", "fence": r"^[ \t]{{0,3}}{}[`~]*[ \t]*$", "codeenv": r"\\end\{{{}\}}", "literal": r"</{}>", "math": r"</{}\s*>",
    "mathenv": r"\\end\{{{}\}}", "dollars": r"\$\$", "display": r"\\\]", "inline": r"\\\)", "aside": r"</{}\s*>", "wtable": r"^\|\}}",
}
#: What runs to the end of the text if it is never closed.
UNBOUND = ("comment", "fence")
CODES = ("code", "fence", "codeenv")
FORMULAS = ("math", "mathenv", "dollars", "display", "inline", "dollar")


@lru_cache(4096)
def closer(kind: str, name: str) -> re.Pattern:
    return re.compile(CLOSERS[kind].format(re.escape(name)), re.M | re.I)


def wholes(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, kind, name, content) of what is taken whole. A closer that is not found is not looked for again, so this takes linear time."""
    at, missing = 0, set()
    while m := OPENER.search(text, at):
        kind = m.lastgroup
        name = m[kind]
        if kind in ("ticks", "dollar", "template"):
            yield m.start(), m.end(), kind, name, name
            at = m.end()
            continue
        key = (kind, name.lower())
        end = None if key in missing else closer(kind, name).search(text, m.end())
        if end is None and kind not in UNBOUND:
            missing.add(key)
            at = m.end()
            continue
        stop = (len(text), len(text)) if end is None else end.span()
        yield m.start(), stop[1], kind, name, text[m.end() : stop[0]]
        at = stop[1]


#: Elements that may span lines: HTML headings and items, LaTeX headings and items.
SPANS = re.compile(
    r"""
    <h(?P<level>[1-6])\b[^<>]*>(?P<h1>(?:(?!<h[1-6]\b).)*?)</h[1-6]\s*>
  | \\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\[\]\n]*\])?\{(?P<h2>(?:[^{}]|\{[^{}]*\})*)\}
  | <li\b[^<>]*>(?P<i1>.*?)(?=</li\b|<li\b|</[ou]l\b|\n[ \t]*\n|\Z)
  | \\item\b(?:\[[^\[\]\n]*\])?(?P<i2>.*?)(?=\\item\b|\\end\{|\n[ \t]*\n|\Z)
    """,
    re.X | re.S | re.I,
)
WIKI_HEADING = re.compile(r"={1,6}[ \t]*([^=\s](?:.*?[^=])?)[ \t]*={1,6}[ \t]*$")
MD_HEADING = re.compile(r"#{2,6}[ \t]+(.*?)[ \t]*#*[ \t]*$|#{2,6}([^#\s].*?)[ \t]*#*[ \t]*$")
UNDERLINE = re.compile(r"(?:={2,}|-{2,})[ \t]*$")
EMPHASIS = re.compile(r"\*\*[^\s*][^*]*\*\*|\*[^\s*][^*]*\*(?![\w*])")
#: ``*``, ``#``, also nested and indented by ``:``, without a blank after stars; ``-``, ``+`` and numbers with one.
LIST_ITEM = re.compile(r"[:;]*(?:\*[*#:]*|#(?=[ \t])|[*#:]+[*#](?=[ \t]))[ \t]*(\S.*)|[ \t]*[-+*][ \t]+(\S.*)|[ \t]*\d{1,9}[.)][ \t]+(\S.*)")
CATEGORY = re.compile(r"\[\[(?:Kategorie|Category|Datei|File|Bild|Image):", re.I)
LEFTOVER = re.compile(r"</?[A-Za-z][^<>]*>|\\(?:begin|end)\{[^{}]*\}")
MARKED = re.compile(r"[\[\]'*`<&\\{}_~\x02]")
KEPT = re.compile("\x02(\\d+)\x03")
#: The control characters that mark kept wholes; a text's own ones count as blanks.
OWN = {2: " ", 3: " "}
#: Punctuation of running text: after a word, before a blank.
PUNCTUATION = re.compile(r"(?<=[\w)\]\"'»“])[.,;:!?](?=\s|$)")
#: Tags of a path that are told apart; of a longer one the first and the last count.
DEPTH = 4

#: Inline rewrites, in order.
INLINE = (
    (re.compile(r"\[\[(?:[^\[\]]*\|)?([^\[\]|]*)\]\]"), r"\1"),
    (re.compile(r"\[\[(?:[^\[\]]*\|)?([^\[\]|]*)\]\]"), r"\1"),
    (re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*(?:[ \t]+\"[^\"]*\")?\)"), r"\1"),
    (re.compile(r"\[[a-z][a-z+.-]*://\S+[ \t]+([^\[\]]*)\]", re.I), r"\1"),
    (re.compile(r"\[([a-z][a-z+.-]*://[^\s\[\]]+)\]", re.I), r"\1"),
    (re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\(?:emph|text[a-z]{2,}|underline|mbox)\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\(?:emph|text[a-z]{2,}|underline|mbox)\{([^{}]*)\}"), r"\1"),
    (re.compile(r"<br\s*/?>", re.I), " "),
    (re.compile(r"</?[A-Za-z][^<>]*>"), ""),
    (re.compile(r"'{2,5}"), ""),
    (re.compile(r"\*\*(?=\S)((?:(?!\*\*).)+)(?<=\S)\*\*"), r"\1"),
    (re.compile(r"__(?=\S)((?:(?!__).)+)(?<=\S)__"), r"\1"),
    (re.compile(r"(?<![\w*])\*(?=[^\s*])([^*]+?)(?<=[^\s*])\*(?![\w*])"), r"\1"),
    (re.compile(r"(?<![\w_])_(?=[^\s_])([^_]+?)(?<=[^\s_])_(?![\w_])"), r"\1"),
    (re.compile(r"~~(?=\S)((?:(?!~~).)+)(?<=\S)~~"), r"\1"),
    (re.compile(r"`([^`]+)`"), r"\1"),
    (re.compile(r"\\([&%_#$*{}])"), r"\1"),
)


def one_line(text: str) -> str:
    return " ".join(text.split())


class Reader:
    """One text, read into leaves (path, kind or None, content) in order.

    ``within``: the text is the content of such a whole. It goes on in the line
    of the opener, so its first line is no heading or item; ``\x03`` stands for
    the opener. In a gallery a line begins with a file name, so none is.
    """

    def __init__(self, text: str, within: str = ""):
        self.flat = within == "gallery"
        self.kept: list[tuple[str, str | None, str]] = []
        self.inner: list[Sequence[tuple[str, str | None, str]]] = []
        self.shown: list[str] = []
        self.leaves: list[tuple[str, str | None, str]] = []
        if "\x02" in text or "\x03" in text:
            text = text.translate(OWN)
        if within:
            text = "\x03" + text
        parts, at = [], 0
        for start, end, kind, name, content in wholes(text):
            parts += text[at:start], self.take(kind, name, content)
            at = end
        parts.append(text[at:])
        body = "".join(parts)
        at = 0
        for m in SPANS.finditer(body):
            self.lines(body[at : m.start()])
            heading = m["h1"] if m["h1"] is not None else m["h2"]
            item = m["i1"] if m["i1"] is not None else m["i2"]
            if heading is not None:
                self.leaf(f"body/h{m['level'] or 2}", HEADING, self.inline(heading))
            else:
                self.leaf("body/ul/li", ITEM, self.inline(item))
            at = m.end()
        self.lines(body[at:])

    def take(self, kind: str, name: str, content: str) -> str:
        """Keeps a whole; gives what stands for it in the text."""
        if kind in CODES:
            return self.keep("body/pre", CODE, content.strip("\n"), "\n\x02{}\x03\n")
        if kind in FORMULAS:
            return self.keep("body/math", FORMULA, one_line(content), "\x02{}\x03", shown=content)
        if kind in ("literal", "ticks"):
            return self.keep("body/p", None, "", "\x02{}\x03", shown=content)
        if kind == "comment":
            return self.keep("body/comment", None, "", "\x02{}\x03")
        path = name.lower() if kind == "aside" else kind
        leaves = Reader(content[2:-2] if kind == "template" else content, path).leaves
        inner = [(f"body/{path}{p.removeprefix('body')}", k, c) for p, k, c in leaves if k]
        if inner:
            content = " ".join(c for _, k, c in leaves if not k).replace("\x03", "")
        return self.keep(f"body/{path}", None, one_line(content), "\x02{}\x03", inner=inner)

    def keep(self, path: str, kind: str | None, content: str, form: str, shown: str = "", inner: Sequence[tuple[str, str | None, str]] = ()) -> str:
        self.kept.append((path, kind, content))
        self.inner.append(inner)
        self.shown.append(shown)
        return form.format(len(self.kept) - 1)

    def put(self, n: int) -> None:
        """The leaf of a kept whole, and those of the elements in it."""
        for leaf in (self.kept[n], *self.inner[n]):
            self.leaf(*leaf)

    def leaf(self, path: str, kind: str | None, content: str) -> None:
        if content and not content.isspace():
            self.leaves.append((path, kind, content))

    def inline(self, text: str, formula: str = "{}") -> str:
        """Without inline markup. Whole elements in it become leaves of their own; formulas and literals also stay in the text."""
        if not MARKED.search(text):
            return one_line(text)
        numbers = [int(n) for n in KEPT.findall(text)]
        for n in numbers:
            self.put(n)
        for pattern, to in INLINE:
            text = pattern.sub(to, text)
        text = html.unescape(text)
        if numbers:
            text = KEPT.sub(lambda m: (formula if self.kept[int(m[1])][1] else "{}").format(self.shown[int(m[1])]), text)
        return one_line(text)

    def worded(self, row: str) -> bool:
        """Whether a row says something beside code, formulas and what is left out."""
        return bool(KEPT.sub(lambda m: "" if self.kept[int(m[1])][1] else self.shown[int(m[1])], row).strip())

    def lines(self, text: str) -> None:
        rows = text.split("\n")
        k = 0
        while k < len(rows):
            row = rows[k]
            k += 1
            if not row or row.isspace():
                continue
            first = row[0]
            if self.flat:
                self.leaf("body/p", None, self.inline(LEFTOVER.sub("", row), "${}$"))
                continue
            if first == "=" and (m := WIKI_HEADING.match(row)):
                self.leaf("body/h2", HEADING, self.inline(m[1]))
                continue
            if first == "#" and (m := MD_HEADING.match(row)):
                self.leaf("body/h2", HEADING, self.inline(m[1] or m[2] or ""))
                continue
            item = None if EMPHASIS.match(row) else LIST_ITEM.match(row)
            if item is None and k < len(rows) and rows[k][:1] in ("=", "-") and UNDERLINE.match(rows[k]) and first not in "=-|!{<\x03" and (first != "\x02" or self.worded(row)):
                self.leaf("body/h2", HEADING, self.inline(row))
                k += 1
                continue
            if item and not UNDERLINE.match(row):
                self.leaf("body/ul/li", ITEM, self.inline(item[item.lastindex]))
                continue
            if CATEGORY.match(row):
                self.leaf("body/category", None, self.inline(row))
            elif first in ":\x02" and not KEPT.sub("", row).strip(": \t"):
                for n in KEPT.findall(row):
                    self.put(int(n))
            elif not UNDERLINE.match(row):
                self.leaf("body/p", None, self.inline(LEFTOVER.sub("", row), "${}$"))


def clipped(path: str) -> str:
    """The path, of at most DEPTH tags: nesting in the texts does not make ever more paths."""
    tags = path.split("/")
    return path if len(tags) <= DEPTH else "/".join([tags[0], *tags[1 - DEPTH :]])


Ratios = dict[str, tuple[int, float, float]]


def ratios(leaves: Sequence[tuple[str, str | None, str]]) -> tuple[Ratios, Counter]:
    """(leaves, sum of log length, sum of log punctuation) of each path, and how often each path stands beside another."""
    sums: Ratios = {}
    for path, _, text in leaves:
        n, size, marks = sums.get(path, (0, 0.0, 0.0))
        sums[path] = n + 1, size + math.log1p(len(text)), marks + math.log1p(len(PUNCTUATION.findall(text)))
    return sums, Counter(pair for (p, _, _), (q, _, _) in zip(leaves, leaves[1:]) for pair in ((p, q), (q, p)))


def fused(sums: Ratios, beside: Counter) -> dict[str, float]:
    """Each path's ratios, smoothed with those of the paths beside its leaves (eight parts its own, one for each side), multiplied."""
    own = {p: np.array([size, marks]) / n for p, (n, size, marks) in sums.items()}
    near = {p: 8 * own[p] * n for p, (n, _, _) in sums.items()}
    weight = {p: 8.0 * n for p, (n, _, _) in sums.items()}
    for (p, q), n in beside.items():
        near[p] = near[p] + n * own[q]
        weight[p] += n
    return {p: float((x := near[p] / weight[p])[0] * math.exp(x[1])) for p in sums}


def chosen(sums: Ratios, beside: Counter, kinds: Collection[str], share: float) -> set[str]:
    """Paths of content: those with a kind, and of the others those whose fused ratio is at least ``share`` of that of the running text, the path in the middle when punctuation is counted out."""
    value = fused(sums, beside)
    rest = sorted((p for p in sums if p not in kinds), key=lambda p: (value[p], p))
    marks = np.cumsum([sums[p][2] for p in rest])
    if not len(marks) or marks[-1] == 0:
        return set(sums)
    least = share * value[rest[int(np.searchsorted(marks, marks[-1] / 2))]]
    return {p for p in sums if p in kinds or value[p] >= least}


def render(kind: str | None, text: str) -> str:
    if kind == HEADING:
        return f"\n## {text}\n"
    if kind == ITEM:
        return f"- {text}"
    if kind == CODE:
        return f"```\n{text}\n```"
    if kind == FORMULA:
        return f"$${text}$$"
    return text


def leaves_of(text: str) -> list[tuple[str, str | None, str]]:
    return [(clipped(p), k, t) for p, k, t in Reader(text).leaves]


def read(text: str, share: float = SHARE) -> tuple[str, list[tuple[str, str, str]]]:
    """The clean text, and its elements (path, kind, content) in order, of a text by itself."""
    leaves = leaves_of(text)
    keep = chosen(*ratios(leaves), {p for p, k, _ in leaves if k}, share)
    there = [leaf for leaf in leaves if leaf[0] in keep]
    return "\n".join(render(k, t) for _, k, t in there).strip(), [(p, k, one_line(t)) for p, k, t in there if k]


LEAF = pa.struct([("path", pa.string()), ("kind", pa.string()), ("content", pa.string()), ("size", pa.float64()), ("marks", pa.float64())])
LEAVES = "array<struct<path:string,kind:string,content:string,size:double,marks:double>>"


def leaves(records: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, leaves): every record whose text is not null, read into leaves (path, kind, content, size, marks); size and marks: logarithms of length and punctuation."""
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                [{"path": p, "kind": k, "content": t, "size": math.log1p(len(t)), "marks": math.log1p(len(PUNCTUATION.findall(t)))} for p, k, t in leaves_of(x)]
                for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(LEAF))], ["key", "leaves"])

    rows = records.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, leaves {LEAVES}").withColumnRenamed("key", key)


def paths(read_in: DataFrame) -> tuple[Ratios, Counter, set[str]]:
    """Sums per path over a collection, pairs of paths side by side, and the paths with a kind. A path has at most DEPTH tags of a fixed set, which bounds what comes to the driver."""
    leaf = read_in.select(F.posexplode("leaves").alias("i", "l"), F.expr("leaves.path").alias("p"))
    each = leaf.select("l.path", "l.kind", "l.size", "l.marks", F.expr("get(p, i - 1)").alias("before"))
    sums: Ratios = {}
    beside: Counter = Counter()
    kinds = set()
    for r in each.groupBy("path", "kind", "before").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("marks").alias("marks")).collect():
        n, size, marks = sums.get(r.path, (0, 0.0, 0.0))
        sums[r.path] = n + r.n, size + r["size"], marks + r.marks
        if r.kind:
            kinds.add(r.path)
        if r.before:
            beside[r.path, r.before] += r.n
            beside[r.before, r.path] += r.n
    return sums, beside, kinds


def content(records: DataFrame, key: str = "id", text: str = "text", *, share: float = SHARE) -> DataFrame:
    """(key, leaves): the leaves of content of every record whose text is not null, by the ratios of their paths over all records.

    An empty text gives no leaves; equal rows come out alike. Runs jobs when it is called: the leaves are written once and read for the ratios and the result.
    """
    there = written(leaves(records, key, text))
    keep = sorted(chosen(*paths(there), share))
    return there.select(key, F.filter("leaves", lambda x: x["path"].isin(keep)).alias("leaves"))


def elements(records: DataFrame, key: str = "id", text: str = "text", *, share: float = SHARE) -> DataFrame:
    """(key, path, kind, content): a row per heading, list item, code block and formula.

    Headings and items without inline markup, links as their label, entities
    resolved; code and formulas as written, in one line. Those in tables,
    templates, galleries and references count as well. Comments hold no
    elements, nor do code blocks.
    """
    each = content(records, key, text, share=share).select(key, F.explode("leaves").alias("l")).filter("l.kind IS NOT NULL")
    return each.select(key, "l.path", "l.kind", F.trim(F.regexp_replace("l.content", r"(?U)\s+", " ")).alias("content"))


def cleaned(records: DataFrame, key: str = "id", text: str = "text", *, share: float = SHARE) -> DataFrame:
    """(key, clean_text): every record whose text is not null.

    In the clean text headings, list items, code blocks and formulas keep a
    mark of what they are; tables, templates, galleries, references, comments
    and category links go unless the ratio of their path says they are running
    text. An empty text gives an empty text.
    """

    def shown(x):
        mark = lambda form: F.format_string(form, x["content"])
        kind = lambda k: x["kind"] == k
        return F.when(kind(HEADING), mark("\n## %s\n")).when(kind(ITEM), mark("- %s")).when(kind(CODE), mark("```\n%s\n```")).when(kind(FORMULA), mark("$$%s$$")).otherwise(x["content"])

    out = content(records, key, text, share=share)
    return out.select(key, F.btrim(F.array_join(F.transform("leaves", shown), "\n"), F.lit(" \t\n\r\f\v")).alias("clean_text"))
