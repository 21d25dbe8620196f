"""Wiki text as column expressions: title keys, link targets, markup cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters a title key leaves out (fixed values).
KEY_DROPS = " .:,;-"

#: Control characters and blank at either end, as the JVM's trim takes them.
EDGES = r"^[\x00-\x20]+|[\x00-\x20]+$"

#: ``[[target]]``, ``[[target|label]]``, each with an optional ``#section``.
WIKI_LINK = r"\[\[([^:#|\]]+)(?:#[^|\]]*)?(?:\|[^\]]*)?\]\]"

#: Fixed value: external link to an article of the German wiki.
URL_LINK = r"\[http://de\.wikipedia\.org/wiki/([^ :#\]]+)[^\]]*\]"

#: The ordered rewrites that turn wiki text into plain text, (pattern, replacement).
CLEANING = (
    (r"'''", ""),
    (r"''", ""),
    (r"==+", ""),
    (r"\[\[Datei:[^\]]*\]\]", ""),
    (r"\[\[[^|\]]+\|", ""),
    (r"\[\[", ""),
    (r"\]\]", ""),
    (r"\[\w+://[^\s]+\s", ""),
    (r"\[", ""),
    (r"\]", ""),
    (r"\{\{[^}]*\}\}", ""),
    (r"\{\{", ""),
    (r"\}\}", ""),
    (r"\{[^}]*\}", ""),
    (r"\|(.*)\n", ""),
    (r"<gallery>[^<]*</gallery>", ""),
    (r"<ref>[^<]*</ref>", ""),
    (r"#WEITERLEITUNG", ""),
    (r"<[^>]*>", ""),
    (r"\n(.*):\\mathrm(.*)\n", "\n"),
    (r"  ", ""),
    (r"\n ", "\n"),
    (r"\n\n\n", "\n\n"),
    (r"&nbsp;", " "),
)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def title_key(c: Column) -> Column:
    """Trimmed, lower-cased, without blank ``. : , ; -``; null stays null."""
    return F.translate(F.lower(trim(c)), KEY_DROPS, "")


def wiki_links(text: Column) -> Column:
    """Raw targets of all internal links, one per occurrence; null text gives null."""
    return F.regexp_extract_all(text, F.lit(WIKI_LINK), F.lit(1))


def link_targets(text: Column, *, decode_urls: bool = False) -> Column:
    """Distinct raw targets of internal links and of URLs into the wiki."""
    urls = F.regexp_extract_all(text, F.lit(URL_LINK), F.lit(1))
    if decode_urls:
        urls = F.transform(urls, lambda u: F.translate(F.try_url_decode(u), "_", " "))
    return F.array_distinct(F.concat(wiki_links(text), urls))


def clean_text(text: Column) -> Column:
    """Plain text of a page: tabs to blanks, then CLEANING in order, each in one pass; null counts as empty."""
    start = F.translate(F.coalesce(text, F.lit("")), "\t", " ")
    return trim(reduce(lambda c, rule: F.regexp_replace(c, *rule), CLEANING, start))
