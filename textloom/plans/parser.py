"""The query language: text to a tree.

``LINKTO title``; terms ranked by BM25; ``"phrase"`` or ``'phrase'``;
``prefix*``; and in strict mode ``a AND b``, ``a OR b``, ``a BUT NOT b``, from
left to right without precedence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

LINKTO, OPERATORS = "LINKTO ", (" AND ", " OR ", " BUT NOT ")
_SPLIT = re.compile("( AND | OR | BUT NOT )")
#: The leftmost pair of like quotes; an apostrophe inside a word is none.
PHRASE = r"(?<!\w)'(.*?)'(?!\w)|\"(.*?)\""
_PHRASE = re.compile(PHRASE, re.S)
_PREFIX = re.compile(r"[^\s*]*\*")


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Prefix:
    text: str


@dataclass(frozen=True)
class Phrase:
    text: str


@dataclass(frozen=True)
class Link:
    title: str


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class ButNot:
    left: object
    right: object


@dataclass(frozen=True)
class Keyword:
    """A ranked query: all its text, and the phrases and prefixes that restrict it."""

    text: str
    restrictions: tuple = ()

    @property
    def rest(self) -> str:
        """What is left beside phrases and prefixes."""
        return _PREFIX.sub(" ", _PHRASE.sub(" ", self.text)).strip()


def without_operators(query: str) -> str:
    for op in OPERATORS:
        query = query.replace(op, " ")
    return query


def plain(query: str) -> str:
    """Without any operator or quote, for analysis."""
    return re.sub(r"['\"*]", "", without_operators(query).replace(LINKTO, ""))


def atom(text: str):
    if "*" in text:
        return Prefix(text.strip().split("*")[0].strip().lower())
    m = _PHRASE.search(text)
    return Phrase(m[1] if m[1] is not None else m[2]) if m else Term(text.strip())


def boolean(query: str):
    parts = _SPLIT.split(query)
    tree = atom(parts[0])
    for op, part in zip(parts[1::2], parts[2::2]):
        tree = {" AND ": And, " OR ": Or, " BUT NOT ": ButNot}[op](tree, atom(part))
    return tree


def restrictions(text: str) -> tuple:
    """Phrases, then prefixes of the rest."""
    found = [Phrase(m[1] if m[1] is not None else m[2]) for m in _PHRASE.finditer(text)]
    found += [Prefix(m[0][:-1].lower()) for m in _PREFIX.finditer(_PHRASE.sub(" ", text)) if len(m[0]) > 1]
    return tuple(found)


def parse(query: str | None, *, strict: bool = False):
    """The tree of a query; None for a null one."""
    if query is None:
        return None
    if LINKTO in query:
        return Link(query.replace(LINKTO, "").strip())
    if strict and any(op in query for op in OPERATORS):
        return boolean(query)
    text = without_operators(query)
    return Keyword(text, restrictions(text))
