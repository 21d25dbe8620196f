"""Snippets of plain texts as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.config import DEFAULTS, Settings
from textloom.functions.bind import let


def last_blank(text: Column, at: Column) -> Column:
    """0-based place of the last blank at or before ``at``; -1 if there is none."""
    head = F.substring(text, F.lit(1), F.greatest(at + 1, F.lit(0)))
    return let(head, lambda h: let(F.instr(F.reverse(h), " "), lambda back: F.when(back == 0, F.lit(-1)).otherwise(F.length(h) - back)))


def _line(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def head_snippet(text: Column) -> Column:
    """The beginning, to about 240 characters, cut at a blank if one lies beyond 200."""
    end = F.least(F.length(text), F.lit(240))
    cut = let(last_blank(text, end - 1), lambda blank: F.when(blank > 200, blank).otherwise(end))
    return F.concat(_line(F.substring(text, F.lit(1), cut)), F.lit("..."))


def hit_snippet(text: Column, piece: Column) -> Column:
    """Around the first place where ``piece`` stands in the text."""

    def begin(p: Column) -> Column:
        far = let(last_blank(text, p - 100) + 1, lambda near: F.when(p - near > 140, p - 100).otherwise(near))
        return F.when(p <= 100, F.lit(0)).otherwise(far)

    def shown(span: Column) -> Column:
        start, end = span["start"], span["end"]
        cut = let(last_blank(text, end - 1), lambda blank: F.when(blank - start > 200, blank).otherwise(end))
        body = _line(F.substring(text, start + 1, cut - start))
        return F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), body, F.lit("..."))

    span = let(F.position(piece, text) - 1, lambda p: F.struct(begin(p).alias("start"), F.least(p + 120, F.length(text)).alias("end")))
    return let(span, shown)


def snippet(text: Column, first_terms: Callable[[Column], Column], terms: Column, settings: Settings = DEFAULTS) -> Column:
    """Snippet of a plain text for an array of query terms; null for null or empty texts.

    The window is split at blanks into a bounded number of pieces; the hit is
    the first piece whose first analysed term is a query term.
    ``first_terms``: from a piece to its first analysed term.
    """

    def of(window: Column) -> Column:
        hits = F.filter(F.split(window, " ", settings.pieces), lambda piece: F.coalesce(F.array_contains(terms, first_terms(piece)), F.lit(False)))
        made = let(F.try_element_at(hits, F.lit(1)), lambda hit: F.when(hit.isNull(), head_snippet(window)).otherwise(hit_snippet(window, hit)))
        return F.when(F.length(window) > 0, made)

    return let(F.substring(text, 1, settings.window), of)
