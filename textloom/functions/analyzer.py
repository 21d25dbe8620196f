"""Analysis of German text as column expressions: words, stop words, spelling, two stemmers.

Words follow UAX#29: runs of letters, digits and underscores, which also hold
a sign between two letters (``can't``, ``d.h``) or two digits (``3,14``). Spelling and stemming are meant to be
evaluated once per distinct word (see ``operators.index.stems``), not once per
token.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.bind import let

#: Fixed values of UAX#29: signs that join letters, signs that join digits.
WORD = r"(?:\p{L}[\p{L}\p{M}]*(?:[.:'’·]\p{L}[\p{L}\p{M}]*)*|\p{N}+(?:[.,;'’]\p{N}+)*|_)+"

#: Fixed values of light stemming: letters that may stand before a final s or st.
ENDING = "bdfghklmnt"
#: Fixed values of light stemming: accented letters and what they count as.
ACCENTS = ("äàáâöòóôïìíîüùúû", "aaaaooooiiiiuuuu")
#: First letters of words and of their terms, where they differ.
FIRST = (ACCENTS[0] + "ß", ACCENTS[1] + "s")
#: Fixed values of the second stemmer: letter groups that count as one letter.
GROUPS = (("sch", "$"), ("ch", "§"), ("ei", "%"), ("ie", "&"), ("ig", "#"), ("st", "!"))


def tokens(text: Column) -> Column:
    """All words of a text in order, lower-cased; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def without(words: Column, stop: list[str]) -> Column:
    """The words that are no stop words, in order, repeats kept."""
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def parse_stop_words(line: str, *, literal: bool = False) -> list[str]:
    """Entries of a comma-separated line, trimmed and lower-cased; ``literal`` keeps them as they stand."""
    entries = (line or "").split(",")
    return sorted({e if literal else e.strip().lower() for e in entries} - {""})


def normalized(word: Column) -> Column:
    """One spelling: umlauts without dots, sharp s as ss, and ae, oe, ue like the umlauts (not after another vowel or q for ue)."""
    w = F.regexp_replace(word, "([ao])e", "$1")
    w = F.regexp_replace(w, "(?<![aeioquyäöü])ue", "u")
    return F.translate(F.regexp_replace(w, "ß", "ss"), "äöü", "aou")


def _ends(w: Column, n: int, longer: int, *last: str) -> Column:
    return (F.length(w) > longer) & F.right(w, F.lit(n)).isin(*last)


def _less(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def light_stem(word: Column) -> Column:
    """Light stemming: plural and case endings, then superlative and comparative ones; at most one of each."""

    def case_ending(w: Column) -> Column:
        return (
            F.when(_ends(w, 3, 5, "ern"), _less(w, 3))
            .when(_ends(w, 2, 4, "em", "en", "er", "es"), _less(w, 2))
            .when(_ends(w, 1, 3, "e"), _less(w, 1))
            .when(_ends(w, 2, 3, *(c + "s" for c in ENDING)), _less(w, 1))
            .otherwise(w)
        )

    def degree(w: Column) -> Column:
        return (
            F.when(_ends(w, 3, 5, "est"), _less(w, 3))
            .when(_ends(w, 2, 4, "er", "en"), _less(w, 2))
            .when(_ends(w, 3, 4, *(c + "st" for c in ENDING)), _less(w, 2))
            .otherwise(w)
        )

    return let(let(F.translate(word, *ACCENTS), case_ending), degree)


def second_stem(word: Column) -> Column:
    """Caumanns' stemmer (1999): letter groups count as one letter, endings go while enough is left. Words with other signs than letters stay."""
    w = F.translate(F.regexp_replace(word, "ß", "ss"), "äöü", "aou")
    w = F.regexp_replace(w, r"(\p{L})\1", "$1*")
    for group, sign in GROUPS:
        w = F.regexp_replace(w, group, "\\" + sign)

    def grouped(w: Column) -> Column:
        # letters that the signs stand for beyond one each
        hidden = sum(F.length(F.regexp_replace(w, f"[^{sign}]", "")) * (len(group) - 1) for group, sign in GROUPS)
        return let(F.struct(w.alias("w"), hidden.alias("hidden")), stripped)

    def strips(x: Column, w: Column) -> Column:
        def once(v: Column, _: Column) -> Column:
            size = F.length(v) + x["hidden"]
            return (
                F.when(F.length(v) <= 3, v)
                .when((size > 5) & v.endswith("nd"), _less(v, 2))
                .when((size > 4) & (v.endswith("em") | v.endswith("er")), _less(v, 2))
                .when(F.right(v, F.lit(1)).isin("e", "s", "n", "t"), _less(v, 1))
                .otherwise(v)
            )

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), w, once)

    def stripped(x: Column) -> Column:
        v = let(strips(x, x["w"]), lambda v: F.when((F.length(v) > 5) & v.endswith("erin*"), strips(x, _less(v, 1))).otherwise(v))
        v = F.regexp_replace(v, "z$", "x")
        v = F.regexp_replace(v, r"(\p{L})\*", "$1$1")
        for group, sign in GROUPS:
            v = F.regexp_replace(v, "[" + sign + "]", group)
        return let(v, lambda v: F.when(F.length(v) > 4, F.regexp_replace(v, "^(.*?)gege", "$1ge")).otherwise(v))

    return F.when(word.rlike(r"^\p{L}+$"), let(w, grouped)).otherwise(word)


#: Steps of an analysis, by name, applied to a word that is no stop word.
STEPS = {"normalize": normalized, "light": light_stem, "second": second_stem}
FULL = ("normalize", "light", "second")
LIGHT = ("normalize", "light")


def term(word: Column, steps: tuple[str, ...] = FULL) -> Column:
    """The term of a word: its steps, one after the other."""
    for s in steps:
        word = let(word, STEPS[s])
    return word
