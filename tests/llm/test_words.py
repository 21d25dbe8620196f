"""Terms, frequencies, pieces, truncation: against brute force on small tables."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm import distinctive, frequency, pieces, truncation
from textloom.llm.words import WORD
from textloom.operators import pages


def corpus(rng, n):
    common, rare = ["der", "die", "und", "Ort", "liegt"], [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(common, k=rng.randrange(8)) + rng.choices(rare, k=rng.randrange(6))) for _ in range(n)]
    return [*enumerate(texts), (n, None), (n + 1, ""), (n + 2, "..."), (n + 3, texts[0]), (n + 4, "Größe GRÖSSE größe_2")]


@pytest.fixture(scope="module")
def records(spark):
    data = corpus(random.Random(3), 120)
    return data, spark.createDataFrame([(i, t, 1, "x") for i, t in data], "id long, text string, records int, term string")


def test_term_counts(records):
    data, df = records
    occurrences, n = Counter(), Counter()
    for _, t in data:
        ws = WORD.findall((t or "").lower())
        occurrences.update(ws)
        n.update(set(ws))
    got = {r.term: (r.occurrences, r.records) for r in frequency.term_counts(df).collect()}
    assert got == {t: (occurrences[t], n[t]) for t in occurrences}
    assert frequency.term_counts(df.filter("false")).count() == 0


def test_marks(spark):
    counts = spark.createDataFrame([("a", 9, 2), ("b", 9, 3), ("c", 9, 4), ("d", 9, 5)], "term string, occurrences long, records long")
    got = {r.term: r.mark for r in frequency.mark(counts, F.lit(10)).collect()}
    assert got == {"a": "rare", "b": None, "c": None, "d": "common"}  # 40 % itself is not more than 40 %


@pytest.mark.parametrize("by", ["z", "tf_idf"])
def test_distinctive(records, by):
    data, df = records
    got = defaultdict(set)
    for r in distinctive.distinctive(pages.bucketed(df, "id", 5), by=by).collect():
        got[r.id].add(r.term)
    docs = {i: Counter(WORD.findall(t.lower())) for i, t in data if t}
    n_df, cf = Counter(t for c in docs.values() for t in c), sum(docs.values(), Counter())
    total = sum(cf.values())
    for i, c in docs.items():
        score = {}
        for t, tf in c.items():
            if n_df[t] >= 2:
                a, b, size = tf + 1000 * cf[t] / total, cf[t] - tf + 1000 * cf[t] / total, sum(c.values())
                z = (math.log(a / (size + 1000 - a)) - math.log(b / (total - size + 1000 - b))) / math.sqrt(1 / a + 1 / b)
                score[t] = z if by == "z" else tf * math.log(len(docs) / n_df[t])
        best = max(score.values(), default=None)
        assert got[i] == {t for t, s in score.items() if s >= best - 1e-9}
    assert distinctive.distinctive(pages.bucketed(df.filter("false"), "id", 5)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_cut(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["wort ", "Satz. ", "a, ", "\n\n", "x" * rng.randrange(1, 90), "äöü ", "\n"]) for _ in range(3000))
    if seed == 0:
        text = "x" * 9001
    got = pieces.cut(text, 400, 60, 200)
    assert "".join(text[new:end] for _, end, new in got) == text
    assert all(end - start <= 400 and 0 <= new - start <= 60 for start, end, new in got)
    # every cut is a strongest boundary of its window, the rightmost of these
    strength = pieces.strengths(text, 0, len(text))
    for start, end, new in got[:-1]:
        window = range(max(start + 200, new + 1), start + 401)
        best = max(strength[k] for k in window)
        assert end == max(k for k in window if strength[k] == best)


def test_split(spark):
    long = "Ein Satz mit Wörtern. " * 300
    df = spark.createDataFrame([(1, long, "x"), (2, "x" * 4000, "x"), (3, "y" * 4001, "x"), (4, None, "x"), (5, "", "x"), (None, long, "x")], "id long, text string, piece string")
    rows = pieces.split(df).collect()
    assert {r.id for r in rows} == {1, 3, None}
    for i, text in ((1, long), (3, "y" * 4001), (None, long)):
        own = sorted((r for r in rows if r.id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) > 1
        assert "".join(r.content[r.new_from - r.start :] for r in own) == text
        assert all(len(r.content) <= 4000 and r.content == text[r.start : r.end] for r in own)
    assert pieces.split(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        pieces.split(df, limit=100, overlap=60)


def test_very_long_text():
    text = "Wort und Satz. " * 200_000
    got = pieces.cut(text, 4000, 200, 2000)
    assert got[-1][1] == len(text) and max(e - s for s, e, _ in got) <= 4000


SENTENCES = ["Der Ort liegt am Rand der Stadt.", "Die Kirche wurde im Jahr 1900 erneuert.", "Das Haus gehört zu der Gemeinde.", "Am Ufer steht seit 1850 eine Mühle."]


def test_truncated(spark):
    rng = random.Random(5)
    whole = [" ".join(rng.choices(SENTENCES, k=4)) for _ in range(80)]
    cases = {
        1000: (whole[0] + " Die Kirche wurde im Ja", "trigram"),
        1001: (whole[1] + " Die Kirche wurde im", "trigram"),
        1002: (whole[2] + " Der Ort liegt am Rand der ", "trigram"),
        1003: (whole[3] + " Die Kirche …", "trigram"),
        1004: (whole[4] + " Die Ki [...]", "trigram"),
        1005: (whole[5] + " Siehe [[Ort", True),
        1006: (whole[6] + " (vgl. Haus", True),
        1007: (whole[7] + "\n== Lage", True),
        1008: (whole[8] + " <ref>Karte", True),
        1009: (whole[9] + " »Das Haus", True),
        1010: (whole[10] + " {{Infobox\n| Ort = X", True),
        1011: (whole[11] + " Umland &am", True),
        1012: (whole[12] + " Die Kirche wurde,", "trigram"),
        1013: (whole[13] + " Siehe <a href='x'\nclass='y", True),
        1014: (whole[14] + " <ref name='a'>Karte 1", True),
        1015: (whole[15] + "\n{| class='x'\n! Jahr", True),
        1016: (whole[16] + " \"Gut,\nsagt er nun", True),
        1017: (whole[17] + "\n* Der Ort lie", "word"),
        1018: (whole[18] + " Ufer …", True),
        2000: (whole[13] + " Die Kirche wurde im Jahr 1900 erneuert", None),
        2001: (whole[14] + "\n* Mühle am Ufer der", None),
        2002: (whole[15] + "\n(Karte: Haus, 1900.)", None),
        2003: (whole[16] + "\n[[Kategorie:Ort]]", None),
        2004: (whole[17] + "\n\n", None),
        2005: ("Ort", "trigram"),  # judged like any other: it begins sentences and never ends one
        2006: ("...", "stand-in"),
        2007: (whole[18] + " <references /> Die Mühle<ref name='b' />.", None),
    }
    rows = [(i, t, "s") for i, t in enumerate(whole)] + [(i, t, None if i == 1000 else "s") for i, (t, _) in cases.items()]
    rows += [(3000, None, "s"), (3001, "", "leer"), (3002, "  \n", "s"), (None, whole[0], "s")]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, source string, c string, word string")
    got = {r.doc_id: r.reason for r in truncation.judged(df).collect()}
    assert {i: got[i] for i, (_, reason) in cases.items() if reason is not True} == {i: reason for i, (_, reason) in cases.items() if reason is not True}
    assert all(got[i] for i, (_, reason) in cases.items() if reason)  # open ends, by whichever test sees them first
    assert all(got[i] is None for i in range(len(whole))) and not {3000, 3001, 3002} & set(got)
    rate = {r.source: (r.documents, r.truncated) for r in truncation.rates(df).collect()}
    assert rate[None] == (1, 1) and rate["leer"] == (1, 0) and rate["s"][1] == sum(r is not None for _, r in cases.values()) - 1
    assert truncation.truncated(df.filter("false")).count() == 0


def test_fixed_length_is_a_limit(spark):
    """A last trigram that may end a sentence counts as cut where many texts of the source have just this length."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["Es gibt ein Haus bei Lindenau.", "Es gibt ein Haus bei Lindenau und Wald."], k=6)) for _ in range(60)]
    cut = []
    while len(cut) < 8:
        t = " ".join(rng.choices(SENTENCES + texts[:3], k=9)) + f" Nummer {len(cut)}."
        tail = " Es gibt ein Haus bei Lindenau"
        cut.append((t[: 200 - len(tail)].rsplit(".", 1)[0] + ".").ljust(200 - len(tail), "x") + tail)
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(100 + i, t, "fest") for i, t in enumerate(cut)] + [(200, texts[0] + " Es gibt ein Haus bei Lindenau", "a")]
    got = {r.doc_id: r.reason for r in truncation.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[100 + i] == "trigram" for i in range(8)) and got[200] is None


def test_trigrams_seen_once_count_for_fewer_words(spark):
    """No trigram of "rot <w>" or "blau <w>" recurs, but the pairs do: one never ends a sentence, the other always."""
    rows = [(i, f"{x} rot ist {x} da.", "s") for i, x in enumerate("abcdefghijkl")] + [(100 + i, f"Es {x} blau oft.", "s") for i, x in enumerate("abcdefghijkl")]
    rows += [(200, "Heute rot ist", "s"), (201, "Heute blau oft", "s")]
    got = {r.doc_id: r.reason for r in truncation.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: "trigram" if i == 200 else None for i, _, _ in rows}


def test_copies_do_not_hide_a_limit(spark):
    """Texts of a source are counted once each, in the share that has one length as in what it is a share of."""
    rows = [(i, "Es gibt ein Haus bei Lindenau" + (" und Wald." if i % 2 else "."), "a") for i in range(60)]
    rows += [(100 + i, f"Nummer {i}. Es gibt ein Haus bei Lindenau", "fest") for i in range(8)] + [(200 + i, "Der Hof steht.", "fest") for i in range(500)]
    got = {r.doc_id: r.reason for r in truncation.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {i for i, reason in got.items() if reason} == {100 + i for i in range(8)}


def test_list_entries_break_off(spark):
    whole = [(i, " ".join(SENTENCES), "s") for i in range(5)]
    cases = {10: ("* Die Kir", "word"), 11: ("* Ufer und Haus,", "sign"), 12: ("* Mühle am Ufer der", None), 13: ("* Haus am Ufer der ", None), 14: ("* Turm", None)}
    rows = whole + [(i, f"{SENTENCES[0]}\n{t}", "s") for i, (t, _) in cases.items()]
    got = {r.doc_id: r.reason for r in truncation.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: None for i, _, _ in whole} | {i: reason for i, (_, reason) in cases.items()}


def test_planted_cuts_are_found(spark):
    """Texts whose cut is known because it is made here: at a random place, at a fixed length, or before the last stop only, which is no cut."""
    rng = random.Random(11)
    names = [f"{a}{b}{c}" for a in ("Lin", "Wald", "Brück", "Stein") for b in ("den", "hof", "see", "ried") for c in ("au", "born", "heim")]
    forms = [
        "{} liegt am Rand der Stadt {} und wurde {} erneuert.", "Die Kirche von {} wurde im Jahr {} durch {} umgebaut.", "Zwischen {} und {} führt ein Weg zur Mühle {}.",
        "Bei der Zählung von {} lebten in {} über {} Menschen.", "Das Haus gehört seit {} zu der Gemeinde {}.", "Am Ufer bei {} steht {} mit einer Brücke von {} Metern.",
    ]

    def text(n):
        return " ".join(f.format(*(str(rng.randrange(900, 2000)) if rng.random() < 0.3 else rng.choice(names) for _ in range(3))) for f in rng.choices(forms, k=n))

    whole = [text(rng.randrange(4, 12)) for _ in range(600)]
    rows, cut = [(i, t, "ganz") for i, t in enumerate(whole)], set()
    for i in range(200):
        t = text(8)
        kept = t[: rng.randrange(60, len(t) - 1)] if i % 2 else t[:200]
        if kept.rstrip()[-1] not in "." and not t[len(kept) :].startswith("."):
            rows.append((1000 + i, kept, "zufall" if i % 2 else "fest"))
            cut.add(1000 + i)
    rows += [(2000 + i, text(5)[:-1], "ohne") for i in range(100)]
    found = {r.doc_id for r in truncation.truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.01 * len(found)


def test_copies_of_a_cut_text_do_not_hide_it(spark):
    """A third of all rows are copies of one cut text: its end counts once, and not for itself."""
    rng = random.Random(4)
    whole = [" ".join(rng.choices(SENTENCES, k=5)) for _ in range(60)]
    cut = whole[0] + " Die Kirche wurde im"
    rows = [(i, t, "s") for i, t in enumerate(whole)] + [(100 + i, cut, "s") for i in range(30)]
    assert {r.doc_id for r in truncation.truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()} == set(range(100, 130))


def test_word_test_does_not_depend_on_size(spark):
    """A broken word that damaged texts hold now and then is still no word; one that stands whole often enough is one."""
    for times in (1, 20):
        rows = [(i, "Am Ort und am Ende steht das Haus.", "s") for i in range(200 * times)] + [(10_000 + i, "Heute un da.", "s") for i in range(times)]
        rows += [(20_000, "* Am Ort un", "s"), (20_001, "* Am Ort am", "s")]
        got = {r.doc_id: r.reason for r in truncation.truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        assert got == {20_000: "word"}


def test_counts_stay_off_the_driver(spark):
    """No table that grows with the texts is broadcast, however small the engine takes it to be: heavy ends, limits and sources only."""
    letters = "abcdefghijklmnop"
    words = [x + y + z for x in letters for y in letters for z in letters[:4]]
    rows = [(i, f"Es {w} da.", "s") for i, w in enumerate(words)] + [(5000 + i, f"Es {w}", "s") for i, w in enumerate(words)]
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    found = truncation.truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    bus.waitUntilEmpty()
    assert {r.doc_id for r in found} == {5000 + i for i in range(len(words))}
    sent, runs = [], store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(before, runs.size())):
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name() == "BroadcastExchange":
                ids = {m.name(): m.accumulatorId() for m in (node.metrics().apply(i) for i in range(node.metrics().size()))}
                rows_sent = values.get(ids["number of output rows"])
                sent.append(int(rows_sent.get().replace(",", "")) if rows_sent.isDefined() else 0)
    assert sent and max(sent) < 100 < len(words)
