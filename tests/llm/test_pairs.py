"""Near-duplicates, components, tied pages, leaks, mixes: against brute force on small tables."""

import random
from collections import Counter

import numpy as np
import pytest
from conftest import largest_partition
from pyspark.sql import functions as F

from textloom.llm import components, fmindex, leakage, mixing, nearduplicates, superminhash, titles
from textloom.llm.words import WORD


def shingles(text, n):
    ws = WORD.findall((text or "").lower())
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    universe = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = universe[:300], universe[100:]
    table = superminhash.signatures(np.concatenate([a, b, a, a[:2], a[:1]]), np.repeat(np.arange(5), [300, 300, 300, 2, 1]), 5, 256)
    assert (table[0] == table[2]).all() and abs((table[0] == table[1]).mean() - 0.5) < 0.1
    assert (table < 256 << 32).all()  # tiny sets fill all slots too
    assert (superminhash.signatures(np.concatenate([a, a]), np.zeros(600, int), 1, 256)[0] == table[0]).all()


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choices(words, k=rng.randrange(20, 80)) for _ in range(40)]
    data = []
    for ws in base:
        for _ in range(rng.randrange(1, 4)):
            edited = list(ws)
            for _ in range(rng.randrange(5)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            data.append(" ".join(edited))
    data += [data[0]] * 12 + [data[0].upper(), None, "", "kurz", "zwei worte", "zwei worte"]
    rows = [(i, t, "x") for i, t in enumerate(data)]
    return rows, spark.createDataFrame(rows, "id long, text string, band string")


def test_pairs(near):
    rows, df = near
    want = {}
    sets = {i: shingles(t, 3) for i, t, _ in rows}
    for i in sets:
        for j in sets:
            if i < j and (sets[i] & sets[j]) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6:
                want[i, j] = True
    pairs = nearduplicates.alike(df, width=3, least=0.6)
    members = nearduplicates.classes(df.filter(nearduplicates.has_run(3)))
    assert {tuple(r) for r in nearduplicates.expand(pairs, members).collect()} == set(want)
    assert nearduplicates.alike(df.filter("false"), width=3, least=0.6).count() == 0


def test_candidates_of_a_hot_band(spark, monkeypatch):
    monkeypatch.setattr(nearduplicates, "HOT", 4)
    bands = {1: range(30), 2: [5, 6], 3: [7], 4: [40, 41, 42, 43, 44]}
    # rows of a hot band need not all be told to be hot; others may be by chance
    for told in ({1}, set(bands), set(), {"some"}):
        rows = [(b, i, 9, b in told or told == {"some"} and i % 3 == 0) for b, ids in bands.items() for i in ids]
        got = sorted(map(tuple, nearduplicates.candidates(spark.createDataFrame(rows, "band long, id long, n int, hot boolean")).collect()))
        assert got == sorted({(i, j) for ids in bands.values() for i in ids for j in ids if i < j})


def test_a_common_band_is_hot():
    texts = [f"eins zwei drei vier x{i}" for i in range(200)] + [f"w{i} v{i} u{i} t{i}" for i in range(200)]
    batch = nearduplicates.pa.RecordBatch.from_arrays([nearduplicates.pa.array(range(400)), nearduplicates.pa.array(texts)], ["id", "text"])
    (out,) = nearduplicates.band_rows(2, 16, 1)(iter([batch]))
    rows = out.to_pandas()
    times = rows.groupby("band")["id"].transform("count")
    assert ((times >= 7) == rows["hot"]).all() and rows["hot"].any() and not rows.loc[rows["id"] >= 200, "hot"].any()


def test_groups(near):
    rows, df = near
    pairs = nearduplicates.alike(df, width=3, least=0.6)
    got = {r.id: (r.group_id, r.n_links) for r in nearduplicates.groups(df, pairs).collect()}
    sets = {i: shingles(t, 3) for i, t, _ in rows}
    parent = {i: i for i, t, _ in rows if t}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in parent:
        for j in parent:
            alike = rows[i][1].lower() == rows[j][1].lower() or sets[i] & sets[j] and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])
            if i < j and alike and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: g for i, (g, _) in got.items()} == {i: find(i) for i in parent}


GRAPHS = {
    "path": [(i, i + 1) for i in range(60)],
    "cycle": [(i, (i + 1) % 40) for i in range(40)],
    "star": [(0, i) for i in range(1, 80)],
    "core": [(i, j) for i in range(9) for j in range(i)],
    "two stars and a bridge": [(0, i) for i in range(1, 30)] + [(100, i) for i in range(101, 130)] + [(5, 105)],
    "loops and nulls": [(1, 1), (2, 3), (3, 2), (None, 4), (5, None), (2, 3)],
    "pair": [(7, 3)],
    "nothing": [],
}


def least_linked(edges):
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


@pytest.mark.parametrize("name", [*GRAPHS, "random"])
def test_components(spark, name):
    rng = random.Random(4)
    edges = GRAPHS.get(name) or ([(rng.randrange(150), rng.randrange(150)) for _ in range(140)] + [(900 + rng.randrange(12), 900 + rng.randrange(12)) for _ in range(60)] if name == "random" else [])
    df = spark.createDataFrame([(*e, "x") for e in edges], "u long, v long, root string")
    assert {r.vertex: r.component for r in components.components(df).collect()} == least_linked(edges)


def test_title_groups(page):
    table = page(
        [
            ("Große Flut", 0, 1, None, 1, "x"), ("große-flut", 4, 2, None, 1, "x"), ("Flut", 0, 3, "Große Flut", 1, None), ("Hochwasser", 0, 4, "Flut", 1, "x"),
            ("Allein", 0, 5, "Fehlt", 1, "x"), ("Selbst", 0, 6, "selbst", 1, "x"), ("", 0, 7, "Flut", 1, "x"), (None, 0, 8, "Flut", 1, "x"), ("Ohne", 0, 9, ..., 1, "x"),
            ("Flut", 0, None, None, 1, "x"), ("Alt", 0, 10, "Flut", 1, "x"), ("Alt", 0, 10, None, 2, "x"), ("A", 0, 11, "B", 1, "x"), ("B", 0, 12, "C", 1, "x"), ("C", 0, 13, "A", 1, "x"),
        ]
    )
    got = {r.id: r.group_id for r in titles.title_groups(table).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 11: 11, 12: 11, 13: 11}
    assert titles.title_groups(page([])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    records = [rng.integers(1, 5, rng.integers(0, 40)) for _ in range(30)]
    records += records[:5]
    symbols = np.concatenate([np.append(r, 0) for r in records])
    index = fmindex.FMIndex(symbols, 4)
    patterns = [rng.integers(1, 5, rng.integers(1, 7)) for _ in range(60)]
    padded = np.zeros((60, 6), np.int64)
    for row, p in zip(padded, patterns):
        row[6 - len(p) :] = p
    which, at = index.locate(*index.search(padded, np.array([len(p) for p in patterns])))
    got = sorted(zip(which.tolist(), at.tolist()))
    want = sorted((k, i) for k, p in enumerate(patterns) for i in range(len(symbols)) if list(symbols[i : i + len(p)]) == list(p))
    assert got == want


def test_leaks(spark):
    rng = random.Random(6)
    words = ["Straße", "Häuser", "fluß", "Öl", *[f"w{i}" for i in range(30)]]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 11, 12, 13, 30])))) for i in range(20)]
    docs = []
    for d in range(60):
        ws = rng.choices(words, k=40)
        if d % 2:
            part = items[d % 20][1].split()
            k = rng.randrange(max(1, len(part) - 11))
            ws[10:10] = part[k : k + rng.choice([8, 12, 40])]
        docs.append((d, rng.choice([", ", " ", " - "]).join(w.replace("ß", "ss").upper() if rng.random() < 0.3 else w for w in ws)))
    docs += [(100, None), (101, ""), (102, "..."), (103, docs[1][1]), (104, items[0][1]), (None, items[0][1])]
    items += [(50, None), (51, ""), (52, "--"), (None, docs[0][1]), (53, items[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    held = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")

    def runs(text, n):
        ws = leakage.compared(text or "")
        return {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}

    want = set()
    for i, t in items:
        n = min(12, len(leakage.compared(t or "")))
        for d, x in docs:
            if n and i is not None and runs(t, n) & runs(x, n):
                want.add((i, d))
    rows = leakage.leaks(df, held).collect()
    assert {(r.item_id, r.doc_id) for r in rows} == want
    texts = dict(docs)
    for r in rows:
        span = leakage.compared(texts[r.doc_id][r.start : r.end])
        assert span == leakage.compared(texts[r.doc_id])[r.first_word : r.end_word] and len(span) == r.end_word - r.first_word
    assert leakage.leaks(df.filter("false"), held).count() == 0 and leakage.leaks(df, held.filter("false")).count() == 0


def test_shards_are_bounded(spark, monkeypatch):
    """Tiny documents count too: by their words, and one for each."""
    sizes = []
    monkeypatch.setattr(leakage, "SHARD_WORDS", 300)
    monkeypatch.setattr(leakage, "Shard", lambda docs: sizes.append(sum(len(ws) + 1 for _, _, ws in docs)) or type("S", (), {"find": lambda self, wanted: []})())
    block = type("B", (), {"value": leakage.phrases([(1, "a b")], 12)})()
    texts = ["a b c"] * 1000 + ["."] * 1000 + ["x " * 1000]
    batch = leakage.pa.RecordBatch.from_arrays([leakage.pa.array(range(len(texts))), leakage.pa.array(texts)], ["doc_id", "text"])
    assert list(leakage.searcher([block])(iter([batch]))) == []
    assert sum(sizes) == 4000 + 1000 + 1001 and max(sizes[:-1]) <= 303 and sizes[-1] <= 1001 + 300


def test_leaks_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 20)
    items = spark.createDataFrame([(i, f"wort{i} ende") for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"ein wort{i} ende hier") for i in range(9)], "doc_id long, text string")
    assert sorted((r.item_id, r.doc_id) for r in leakage.leaks(docs, items).collect()) == [(i, i) for i in range(9)]


def test_flight_keeps_sums():
    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 900, 2000)
    chance = np.full(2000, 0.3)
    p = mixing.flight(chance, tokens, rng, False)
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert abs(p.sum() - chance.sum()) < 1e-6 and abs((p * tokens).sum() - (chance * tokens).sum()) < 1e-3
    landed = mixing.flight(p, tokens, rng, True)
    assert set(landed) <= {0.0, 1.0} and abs(landed.sum() - 600) <= 1
    assert (mixing.flight(np.full(9, 0.5), np.full(9, 7), rng, True)).sum() in (4, 5)
    # each chance is kept on average
    mean = np.mean([mixing.flight(np.full(40, 0.25), tokens[:40], np.random.default_rng(s), True) for s in range(800)], axis=0)
    assert abs(mean - 0.25).max() < 0.08


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 100)
    rng = random.Random(8)
    docs, k = [], 0
    for source, n in (("groß", 1500), ("mittel", 400), ("klein", 60), ("fremd", 50), (None, 20)):
        for _ in range(n):
            docs.append((k, "wort und satz " * rng.randrange(1, 30), source))
            k += 1
    docs += [(k, None, "klein"), (k + 1, "", "klein"), (None, "x", "klein"), (k + 2, docs[0][1], "groß")]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, source string, share double")
    targets = spark.createDataFrame([("groß", 0.5, 1), ("mittel", 0.3, 2), ("klein", 0.15, 4), ("leer", 0.05, 3), (None, 0.1, 1), ("klein", 0.15, 4)], "source string, target_share double, max_repeats int")
    used, shares = mixing.mix(df, targets)
    rows, got = used.collect(), {r.source: r for r in shares.collect()}
    caps = {"groß": 1, "mittel": 2, "klein": 4}
    assert all(1 <= r.copies <= caps[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    whole = sum((0.5, 0.3, 0.15))
    for s, share in (("groß", 0.5), ("mittel", 0.3), ("klein", 0.15)):
        assert abs(got[s].share - share / whole) < 0.004
        assert got[s].tokens == sum(r.tokens * r.copies for r in rows if r.source == s)
    assert got["leer"].tokens == 0 and got["leer"].share == 0 and set(got) == {"groß", "mittel", "klein", "leer"}
    # a size that a source can't reach within its repeats
    _, short = mixing.mix(df, targets, total=10 * sum(r.tokens for r in rows))
    assert {r.source: r.copies for r in short.collect()}["klein"] == 4 * 60
    monkeypatch.setattr(mixing, "SOURCES", 3)
    with pytest.raises(ValueError):
        mixing.mix(df, targets)
    monkeypatch.setattr(mixing, "SOURCES", 4)
    empty, none = mixing.mix(df.filter("false"), targets)
    assert empty.count() == 0 and {r.share for r in none.collect()} == {0.0}


def test_hot_keys_stay_spread(spark, no_skew_join, monkeypatch, page):
    """A third of all records are copies of one text, a third of all pages bear one title, a component has a third of all vertices."""
    monkeypatch.setattr(nearduplicates, "HOT", 20)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(160)]
    texts += [texts[0]] * 80 + [texts[0] + " ende"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    members = nearduplicates.classes(df).cache()
    assert {r.id: r.rep for r in members.collect()} == {i: texts.index(t) for i, t in enumerate(texts)}
    got = {tuple(r) for r in nearduplicates.expand(nearduplicates.alike(df, width=3, least=0.6), members).collect()}
    hot = {i for i, t in enumerate(texts) if t.startswith(texts[0])}
    assert got == {(i, j) for i in hot for j in hot if i < j}

    star = [(0, i) for i in range(1, 2000)] + [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(2000)]
    found = components.components(spark.createDataFrame(star, "u long, v long").repartition(8))
    assert largest_partition(found) < 1900 and {r.vertex: r.component for r in found.collect()} == least_linked(star)

    pages = [(f"T{i}" if i % 3 else "Eins", 0, i, None, 1, "x") for i in range(1500)]
    tied = titles.title_groups(page(pages))
    assert largest_partition(tied) < 400 and {(r.id, r.group_id) for r in tied.collect()} == {(i, 0) for i in range(0, 1500, 3)}
