"""Held-out test texts that stand in a training corpus."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.fmindex import FMIndex
from textloom.llm.words import WORD

#: Words of documents, with an end for each document, that one index holds.
SHARD_WORDS = 1 << 19
#: Characters of test texts in a block. Each index is searched for one block after the other.
BLOCK_CHARS = 4 << 20
OUT = "item_id long, doc_id long, first_word int, end_word int, start int, end int"
NAMES = ["item_id", "doc_id", "first_word", "end_word", "start", "end"]
KINDS = [pa.int64(), pa.int64(), *[pa.int32()] * 4]


def compared(text: str) -> list[str]:
    """Words as they are compared: lower-cased, umlauts and sharp s written out."""
    return WORD.findall(text.lower().replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss"))


@dataclass
class Phrases:
    """The runs of n words of some items, or the whole item if it is shorter: numbers into ``words``, filled up at the left with -1; ``items``: the item of each."""

    words: list[str]
    runs: np.ndarray
    items: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return (self.runs >= 0).sum(axis=1)


def phrases(items: Iterable[tuple[int, str]], n: int) -> Phrases:
    known: dict[str, int] = {}
    runs, of = [np.zeros((0, n), np.int32)], [np.zeros(0, np.int64)]
    for item, text in items:
        codes = np.array([known.setdefault(w, len(known)) for w in compared(text)], np.int32)
        if len(codes):
            padded = np.concatenate([np.full(max(0, n - len(codes)), -1, np.int32), codes])
            runs.append(np.lib.stride_tricks.sliding_window_view(padded, n))
            of.append(np.full(len(runs[-1]), item, np.int64))
    return Phrases(list(known), np.concatenate(runs), np.concatenate(of))


class Shard:
    """Documents (key, text, its words as they are compared) with an FM-index over their words."""

    def __init__(self, docs: list[tuple[int, str, list[str]]]):
        self.docs = docs
        codes, known = pd.factorize(np.array([w for _, _, ws in docs for w in (*ws, "")], object))
        end = int(np.flatnonzero(known == "")[0])
        symbols = np.where(codes == end, 0, np.where(codes < end, codes + 1, codes))
        self.symbols = {w: i for i, w in enumerate(known[np.arange(len(known)) != end], 1)}
        self.index = FMIndex(symbols, len(known) - 1)
        self.starts = np.cumsum([0, *(len(ws) + 1 for _, _, ws in docs)])

    def find(self, wanted: Phrases) -> list[tuple[int, int, int, int, int, int]]:
        """Rows of OUT: spans of each item, those that touch merged."""
        here = np.array([*(self.symbols.get(w, -1) for w in wanted.words), 0], np.int64)
        coded = here[wanted.runs]  # -1 takes the last, 0
        live = np.flatnonzero((coded >= 0).all(axis=1))  # a phrase with a word that the shard lacks can't occur
        if not len(live):
            return []
        lengths = wanted.lengths[live]
        which, at = self.index.locate(*self.index.search(coded[live], lengths))
        if not len(at):
            return []
        doc = np.searchsorted(self.starts, at, "right") - 1
        first = at - self.starts[doc]
        hits = pd.DataFrame({"doc": doc, "item": wanted.items[live][which], "a": first, "b": first + lengths[which]}).drop_duplicates().sort_values(["doc", "item", "a"])
        out: list[list[int]] = []
        for d, i, a, b in hits.itertuples(index=False):
            if out and out[-1][:2] == [d, i] and a <= out[-1][3]:
                out[-1][3] = max(out[-1][3], b)
            else:
                out.append([d, i, a, b])
        rows, of, spans = [], None, []
        for d, i, a, b in out:
            key, text, ws = self.docs[d]
            if d != of:
                of, spans = d, [m.span() for m in WORD.finditer(text)]
            whole = len(spans) == len(ws)  # else lower-casing has changed where words end
            rows.append((int(i), key, int(a), int(b), spans[a][0] if whole else -1, spans[b - 1][1] if whole else -1))
        return rows


def find(docs: list[tuple[int, str]], wanted: Phrases) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of OUT for the documents of one shard."""
    return Shard([(d, t, compared(t)) for d, t in docs]).find(wanted)


def blocks(items: DataFrame, n: int) -> list[Broadcast]:
    """The phrases of (i, t) in blocks of about BLOCK_CHARS characters. The driver holds one block at a time; tasks read them from the executor's disk when they need them."""
    sc = items.sparkSession.sparkContext
    out, some, size = [], [], 0
    for i, t in items.toLocalIterator():
        some.append((i, t))
        size += len(t)
        if size >= BLOCK_CHARS:
            out.append(sc.broadcast(phrases(some, n)))
            some, size = [], 0
    if some:
        out.append(sc.broadcast(phrases(some, n)))
    return out


def leaks(documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", n: int = 12) -> DataFrame:
    """(item_id, doc_id, first_word, end_word, start, end): stretches of each document that repeat n consecutive words of an item.

    An item of fewer than n words must stand there whole; items without key, and
    items and documents that are null, empty or without words, match nothing. Spans of one item in
    one document that overlap or touch are merged; ``start`` and ``end`` are
    character offsets (-1 where lower-casing changes the number of words).
    Documents are read once and stay where they are read: each task indexes its
    rows in shards of about SHARD_WORDS words, counting one more for each
    document, so nothing is shuffled and memory is bounded however many copies,
    tiny or long texts there are (one text of more words is a shard of its
    own). The items go to the tasks coded, in blocks of about BLOCK_CHARS
    characters; each shard is searched for all of them, so the corpus is read
    and indexed once at any number of items. Runs a job when it is called, for
    the items.
    """
    held = items.filter((F.length(text) > 0) & F.col(item_key).isNotNull()).select(F.col(item_key).cast("long").alias("i"), F.col(text).alias("t"))
    docs = documents.filter(F.length(text) > 0).select(F.col(key).cast("long"), F.col(text))
    return docs.mapInArrow(searcher(blocks(held, n)), OUT)


def searcher(wanted: Sequence[Broadcast]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int, str, list[str]]] = []
        size = 0
        one = wanted[0].value if len(wanted) == 1 else None

        def flush() -> Iterator[pa.RecordBatch]:
            if docs and wanted:
                shard = Shard(docs)
                for block in wanted:
                    if rows := shard.find(one or block.load_from_path(block._path)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], NAMES)
            docs.clear()

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = compared(t)
                docs.append((d, t, ws))
                size += len(ws) + 1
                if size >= SHARD_WORDS:
                    yield from flush()
                    size = 0
        yield from flush()

    return run
