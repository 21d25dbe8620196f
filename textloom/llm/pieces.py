"""Splitting of long texts at natural boundaries, with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strength of a cut after each kind of boundary, weakest first; later ones override.
BOUNDARIES = (
    (1, re.compile(r"\s+")),
    (2, re.compile(r"[,:](?=\s)\s")),
    (3, re.compile(r";\s")),
    (4, re.compile(r"[.!?…][\"'»“)\]]*\s+")),
    (5, re.compile(r"\n")),
    (6, re.compile(r"\n[^\S\n]*\n+")),
)
BLOCK = 1 << 16


def strengths(text: str, start: int, end: int) -> np.ndarray:
    """Of a cut before each position start..end (end included); 0 where nothing speaks for one."""
    out = np.zeros(end - start + 1, np.int64)
    lo = max(0, start - 80)
    part = text[lo : end + 1]
    for level, pattern in BOUNDARIES:
        at = np.fromiter((m.end() for m in pattern.finditer(part)), np.int64) + lo
        out[at[(at >= start) & (at <= end)] - start] = level
    return out


class Strongest:
    """Sparse table: position of the strongest cut in any range, the rightmost of equals."""

    def __init__(self, text: str, start: int, end: int, span: int):
        self.start, self.end = start, end
        levels = [(strengths(text, start, end) << 40) + np.arange(start, end + 1)]
        width = 1
        while width * 2 <= min(span, end - start + 1):
            a = levels[-1]
            levels.append(np.maximum(a[: len(a) - width], a[width:]))
            width *= 2
        self.levels = levels

    def __call__(self, lo: int, hi: int) -> int:
        k = (hi - lo + 1).bit_length() - 1
        row = self.levels[k]
        return int(max(row[lo - self.start], row[hi - (1 << k) + 1 - self.start])) & ((1 << 40) - 1)


def cut(text: str, limit: int, overlap: int, shortest: int) -> list[tuple[int, int, int]]:
    """(start, end, first new position) of each piece, in order.

    The new parts tile the text. A cut is the strongest boundary that leaves
    the piece between ``shortest`` and ``limit`` long, the rightmost of
    equals; if nothing speaks for any, the piece is cut at ``limit``. The next
    piece steps back to the first word start within ``overlap``.
    """
    out, new, start, n = [], 0, 0, len(text)
    table: Strongest | None = None
    while n - start > limit:
        lo, hi = max(start + shortest, new + 1), start + limit
        if table is None or hi > table.end or lo < table.start:
            table = Strongest(text, lo, min(n, lo + BLOCK + limit), limit + 1)
        end = table(lo, hi)
        out.append((start, end, new))
        back = max(start + 1, end - overlap)
        word = re.compile(r"(?<=\s)\S").search(text, back, end)
        new, start = end, word.start() if word else back
    out.append((start, n, new))
    return out


def split(records: DataFrame, key: str = "id", text: str = "text", *, limit: int = 4000, overlap: int = 200, shortest: int | None = None) -> DataFrame:
    """(key, piece, start, new_from, end, content): texts over ``limit`` characters, in pieces of at most that.

    ``content`` is text[start:end]; what lies before ``new_from`` repeats the
    piece before, at most ``overlap`` characters of it. Texts within the limit,
    null and empty ones give no rows. Each record is worked on by itself; a
    record of any length takes memory for its text and one block of the table.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half the limit")
    least = shortest or limit // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1).to_pylist()):
                got = cut(t, limit, overlap, max(least, overlap + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k.as_py()] * len(got), batch.column(0).type),
                        pa.array(range(len(got)), pa.int32()),
                        *(pa.array([p[i] for p in got], pa.int64()) for i in (0, 2, 1)),
                        pa.array([t[a:b] for a, b, _ in got], pa.string()),
                    ],
                    ["key", "piece", "start", "new_from", "end", "content"],
                )

    kind = records.schema[key].dataType.simpleString()
    long = records.filter(F.length(text) > limit).select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = long.mapInArrow(run, f"key {kind}, piece int, start long, new_from long, end long, content string")
    return out.withColumnRenamed("key", key)
