"""How much each term of a record sets it apart from the rest of the collection."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.words import WORD

#: Rows of this term carry the totals: records, and words in all.
TOTALS = ""


def vocabularies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, text) to (bucket, term, records, occurrences); a bucket's rows come one after the other, or it comes out in parts."""
    records, occurrences, now, n, size = Counter(), Counter(), None, 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal n, size
        if n:
            terms = [TOTALS, *records]
            counts = [n, *records.values()], [size, *(occurrences[t] for t in records)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([now] * len(terms), pa.int32()), pa.array(terms, pa.string()), *(pa.array(c, pa.int64()) for c in counts)],
                ["_bucket", "term", "records", "occurrences"],
            )
        records.clear()
        occurrences.clear()
        n = size = 0

    for batch in batches:
        for bucket, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != now:
                yield from flush()
                now = bucket
            ws = WORD.findall(text.lower())
            records.update(set(ws))
            occurrences.update(ws)
            n += 1
            size += len(ws)
    yield from flush()


def z_scores(tf, cf, length, total, weight):
    """Log-odds ratio of record against rest with a Dirichlet prior of ``weight`` pseudo-words spread as the collection, over its standard error."""
    prior = weight * cf / total
    inside, outside = tf + prior, cf - tf + prior
    odds = np.log(inside / (length + weight - inside)) - np.log(outside / np.maximum(total - length + weight - outside, 1e-9))
    return odds / np.sqrt(1 / inside + 1 / outside)


def distinctive(bucketed: DataFrame, key: str = "id", *, by: str = "z", least_records: int = 2, prior: float = 1000.0) -> DataFrame:
    """(key, term, tf, occurrences, records, z, tf_idf): of each record the terms that score highest ``by`` z or tf_idf, ties all.

    ``bucketed`` has (_bucket, key, text), partitioned by ``_bucket``, a hash
    of the key. Every term of every record is scored: ``z`` is the log-odds
    ratio of the record against the rest with an informative Dirichlet prior
    from the collection's counts, divided by its standard error; ``tf_idf`` is
    tf * ln(N / records). Only terms in at least ``least_records`` records can
    win. Null and empty texts, and records without such a term, give no row;
    equal records count each.

    Pairs of record and term are never moved. A bucket sends one row per
    distinct word, the totals of just its words come back, and the records are
    scored where they lie. A word that is everywhere is one row per bucket.
    Results that differ by less than rounding tie.
    """
    if by not in ("z", "tf_idf"):
        raise ValueError("by must be z or tf_idf")
    kind = bucketed.schema[key].dataType.simpleString()
    rows = bucketed.filter(F.length("text") > 0).select("_bucket", F.col(key).alias("key"), "text")
    own = rows.select("_bucket", "text").mapInArrow(vocabularies, "_bucket int, term string, records long, occurrences long")
    w = Window.partitionBy("term")
    totals = own.select("_bucket", "term", *(F.sum(c).over(w).alias(c) for c in ("records", "occurrences")))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        terms = right.column("term").to_pylist()
        at = {t: i for i, t in enumerate(terms)}
        df, cf = (right.column(c).to_numpy().astype(float) for c in ("records", "occurrences"))
        counts, index, sizes, lengths = [], [], [], []
        for text in left.column("text").to_pylist():
            ws = WORD.findall(text.lower())
            c = Counter(ws)
            counts += c.values()
            index += map(at.__getitem__, c)
            sizes.append(len(c))
            lengths.append(len(ws))
        if index:
            n, total = df[at[TOTALS]], cf[at[TOTALS]]
            tf, ix, sizes = np.array(counts, float), np.array(index), np.array(sizes)
            of = np.repeat(np.arange(len(sizes)), sizes)
            z = z_scores(tf, cf[ix], np.repeat(np.array(lengths, float), sizes), total, prior)
            tf_idf = tf * np.log(n / df[ix])
            value = np.where(df[ix] >= least_records, z if by == "z" else tf_idf, -np.inf)
            best = np.full(len(sizes), -np.inf)
            np.maximum.at(best, of, value)
            top = best[of]
            with np.errstate(invalid="ignore"):
                won = np.flatnonzero((top > -np.inf) & (value >= top - 1e-12 * np.abs(top)))
        else:
            won = of = ix = np.array([], int)
            tf = z = tf_idf = np.array([])
        return pa.table(
            [
                left.column("key").combine_chunks().take(pa.array(of[won])),
                pa.array([terms[i] for i in ix[won]], pa.string()),
                *(pa.array(x.astype(np.int64)) for x in (tf[won], cf[ix[won]], df[ix[won]])),
                pa.array(z[won]),
                pa.array(tf_idf[won]),
            ],
            names=["key", "term", "tf", "occurrences", "records", "z", "tf_idf"],
        )

    out = rows.groupBy("_bucket").cogroup(totals.groupBy("_bucket")).applyInArrow(
        score, f"key {kind}, term string, tf long, occurrences long, records long, z double, tf_idf double"
    )
    return out.withColumnRenamed("key", key)
