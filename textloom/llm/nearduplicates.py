"""Near-duplicate records: SuperMinHash, banding, exact verification, grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import components
from textloom.llm.superminhash import STEP, bands, mix, signatures
from textloom.llm.words import WORD
from textloom.operators.skew import spread_join
from textloom.operators.staging import written

#: Shingles worked on at once, and words whose hashes a task remembers.
CHUNK, KNOWN = 200_000, 1_000_000
#: Records of a band, or copies of a text, that meet in one slice of it; places over which a band is spread at least.
HOT, SPREAD = 256, 16
#: A band that a COMMON-th of some records have is spread.
COMMON = 64


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive word hashes."""
    out = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for i in range(width):
        out = mix(out + hashes[i : i + len(out)]) * STEP
    return out


def band_rows(width: int, n_bands: int, rows: int):
    """(id, text) to (band, id, n, hot), a row per band; records without a single run of ``width`` words give none.

    n: different runs of the record; hot: whether more than a COMMON-th of the
    records it was worked on with, and two at least, have the band.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def of(w: str) -> int:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
            return h

        def emit(ids, sets) -> Iterator[pa.RecordBatch]:
            if ids:
                sizes = [len(s) for s in sets]
                table = signatures(np.concatenate(sets), np.repeat(np.arange(len(ids)), sizes), len(ids), n_bands * rows)
                out = bands(table, n_bands).view(np.int64).ravel()
                each = [np.repeat(np.array(x), n_bands) for x in (np.array(ids, np.int64), np.array(sizes, np.int32))]
                _, which, times = np.unique(out, return_inverse=True, return_counts=True)
                hot = times[which] >= max(2, -(-len(ids) // COMMON))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (out, *each, hot)], ["band", "id", "n", "hot"])

        ids, sets, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(known) > KNOWN:
                    known.clear()
                ws = WORD.findall(text.lower())
                hashes = np.array([known.get(w) or of(w) for w in ws], np.uint64)
                s = np.unique(shingle_hashes(hashes, width))
                if not len(s):
                    continue
                if size + len(s) > CHUNK:
                    yield from emit(ids, sets)
                    ids, sets, size = [], [], 0
                ids.append(i)
                sets.append(s)
                size += len(s)
        yield from emit(ids, sets)

    return run


def verify(width: int, least: float):
    """(a, b, text_a, text_b) to (a, b, similarity) where it is at least ``least``; equal texts in a row are cut up once."""

    def sets(text: str) -> frozenset:
        ws = WORD.findall(text.lower())
        return frozenset(zip(*(ws[i:] for i in range(width))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, frozenset] = (None, frozenset())
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if b != last[0]:
                    last = b, sets(y)
                s, t = sets(x), last[1]
                common = len(s & t)
                if common and common >= least * (len(s) + len(t) - common) - 1e-9:
                    for column, v in zip(out, (a, b, common / (len(s) + len(t) - common))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["a", "b", "similarity"])

    return run


#: Two hashes of a text, case left out: the same for exact copies.
PRINTS = {f"f{k}": lambda text, k=k: F.xxhash64(F.lower(text), F.lit(k)) for k in (0, 1)}


def fingerprint() -> list[Column]:
    return [f(F.col("text")).alias(c) for c, f in PRINTS.items()]


def has_run(width: int, text: Column | None = None) -> Column:
    """Whether the text has as many words."""
    word, gap = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
    return (F.col("text") if text is None else text).rlike(f"(?:{word}{gap}){{{width - 1}}}{word}")


def classes(records: DataFrame) -> DataFrame:
    """(id, rep): of every record the least id among those with the same text but for case."""
    return same(written(records.select("id", *fingerprint())))


def same(prints: DataFrame) -> DataFrame:
    """``classes`` of rows (id, f0, f1)."""
    reps = prints.groupBy("f0", "f1").agg(F.min("id").alias("rep"))
    return spread_join(prints, reps, ["f0", "f1"]).select("id", "rep")


def places(df: DataFrame) -> int:
    """Over how many places a band is spread: so many that a third of all records, at 64 bands each, takes no more room in one than an average shuffle partition."""
    return max(SPREAD, -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 192))


def slices(n: str) -> Column:
    return F.ceil(F.col(n) / HOT).cast("int")


def slice_of(i: str, n: str) -> Column:
    return F.pmod(F.xxhash64(i), slices(n)).cast("int")


def candidates(bands: DataFrame, least: float = 0.0) -> DataFrame:
    """(a, b), a < b, distinct: ids that share a band, of rows (band, id, n, hot), but for those whose numbers n of runs alone keep the similarity under ``least``.

    Rows move once: by band, and where they are ``hot`` also by a hash of the
    id, so that a band with a third of all records is spread (see ``places``).
    A band is hot if any of its rows is; of these few bands the rows that are
    not hot are told. All other bands are counted where they lie, and those of
    one record, nearly all, are out at once. A band of
    more than HOT records is cut into slices of about HOT, and each two of its
    slices meet in a cell of their own; a smaller band is one cell. So no task
    holds more than two slices of a band at a time, and no pair is lost.
    """
    spread = places(bands)
    place = F.coalesce(F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(spread)) + 1), F.lit(0)).cast("int")
    rows = bands.filter("band IS NOT NULL AND id IS NOT NULL").select("band", "id", "n", place.alias("s")).repartition("band", "s")
    # the count looks at the same columns as the join, so that the shuffle and what lies before it run once
    parts = rows.groupBy("band", "s").agg(F.count_if((F.col("id") >= F.lit(-(1 << 63))) & (F.col("n") >= 0)).alias("m"))
    told = parts.filter("s > 0 OR m > 1")
    hot = told.groupBy("band").agg(F.sum("m").alias("m"), F.max("s").alias("top")).filter("top > 0")
    everywhere = hot.select("band", "m", F.explode(F.sequence(F.lit(0), F.lit(spread))).alias("s"))
    told = told.select("band", "s", F.col("m").alias("here"))
    several = told.join(everywhere, ["band", "s"], "full").select("band", "s", F.coalesce("m", "here").alias("m"))
    shared = rows.join(several, ["band", "s"]).select("band", "id", "n", slices("m").alias("of"), slice_of("id", "m").alias("slice"))
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda x: F.struct(F.least(x, "slice").alias("x"), F.greatest(x, "slice").alias("y"))))
    cells = shared.select("band", meets.alias("cell"), F.struct("id", "n", "slice").alias("r")).groupBy("band", "cell").agg(F.collect_list("r").alias("rs"))
    each = cells.filter("size(rs) > 1").select("cell", "rs", F.explode("rs").alias("r"))

    def partner(b):
        alike_in_size = F.least(F.col("r.n"), b["n"]) >= F.lit(least - 1e-9) * F.greatest(F.col("r.n"), b["n"])
        # two records of one slice meet in the cell of that slice alone
        return (F.col("r.id") < b["id"]) & alike_in_size & ((F.col("r.slice") != b["slice"]) | (F.col("cell.x") == F.col("cell.y")))

    return each.select(F.col("r.id").alias("a"), F.explode(F.transform(F.filter("rs", partner), lambda b: b["id"])).alias("b")).distinct()


def alike(records: DataFrame, *, width: int = 5, least: float = 0.8, n_bands: int = 64, rows: int = 4) -> DataFrame:
    """(a, b, similarity), a < b: pairs of different texts whose sets of ``width`` consecutive words are alike by at least ``least`` (Jaccard).

    ``records``: (id long, text string), id unique; other columns are not
    read. Exact copies stand in as their least id (see ``classes``), so a huge
    group of copies is one record here. Records with no run of ``width`` words
    (null, empty, short) are in no pair. Candidates share one of ``n_bands``
    bands of ``rows`` slots; a pair of similarity s is missed with chance
    (1 - s^rows)^n_bands, under 0.015 % at 0.6. Every candidate is verified
    on the words themselves.
    """
    texts = records.filter(F.length("text") > 0).select("id", "text")
    reps = texts.groupBy(*fingerprint()).agg(F.min("id").alias("id")).select("id")
    bands = texts.join(reps, "id", "left_semi").mapInArrow(band_rows(width, n_bands, rows), "band long, id long, n int, hot boolean")
    pairs = candidates(bands, least)
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(verify(width, least), "a long, b long, similarity double")


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of representatives for all their copies, and the copies of one text among themselves.

    ``members``: ``classes`` of the records with enough words to be alike (see
    ``has_run``). A text of more than HOT copies is cut into slices of about
    HOT, and each of its pairs goes to all of these, so no task takes more than
    HOT copies against the others.
    """
    copied = written(members.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    # records without copies stand for themselves and are in no join
    several = written(spread_join(members, copied, ["rep"]))
    sides = several.select("rep", slice_of("id", "m").alias("slice"), "id")

    def swapped(rows: DataFrame, end: str) -> DataFrame:
        sized = spread_join(rows, copied.withColumnRenamed("rep", end), [end], "left")
        alone = sized.filter("m IS NULL").drop("m")
        sliced = sized.filter("m IS NOT NULL").withColumn("slice", F.explode(F.sequence(F.lit(0), slices("m") - 1))).drop("m")
        of = sides.select(F.col("rep").alias(end), "slice", F.col("id").alias("i"))
        return alone.unionByName(sliced.join(of, [end, "slice"]).withColumn(end, F.col("i")).drop("i", "slice"))

    across = swapped(written(swapped(written(pairs.select("a", "b")), "a")), "b")
    x = several.select("rep", F.explode(F.sequence(F.lit(0), slices("m") - 1)).alias("slice"), F.col("id").alias("i"))
    copies = x.join(sides.withColumnRenamed("id", "j"), ["rep", "slice"]).filter("i < j")
    return across.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).unionAll(copies.select(F.col("i").alias("id_a"), F.col("j").alias("id_b")))


def groups(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group_id, n_links): ``linked`` of the records with a text."""
    return linked(classes(records.filter(F.length("text") > 0)), pairs)


def linked(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group_id, n_links): every record with the least id of its group and its number of similar other texts. Copies are not expanded."""
    members, pairs = written(members), written(pairs.select("a", "b"))
    tied = components.components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    of = written(links.join(tied.withColumnRenamed("vertex", "rep"), "rep"))
    out = spread_join(members, of, ["rep"], "left")
    return out.select("id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
