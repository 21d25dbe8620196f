"""A mix of sources with target shares of tokens, by balanced sampling with the cube method."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.staging import written

#: Records that one flight balances at once.
BLOCK = 4096
#: Sources with a target that one mix may have: so many rows are planned in the driver and sent to all tasks.
SOURCES = 10_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the texts of this vocabulary are split before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of the documents that have tokens; ``tokenizer``: a rank file that every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    rows = documents.filter((F.length("text") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "source", "text")
    return rows.mapInArrow(run, "doc_id long, source string, tokens long")


def flight(chance: np.ndarray, tokens: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Moves chances to 0 or 1, keeping their sum and the sum of chance * tokens.

    Three open records at a time move along the null space of the two
    constraints, up or down by lot so that each chance is kept on average.
    At most two stay open; to ``land``, they are settled keeping only the sum
    as far as it goes.
    """
    p, t = chance.tolist(), tokens.tolist()
    draws = iter(rng.random(2 * len(p) + 4).tolist())
    open_: list[int] = []
    rest = iter(range(len(p)))

    def move(at: list[int], along: tuple[float, ...]) -> list[int]:
        up = min(((1 - p[k]) / u if u > 0 else p[k] / -u) for k, u in zip(at, along) if u)
        down = min((p[k] / u if u > 0 else (1 - p[k]) / -u) for k, u in zip(at, along) if u)
        step = up if next(draws) * (up + down) < down else -down
        still = []
        for k, u in zip(at, along):
            x = p[k] + step * u
            p[k] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
            if 0 < p[k] < 1:
                still.append(k)
        return still

    for k in rest:
        if 0 < p[k] < 1:
            open_.append(k)
            if len(open_) == 3:
                a, b, c = (t[i] for i in open_)
                open_ = move(open_, (c - b, a - c, b - a) if not a == b == c else (1.0, -1.0, 0.0))
    if land:
        while len(open_) > 1:
            open_ = move(open_[:2], (1.0, -1.0)) + open_[2:]
        if open_:
            p[open_[0]] = 1.0 if next(draws) < p[open_[0]] else 0.0
    return np.array(p)


def plan(sums: list, wanted: list, total: float | None) -> list[tuple[str, float]]:
    """(source, uses per record on average) for every source that has tokens.

    Without ``total``, the largest size at which every such source reaches its
    share within its repeats; shares of sources without tokens fall to the
    others in proportion.
    """
    tokens = {r.source: r.tokens for r in sums}
    there = [(w.source, w.target_share, w.max_repeats) for w in wanted if tokens.get(w.source, 0) > 0 and w.target_share > 0 and w.max_repeats > 0]
    whole = sum(s for _, s, _ in there)
    if total is None:
        total = min((cap * tokens[k] * whole / s for k, s, cap in there), default=0)
    return [(k, min(float(cap), total * s / whole / tokens[k])) for k, s, cap in there]


def mix(documents: DataFrame, targets: DataFrame, *, total: float | None = None, tokenizer: str = TOKENIZER, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(records, shares): (doc_id, source, tokens, copies) of every record used, and what each source of ``targets`` reached.

    ``targets``: (source, target_share, max_repeats); of several rows for a
    source the larger values hold, nulls count as 0. Each
    record of a source is used the whole part of its average use; the
    fractional part becomes a chance, and the cube method picks so that
    numbers and tokens of the picked add up. Flights run on blocks of about
    BLOCK records, chosen by a hash of the key; the two records at most that
    each leaves open meet in the next round, until one block per source
    lands. So a source with a third of all records is spread like the rest.
    ``total`` is the wanted size in tokens; where a source's repeats do not
    suffice for its share of it, its actual share falls short. Records without key or source, of a
    source without target, or without tokens are not used. ``shares``:
    (source, target_share, max_repeats, documents, available, used, copies,
    tokens, share); sources without documents show zeros. Equal texts are
    records of their own. More than SOURCES sources with a target are an
    error. Runs jobs when it is called.
    """
    share, cap = F.max(F.col("target_share").cast("double")), F.max(F.col("max_repeats").cast("int"))
    kinds = targets.filter("source IS NOT NULL").groupBy("source").agg(F.coalesce(share, F.lit(0.0)).alias("target_share"), F.coalesce(cap, F.lit(0)).alias("max_repeats"))
    wanted = kinds.limit(SOURCES + 1).collect()
    if len(wanted) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources with a target")
    spark = documents.sparkSession
    kinds = spark.createDataFrame(wanted, "source string, target_share double, max_repeats int")
    counted = written(token_counts(documents.join(F.broadcast(kinds.select("source")), "source", "left_semi"), tokenizer).filter("tokens > 0"))
    sums = counted.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).collect()  # a row per target source
    uses = plan(sums, wanted, total)
    rate = spark.createDataFrame(uses, "source string, uses double")
    rows = counted.join(F.broadcast(rate), "source").withColumn("base", F.floor("uses").cast("int"))
    state = rows.select("doc_id", "source", "tokens", "base", (F.col("uses") - F.col("base")).alias("chance"))
    blocks = {r.source: -(-r.n // BLOCK) for r in sums}
    done, k = [], 0
    while True:
        last = all(n == 1 for n in blocks.values())
        settled = written(flown(state, blocks, seed + k, last))
        if last:
            done.append(settled)
            break
        done.append(settled.filter("chance IN (0.0, 1.0)"))
        state = settled.filter("chance NOT IN (0.0, 1.0)")
        blocks = {s: -(-2 * n // BLOCK) for s, n in blocks.items()}
        k += 1
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    used = every.select("doc_id", "source", "tokens", (F.col("base") + F.col("chance").cast("int")).alias("copies")).filter("copies > 0")
    got = used.groupBy("source").agg(F.count(F.lit(1)).alias("used"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    there = counted.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available"))
    shares = kinds.join(there, "source", "left").join(got, "source", "left").na.fill(0)
    everything = got.agg(F.sum("tokens")).scalar()
    return used, shares.withColumn("share", F.coalesce(F.col("tokens") / everything, F.lit(0.0)))


def flown(state: DataFrame, blocks: dict[str, int], seed: int, land: bool) -> DataFrame:
    """The rows with their chances after a flight in each block of each source."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        rng = np.random.default_rng(xxhash.xxh3_64_intdigest(f"{seed} {key[0]} {key[1]}"))
        return rows.drop(columns="block").assign(chance=flight(rows["chance"].to_numpy(), rows["tokens"].to_numpy(), rng, land))

    n = state.sparkSession.createDataFrame(list(blocks.items()), "source string, _blocks long")  # a row per target source
    placed = state.join(F.broadcast(n), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("_blocks"))).drop("_blocks")
    return placed.groupBy("source", "block").applyInPandas(run, "doc_id long, source string, tokens long, base int, chance double")
