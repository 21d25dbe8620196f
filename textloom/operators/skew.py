"""Per-key results where a few keys hold most rows.

Value-frequency compression: group by key *and* value first. That shuffle is
spread by the value, so a heavy key costs no more than its share, and map-side
partial aggregation folds repeats before they move. Everything per key is then
derived from the weighted values, again through partial aggregates.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compress(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, weight): every distinct pair with its number of rows.

    Null values form a value of their own, null keys a key of their own; other
    columns are dropped. An empty table gives no rows.
    """
    return df.groupBy(key, value).agg(F.count(F.lit(1)).alias("weight"))


def key_summary(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: rows, exact distinct values (nulls apart), and the mode (the smallest value on a tie; nulls don't count).

    Needs only fixed-size buffers: partial aggregation leaves one row per key and task.
    """
    weight = F.when(F.col(value).isNotNull(), F.col("weight"))
    return pairs.groupBy(key).agg(
        F.sum("weight").alias("n_rows"),
        F.count(value).alias("n_values"),
        F.min(F.when(weight.isNotNull(), F.struct((-weight).alias("w"), F.col(value).alias("v"))))["v"].alias("mode"),
    )


def heavy_keys(rows: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """(keys): the keys that hold at least a ``parts``-th of all rows (by default four times the shuffle partitions), so at most so many.

    Counted by hash in each task first; null is a key like others.
    """
    parts = parts or 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.filter(F.col("_rows") * parts >= counts.agg(F.sum("_rows")).scalar()).select(*keys)


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", parts: int | None = None) -> DataFrame:
    """``rows`` joined to ``side``, which has at most one row per key, without bringing a heavy key to one task.

    Rows of heavy keys (see ``heavy_keys``: at most ``parts`` of them) stay
    where they are and meet their rows of ``side``, which are broadcast; all
    others are shuffled, and none of these keys fills a partition. Keys equal
    by ``<=>``, so null joins null. Both inputs are read twice: give tables, or
    what is cheap to work out. ``how``: inner or left. Columns: those of
    ``rows``, then those of ``side`` beside the keys, whose names must differ.
    """
    heavy = F.broadcast(heavy_keys(rows, keys, parts))
    renamed = side.select(*(F.col(k).alias(f"_side_{k}") for k in keys), *(c for c in side.columns if c not in keys))
    same = lambda a, b, form: reduce(and_, (a[k].eqNullSafe(b[form.format(k)]) for k in keys))
    out = [c for c in rows.columns] + [c for c in side.columns if c not in keys]
    marked = heavy.select(*(F.col(k).alias(f"_heavy_{k}") for k in keys))
    light = rows.join(F.broadcast(marked), same(rows, marked, "_heavy_{}"), "left_anti")
    few = renamed.join(F.broadcast(marked), reduce(and_, (renamed[f"_side_{k}"].eqNullSafe(marked[f"_heavy_{k}"]) for k in keys)), "left_semi")
    hot = rows.join(F.broadcast(marked), same(rows, marked, "_heavy_{}"), "left_semi")
    return light.join(renamed, same(light, renamed, "_side_{}"), how).select(*out).unionByName(hot.join(F.broadcast(few), same(hot, few, "_side_{}"), how).select(*out))


def salted_join(rows: DataFrame, side: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``side`` on ``key``, each key cut into places by a hash of ``by``, and ``side`` repeated for each place.

    For rows far more numerous than ``side``, in which a key may be in every
    record but only once in each: at the about 150 keys of a record, a key of
    all records takes no more room in one place than an average shuffle
    partition. Columns: the key, those of ``rows``, those of ``side``.
    """
    places = max(16, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 150))
    cut = rows.withColumn("_place", F.pmod(F.xxhash64(by), F.lit(places)))
    each = side.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(places - 1)).cast("array<bigint>")))
    return cut.join(each, [key, "_place"], how).drop("_place")


def key_percentiles(pairs: DataFrame, key: str, value: str, at: list[float], *, splits: int = 256) -> DataFrame:
    """(key, p, value): exact lower percentiles of each key, from weighted values; null values don't count.

    p of n rows is the row of rank max(1, ceil(p*n)). A heavy key's values are
    cut into up to ``splits`` ranges at approximate quantiles; weights are
    summed by range, and only a range is ever sorted in one task. Every value
    stays in, so the result is exact whatever the quantiles' error.
    """
    rows = pairs.filter(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.col("weight").alias("_w"))
    cuts = rows.groupBy("_k").agg(F.percentile_approx("_v", [i / splits for i in range(1, splits)], splits * 40).alias("_cuts"), F.sum("_w").alias("_n"))
    least = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = spread_join(rows, cuts, ["_k"], parts=least).select("_k", "_v", "_w", "_n", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_range"))
    sums = ranged.groupBy(F.col("_k").alias("_k2"), F.col("_range").alias("_range2")).agg(F.sum("_w").alias("_sum"))
    w = Window.partitionBy("_k2").orderBy("_range2")
    before = sums.select("_k2", "_range2", (F.sum("_sum").over(w) - F.col("_sum")).alias("_before"))
    placed = ranged.join(before, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_range") == F.col("_range2"))).select("_k", "_range", "_v", "_w", "_n", "_before")
    inner = Window.partitionBy("_k", "_range").orderBy("_v")
    ends = placed.withColumn("_end", F.col("_before") + F.sum("_w").over(inner))
    wanted = F.explode(F.array(*map(F.lit, map(float, at))))
    rank = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("_n")))
    return (
        ends.withColumn("p", wanted)
        .filter((rank <= F.col("_end")) & (rank > F.col("_end") - F.col("_w")))
        .select(F.col("_k").alias(key), "p", F.col("_v").alias(value))
    )


def heavy_pairs(df: DataFrame, key: str, value: str, share: str) -> DataFrame:
    """(key, value), distinct, of the keys that hold at least ``share`` of all rows (a decimal in text, as '0.02').

    The heavy keys are at most 1/share in number, which bounds what is
    broadcast; the compressed pairs then need no further shuffle. Rows with a
    null key or value count nowhere.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
    pairs = compress(rows, "k", "v")
    totals = pairs.groupBy("k").agg(F.sum("weight").alias("n"))
    everything = totals.agg(F.sum("n")).scalar()
    heavy = totals.filter(F.col("n") >= F.lit(Decimal(share)) * everything).select("k")
    return pairs.join(F.broadcast(heavy), "k", "left_semi").select(F.col("k").alias(key), F.col("v").alias(value))
