import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import largest_partition
from textloom.operators import pages, sizing, skew, staging


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_current_rows_and_articles(page):
    table = page(
        [
            ("A", 0, 1, None, 1, "alt"), ("A", 0, 1, None, 2, "neu"), ("A", 0, 1, None, 2, "neu"), ("B", 1, 2, None, 1, "x"), ("C", 0, 3, ..., 1, "x"), ("D", 0, 4, "A", 1, "x"),
            ("E", 0, None, None, 1, "x"), ("", 0, 5, None, 1, "x"), (None, 0, 6, None, 1, "x"), ("G", 0, 7, None, 1, ""), ("H", 0, 8, None, 1, None), ("I", 0, 9, None, None, "ohne"),
            ("J", 0, 10, None, 5, "war Artikel"), ("J", 0, 10, "A", 6, "jetzt Weiterleitung"), ("K", None, 11, None, 1, "x"),
        ]
    )
    assert rows(pages.articles(table)) == [(1, "neu"), (9, "ohne")]
    assert rows(pages.article_buckets(table, 3).select("id", "text")) == [(1, "neu"), (9, "ohne")]
    assert rows(pages.current(table, title=F.col("title")).select("id")) == sorted(((i,) for i in range(1, 12)), key=repr)
    assert pages.articles(page([])).count() == 0


def test_latest_rows_with_clashing_column(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 3, "c")], "k int, _nth int, v string")
    assert rows(pages.latest_rows(df, ["k"], [F.desc("_nth")])) == [(1, 2, "b")]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    data = [("heiß" if rng.random() < 0.4 else f"k{rng.randrange(40)}", rng.randrange(300), "extra") for _ in range(5000)]
    data += [(None, 1, "e"), ("heiß", None, "e"), ("k1", None, "e"), ("nur null", None, "e")]
    return data, spark.createDataFrame(data, "k string, v int, weight string")


def test_key_summary(skewed):
    data, df = skewed
    got = {r.k: (r.n_rows, r.n_values, r.mode) for r in skew.key_summary(skew.compress(df, "k", "v"), "k", "v").collect()}
    for k in {d[0] for d in data}:
        values = Counter(v for x, v, _ in data if x == k and v is not None)
        mode = min((-n, v) for v, n in values.items())[1] if values else None
        assert got[k] == (sum(x == k for x, _, _ in data), len(values), mode)


def test_key_percentiles(skewed):
    data, df = skewed
    at = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {(r.k, r.p): r.v for r in skew.key_percentiles(skew.compress(df, "k", "v"), "k", "v", at, splits=8).collect()}
    want = {}
    for k in {d[0] for d in data}:
        values = sorted(v for x, v, _ in data if x == k and v is not None)
        for p in at if values else []:
            want[k, p] = values[max(1, -int(-(round(p * len(values), 9)) // 1)) - 1]
    assert got == want


def test_heavy_pairs(skewed, spark):
    data, df = skewed
    counted = [(k, v) for k, v, _ in data if k is not None and v is not None]
    n = Counter(k for k, _ in counted)
    want = {(k, v) for k, v in counted if n[k] * 50 >= len(counted)}
    assert {tuple(r) for r in skew.heavy_pairs(df, "k", "v", "0.02").collect()} == want
    # exactly the share is heavy
    even = spark.createDataFrame([(f"k{i % 50}", i) for i in range(100)], "k string, v int")
    assert skew.heavy_pairs(even, "k", "v", "0.02").count() == 100
    assert skew.heavy_pairs(even.filter("false"), "k", "v", "0.02").count() == 0


def test_heavy_pairs_move_no_row_twice(skewed):
    plan = skew.heavy_pairs(skewed[1], "k", "v", "0.02")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_partitions_follow_the_size(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(200_000).selectExpr("id", "sha2(cast(id as string), 256) AS text").repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    size = sizing.input_bytes(df)
    assert size == sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert sizing.input_bytes(df.select("id").filter("id > 5")) == size and sizing.input_bytes(spark.createDataFrame([(1,)], "a int")) is None
    assert sizing.partitions(df) == 4  # the session's, as one partition would do
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    assert sizing.partitions(df) == -(-size // (1 << 19))
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_of_a_hot_key(spark, no_skew_join, how):
    """A third of all rows have one key, and as many null; no task takes a third."""
    data = [(0 if i % 3 == 0 else None if i % 3 == 1 else i, i) for i in range(9000)]
    rows = spark.createDataFrame(data, "k int, v int").repartition(8)
    side = {None: "null", 0: "null und eins", **{i: str(i) for i in range(5, 9000, 2)}}
    out = skew.spread_join(rows, spark.createDataFrame(list(side.items()), "k int, x string"), ["k"], how)
    want = [(k, v, side.get(k)) for k, v in data if how == "left" or k in side]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert largest_partition(out) < 2000
    assert skew.spread_join(rows.filter("false"), rows.select("k").filter("false").withColumn("x", F.lit(1)), ["k"], how).count() == 0


def test_percentiles_of_a_hot_key_stay_spread(spark, no_skew_join):
    rows = spark.createDataFrame([("heiß" if i % 3 == 0 else f"k{i}", i) for i in range(9000)], "k string, v int")
    got = {(r.k, r.p): r.v for r in skew.key_percentiles(skew.compress(rows, "k", "v"), "k", "v", [0.5, 1.0]).collect()}
    assert got["heiß", 0.5] == 4497 and got["heiß", 1.0] == 8997 and got["k1", 0.5] == 1


def test_written_tables_are_counted_even_if_empty(spark):
    t = spark.range(5)
    nothing = t.filter("false")
    late = t.join(t.filter("id > 9").repartition(2).withColumnRenamed("id", "j"), F.col("id") == F.col("j"))
    cases = ((t, 5), (nothing, 0), (late, 0), (late.groupBy("id").count(), 0), (nothing.agg(F.count("*").alias("n")), 1), (t.limit(0), 0), (t.unionAll(nothing).distinct(), 5), (spark.createDataFrame([], "a int"), 0))
    for df, n in cases:
        out = staging.written(df)
        assert staging.counted(out) == n == out.count()
    staging.discard(out)
