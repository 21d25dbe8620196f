import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


PAGE = "title string, ns int, id long, redirect struct<_title:string>, revision struct<id:long, contributor_id:long, saved_at:timestamp>, text string, loaded_at timestamp, _rev int, `key` string"


@pytest.fixture(scope="session")
def page(spark):
    """Rows (title, ns, id, redirect title or None or ..., revision, text) as a page table with extra columns whose names operators use inside."""

    def make(rows):
        out = []
        for title, ns, i, to, rev, text in rows:
            redirect = None if to is None else ((None if to is ... else to),)
            out.append((title, ns, i, redirect, None if rev is None else (rev, None, None), text, None, 7, "x"))
        return spark.createDataFrame(out, PAGE)

    return make


@pytest.fixture
def no_skew_join(spark):
    """Without the engine's own help against skew."""
    off = {"spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in off.items():
        spark.conf.set(k, v)
    yield
    for k in off:
        spark.conf.unset(k)


def largest_partition(df):
    return max(r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
