"""Connected components of a graph of pairs.

Rounds of stripping: vertices with one neighbour are removed, chains of
vertices with two are shortened by list ranking on independent sets (a random
priority per round picks chain vertices of which no two are neighbours; each
points to one neighbour, and its two neighbours are joined). Trees and cycles
vanish this way in a number of rounds logarithmic in their size. Where every
vertex has three neighbours or more, the core, half of the vertices become
heads by a random bit and the others join a head beside them. Then labels are
restored by pointer doubling from removed vertices to kept ones.

A vertex is only ever judged by aggregates of fixed size over its edges, and
edges are struck by grouping on the pair; where rows take over a label, those
of a heavy vertex or root stay where they are and the label comes to them
(``skew.spread_join``). So a vertex with a third of all edges, or a component
with a third of all vertices, is spread like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.skew import spread_join
from textloom.operators.staging import counted, discard, written


def both_ways(pairs: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
    return pairs.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(ends).select("e.u", "e.v").distinct()


def stripped(edges: DataFrame, seed: int) -> DataFrame:
    """(u, p, q): vertices with one or two neighbours p <= q of which none that is next to another one of them is less by priority."""
    few = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("p"), F.max("v").alias("q")).filter("n <= 2")
    rank = F.struct(F.xxhash64("u", F.lit(seed)).alias("h"), F.col("u").alias("u"))
    told = few.select(F.explode(F.array_distinct(F.array("p", "q"))).alias("to"), F.xxhash64("u", F.lit(seed)).alias("h"), F.col("u").alias("by"))
    # least rank among the neighbours with few edges; a flat pair of aggregates keeps the hash aggregation's buffers fixed
    least = told.groupBy("to").agg(F.min("h").alias("h"), F.min_by("by", "h").alias("by"))
    near = F.struct(F.col("h").alias("h"), F.col("by").alias("u"))
    return few.join(least, few["u"] == least["to"], "left").filter(F.col("to").isNull() | (rank < near)).select("u", "p", "q")


def without(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """The edges after removal: those of removed vertices struck, chain neighbours joined."""

    def pair(a: str, b: str, struck: bool):
        return F.struct(F.col(a).alias("u"), F.col(b).alias("v"), F.lit(struck).alias("struck"))

    changes = removed.select(
        F.explode(F.array(pair("u", "p", True), pair("p", "u", True), pair("u", "q", True), pair("q", "u", True), pair("p", "q", False), pair("q", "p", False))).alias("e")
    ).select("e.*")
    rows = edges.withColumn("struck", F.lit(False)).unionByName(changes).filter("u <> v")
    return rows.groupBy("u", "v").agg(F.max("struck").alias("struck")).filter("NOT struck").select("u", "v")


def joined(edges: DataFrame, seed: int) -> DataFrame:
    """(u, p): vertices that are no heads, each with a head beside it."""
    head = lambda c: F.xxhash64(c, F.lit(seed)) % 2 == 0
    return edges.filter(~head("u") & head("v")).groupBy("u").agg(F.min("v").alias("p"))


def renamed(edges: DataFrame, removed: DataFrame, end: str) -> DataFrame:
    """The edges with each removed vertex at one end replaced by the one it joined."""
    to = removed.select(F.col("u").alias(end), F.col("p").alias("to"))
    return spread_join(edges, to, [end], "left").withColumn(end, F.coalesce("to", end)).select("u", "v")


def components(pairs: DataFrame) -> DataFrame:
    """(vertex, component): every vertex of an edge (u, v), with the least vertex it is linked to directly or indirectly.

    Edges with a null end count for nothing and loops link nothing; repeated
    edges count once; an empty table gives no rows. u and v: of one orderable
    type; other columns are not read. Runs jobs when it is called, with a
    table per round in the shared folder.
    """
    edges = written(both_ways(pairs.select("u", "v")))
    if not counted(edges):
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    gone, seed = [], 0
    while counted(edges):
        seed += 1
        removed = written(stripped(edges, seed))
        if counted(removed):
            smaller = written(without(edges, removed))
        else:
            removed = written(joined(edges, seed))
            half = written(renamed(edges, removed, "u"))
            smaller = written(renamed(half, removed, "v").filter("u <> v").distinct())
            discard(half)
        gone.append(removed)
        discard(edges)
        edges = smaller
    forest = written(reduce(DataFrame.unionAll, (r.select(F.col("u").alias("vertex"), F.col("p").alias("root")) for r in gone)))
    for r in gone:
        discard(r)
    steps = 1
    while steps < seed:  # a path to a root has at most one step per round
        up = forest.select(F.col("vertex").alias("root"), F.col("root").alias("up"))
        higher = written(spread_join(forest, up, ["root"], "left").select("vertex", F.coalesce("up", "root").alias("root")))
        discard(forest)
        forest = higher
        steps *= 2
    # a root is the vertex of no row; it stands for itself
    trees = forest.unionAll(forest.select("root").distinct().select(F.col("root").alias("vertex"), "root"))
    least = forest.groupBy("root").agg(F.min("vertex").alias("low")).select("root", F.least("low", "root").alias("component"))
    return spread_join(trees, least, ["root"]).select("vertex", "component")
