"""Connected components of an edge table, by alternating large and small stars.

Only aggregates with map-side combining and joins are used, so a node with a
third of all edges is pre-aggregated before the shuffle and its join partition
can be split; no neighbour list is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize


#: Edges for each task, so that small graphs are not dealt to hundreds of tasks.
EDGES_PER_TASK = 250_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and two sums over them: equal for equal graphs."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` of every node that has an edge; component is the
    smallest node id reachable.  Loops and repeated edges are harmless; nulls
    are ignored; no edge gives no rows."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now = materialize(now, "cc")
    mark = _mark(now)
    while mark[0]:
        tasks = 4 + mark[0] // EDGES_PER_TASK
        few = lambda df: df.coalesce(tasks)  # noqa: B023, E731
        # large star: each larger neighbour of a node is tied to the smallest of the node and its neighbours
        both = _both(now)
        least = few(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = few(few(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct())
        # small star: each smaller neighbour of a node, and the node, are tied to the smallest of them
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = few(large.join(least, "u"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        after = materialize(few(small.distinct()), "cc")
        before, mark = mark, _mark(after)
        discard(now)
        now = after
        if mark == before:  # a fixed point is a set of stars
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined(comp: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """Components after further links between their nodes, or nodes that had none: only the contracted graph is looked at."""
    to = comp.select("node", "component")
    ends = links.select(a, b).join(to.select(F.col("node").alias(a), F.col("component").alias("ca")), a, "left").join(to.select(F.col("node").alias(b), F.col("component").alias("cb")), b, "left")
    ends = materialize(ends.select(F.coalesce("ca", a).alias("ca"), F.coalesce("cb", b).alias("cb")).distinct(), "contracted")
    over = components(ends, "ca", "cb")
    grown = over.select(F.col("node").alias("component"), F.col("component").alias("top"))
    # old nodes follow their component; nodes that had no link before are components of their own
    old = to.join(grown, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = over.join(to.select(F.col("node")), "node", "left_anti")
    return old.unionByName(new)
