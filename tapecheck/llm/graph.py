"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapecheck.operators.blocks import materialize


def _directed(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller end, once each."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(
        "a != b"
    ).distinct()


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    """Number and digest of the edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


#: Edges that a task of a round holds at least.
TASK_EDGES = 100_000


def _dealt(edges: DataFrame, count: int) -> DataFrame:
    """``edges`` in as many tasks as ``count`` of them fill.

    A round exchanges its edges six times, and a table far smaller than the number of shuffle partitions would
    write more files than it has edges. What fills one task needs no exchange; joins forget that and are told again.
    """
    return edges.coalesce(-(-max(count, 1) // TASK_EDGES))


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: for every end of ``edges (a, b)`` the smallest node it is linked with.

    Alternates two steps that only ever replace an edge by one to a smaller node (large star:
    larger neighbours move to a node's least neighbour; small star: smaller ones do), so
    links are kept and the number of edges never grows. Rounds grow with the logarithm of a
    component's size. A node with very many neighbours is aggregated map-side and its
    edges meet its minimum in a join that Spark may split.
    """
    edges = materialize(_directed(edges))
    mark = _mark(edges)
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    while mark[0]:
        both = _dealt(edges, mark[0]).select(F.inline(ways))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _dealt(_directed(large), mark[0])
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _dealt(large.join(lowest, "a").select("a", "b", "m"), mark[0])
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        edges = materialize(_directed(small.select(F.inline(pairs))))
        before, mark = mark, _mark(_dealt(edges, mark[0]))
        if before == mark:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
