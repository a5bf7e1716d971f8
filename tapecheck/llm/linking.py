"""From buckets of candidates to confirmed links, without comparing all members of a bucket with each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapecheck.llm.graph import components
from tapecheck.operators.blocks import materialize


def may_match(percent: int, m: str, n: str) -> Column:
    """Sizes allow the wanted similarity."""
    return F.least(m, n) * 100 >= F.greatest(m, n) * percent


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .filter(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent)
        .select("a", "b")
    )


def with_pivots(shared: DataFrame) -> DataFrame:
    """``band, node, pivot`` from ``band, node, n``: of each bucket the node with the most partners over all its
    buckets (of copies edited at random the least edited)."""
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    central = (
        shared.join(weight, "node").groupBy("band").agg(F.max(F.struct("weight", F.col("node").alias("pivot"))).alias("best"))
    )
    return shared.join(central.select("band", "best.pivot"), "band").select("band", "node", "pivot")


def star(members: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of every pivot with the members of its buckets."""
    return members.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()


def mixed_members(members: DataFrame, found: DataFrame) -> DataFrame:
    """``band, node, label`` of the buckets whose members still lie in different components."""
    labelled = members.join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    mixed = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi")
    return labelled.join(mixed.select("band"), "band", "left_semi").select("band", "node", "label")


#: Up to how many members a bucket's pairs are listed; each member is in a bounded number of them then.
FEW = 64


def pairs_of_few(mixed: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of members of different components in the small buckets of ``band, node, label, n``."""
    small = mixed.filter(F.col("n") <= FEW)
    one = small.select("band", F.col("node").alias("a"), F.col("label").alias("x"))
    two = small.select("band", F.col("node").alias("b"), F.col("label").alias("y"))
    return one.join(two, "band").filter("a < b AND x != y").select("a", "b").distinct()


#: Members, and shingles of members, of one bucket that one call holds twice at most.
SLICE_NODES, SLICE_SHINGLES = 1024, 1 << 19


def remaining_links(
    members: DataFrame, sets: DataFrame, percent: int, estimate: tuple[int, int, int] | None = None
) -> DataFrame:
    """Links ``(a, b)`` between members of a bucket that lie in different components so far.

    ``members`` has ``band, node, label, same, n_shingles``, and packed signatures ``sig`` if an ``estimate``
    (bit planes, words a plane, most differing places) shall discard. A bucket is cut into slices by number and size of
    its sets, and every two slices meet in a group of their own, so no bucket is ever in one task. Inside, each member
    outside the commonest component is held against all members of others whose size allows a link; full sets decide.
    Of the links found only those that join two components leave, fewer than there are members.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node").combine_chunks()
        node, label, n, part = (rows.column(c).to_numpy() for c in ("node", "label", "n_shingles", "slice"))
        if estimate:
            planes, words, most = estimate
            sig = rows.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), planes, words)
        lists = rows.column("shingles").combine_chunks()
        starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        owner = np.repeat(np.arange(len(node)), np.diff(starts))
        group = np.unique(label, return_inverse=True)[1]
        across = key[1].as_py() != key[2].as_py()
        found: list[tuple[int, int]] = []
        for y in np.flatnonzero(group != np.argmax(np.bincount(group))):
            other = (group != group[y]) & (np.minimum(n, n[y]) * 100 >= np.maximum(n, n[y]) * percent)
            if across:
                other &= part != part[y]
            to = np.flatnonzero(other)
            if estimate:
                apart = np.bitwise_or.reduce(sig[to] ^ sig[y], axis=1)
                to = to[np.bitwise_count(apart).sum(axis=1) <= most]
            if not len(to):
                continue
            mine = np.zeros(int(codes.max()) + 1, bool)
            mine[codes[starts[y] : starts[y + 1]]] = True
            both = np.bincount(owner, mine[codes], len(node))[to]
            for x in to[both * 100 >= (n[to] + n[y] - both) * percent]:
                if group[x] != group[y]:
                    found.append((min(node[x], node[y]), max(node[x], node[y])))
                    group[group == group[x]] = group[y]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    counts = members.groupBy("band").agg(
        F.greatest(
            F.ceil(F.count("*") / F.lit(SLICE_NODES)), F.ceil(F.sum("n_shingles") / F.lit(SLICE_SHINGLES))
        ).alias("slices")
    )
    own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("long")
    dealt = members.join(counts, "band").withColumn("slice", own)
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    packed = ["sig"] if estimate else []
    return (
        met.withColumns({"i": F.least("slice", "other"), "j": F.greatest("slice", "other")})
        .select("band", "i", "j", "slice", "node", "label", "same", "n_shingles", *packed)
        .join(sets, ["node", "same"])
        .groupBy("band", "i", "j")
        .applyInArrow(run, "a long, b long")
        .distinct()
    )


def one_set_each(sets: DataFrame) -> DataFrame:
    """Materialised sets, each set of a node once."""
    sets = materialize(sets)
    if not sets.groupBy("node", "same").count().filter("count > 1").isEmpty():
        sets = materialize(sets.dropDuplicates(["node", "same"]))
    return sets


def completed(shared: DataFrame, sets: DataFrame, percent: int, links: DataFrame | None = None) -> DataFrame:
    """``node, component`` from buckets ``band, node, n`` in which every two similar sets meet.

    All members of a bucket are verified against its pivot; where that and the ``links`` known before leave members in
    different components, these are compared in slices. So no link between components is missed, and a
    large group of copies costs as many pairs as it has members.
    """
    sets_of = sets.select("node", "same", F.size("shingles").cast("long").alias("n_shingles"))
    members = materialize(with_pivots(shared))
    sizes = sets_of.select("node", "n_shingles")
    pairs = (
        star(members)
        .join(sizes.select(F.col("node").alias("a"), F.col("n_shingles").alias("m")), "a")
        .join(sizes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n")), "b")
        .filter(may_match(percent, "m", "n"))
        .select("a", "b")
        .distinct()
    )
    found = confirmed(pairs, sets, percent)
    links = materialize(found if links is None else found.unionByName(links))
    classes = materialize(components(links))
    apart = mixed_members(members, classes).join(sets_of, "node")
    late = materialize(remaining_links(apart, sets, percent))
    if late.isEmpty():  # the first components are complete
        return classes
    return components(links.unionByName(late))
