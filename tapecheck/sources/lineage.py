"""From every artifact to where it comes from in the end, through any number of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapecheck.operators.blocks import materialize


def lineage_closure(catalog: DataFrame) -> DataFrame:
    """``path, root, depth, status`` for every artifact of ``catalog (path, sha256, parent_path, parent_sha256)``.

    Pointers double: in every round each artifact takes over the pointer of the one it points to, so a chain of n
    steps takes log2(n) rounds of one join. Artifacts whose chain has ended are only looked up in later rounds, and a round in
    which none ends leaves rings alone, however large the table is. ``root`` is the last artifact of the
    chain, ``depth`` the steps to it. An artifact whose chain holds a step to a missing artifact is ``parent_missing``, one with
    a step whose recorded hash is not the parent's is ``hash_differs`` (if both, ``parent_missing``), and one whose chain never
    ends, in a ring or leading into one, is a ``cycle``; those have no root. Paths must be unique and not NULL.
    """
    parent = catalog.select(F.col("path").alias("parent_path"), F.col("sha256").alias("__actual"))
    direct = catalog.select("path", "parent_path", "parent_sha256").join(parent, "parent_path", "left")
    has = F.col("parent_path").isNotNull()
    pointers = materialize(
        direct.select(
            "path",
            F.when(has & F.col("__actual").isNotNull(), F.col("parent_path")).alias("next"),
            F.when(has, 1).otherwise(0).cast("long").alias("depth"),
            F.col("path").alias("last"),
            (has & F.col("__actual").isNull()).alias("missing"),
            (has & F.col("__actual").isNotNull() & ~F.col("__actual").eqNullSafe(F.col("parent_sha256"))).alias("differs"),
        )
    ).withColumn("last", F.coalesce("next", "last"))
    done, open_ = pointers.where("next is null"), pointers.where("next is not null")
    left = open_.count()
    while left:
        every = done.unionByName(open_)
        ahead = every.select(
            F.col("path").alias("next"), F.col("next").alias("__next"), F.col("depth").alias("__depth"),
            F.col("last").alias("__last"), F.col("missing").alias("__missing"), F.col("differs").alias("__differs"),
        )
        moved = materialize(
            open_.join(ahead, "next").select(
                "path",
                F.col("__next").alias("next"),
                (F.col("depth") + F.col("__depth")).alias("depth"),
                F.col("__last").alias("last"),
                (F.col("missing") | F.col("__missing")).alias("missing"),
                (F.col("differs") | F.col("__differs")).alias("differs"),
            )
        )
        done, open_ = done.unionByName(moved.where("next is null")), moved.where("next is not null")
        before, left = left, open_.count()
        if left == before:  # round r ends what is 2^(r-1) to 2^r - 1 steps from its end; if nothing is, no longer chain ends
            break
    pointers = done.unionByName(open_)
    status = (
        F.when(F.col("next").isNotNull(), "cycle").when(F.col("missing"), "parent_missing")
        .when(F.col("differs"), "hash_differs").otherwise("ok")
    )
    ended = F.col("next").isNull()
    return pointers.select(
        "path",
        F.when(ended & ~F.col("missing"), F.col("last")).alias("root"),
        F.when(ended, F.col("depth")).alias("depth"),
        status.alias("status"),
    )
