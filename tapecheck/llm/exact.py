"""Exact duplicates: a 128-bit content hash groups texts, a byte comparison confirms the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapecheck.llm.text import lower_ascii
from tapecheck.operators.blocks import materialize


def content_digest(text: Column) -> Column:
    """128 bits of the text's bytes."""
    return F.unhex(F.md5(text))


def _classes(rows: DataFrame, keys: list[str], keep: str) -> DataFrame:
    pick = {"largest": F.max, "smallest": F.min}[keep]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("group_size"),
        pick("doc_id").alias("keep_id"),
        F.min("norm").alias("low"),
        F.max("norm").alias("high"),
    )


def exact_duplicates(
    docs: DataFrame,
    keep: str = "smallest",
    digest: Callable[[Column], Column] = content_digest,
) -> DataFrame:
    """One row per row of ``docs``: its group of equal texts and the row that stays.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256, digest``. Texts are equal
    when identical after lower-casing A-Z. Of each group the row with the smallest (or
    largest) ``doc_id`` stays.

    Groups are aggregated before the shuffle, each task sending one row per distinct text.
    Bytes are compared by the least and the greatest text under a digest: they differ only
    if the digest collides, and then those rows are grouped again by the whole text.

    A NULL text counts as empty. Rows without ``doc_id`` join their group, but stay only if
    no row of the group has an id. Of rows that repeat id and text, exactly one stays. Extra
    columns are not read. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", lower_ascii(F.col("text")).alias("norm")).withColumn(
        "digest", digest(F.col("norm"))
    )
    classes = materialize(
        _classes(rows, ["digest"], keep).select(
            "digest",
            "group_size",
            "keep_id",
            F.sha2("low", 256).alias("text_sha256"),
            (F.col("low") != F.col("high")).alias("collides"),
        )
    )
    sound = classes.filter(~F.col("collides")).drop("collides")
    marked = rows.select("doc_id", "digest").join(sound, "digest")
    collided = classes.filter("collides").select("digest")
    if not collided.isEmpty():
        mixed = rows.join(collided, "digest", "left_semi")
        apart = _classes(mixed, ["digest", "norm"], keep).select(
            "digest", "norm", "group_size", "keep_id", F.sha2("norm", 256).alias("text_sha256")
        )
        marked = marked.unionByName(mixed.join(apart, ["digest", "norm"]).drop("norm"))
    # Of rows that repeat id and text one stays: the first by a number given to every row once. Only that number is
    # joined, so no group, however large, is in one place.
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    placed = materialize(marked.withColumn("at", F.monotonically_increasing_id()))
    stays = placed.filter(first).groupBy("digest", "text_sha256", "doc_id").agg(F.min("at").alias("at"))
    return placed.join(stays.select("at", F.lit(True).alias("kept")), "at", "left").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce("kept", F.lit(False)).alias("kept"),
        "text_sha256",
        "digest",
    )


def without_exact_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """``docs`` with one row for each group of :func:`exact_duplicates`, columns unchanged.

    Decided by id and text: of rows that repeat both one stays, and a row that shares only its id with a copy stays.
    Texts are compared whole at any length. An empty table gives an empty result; extra columns may have any name.
    """
    own = content_digest(lower_ascii(F.col("text")))
    rows = materialize(docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), own.alias("__digest")))
    marks = materialize(exact_duplicates(rows.select("__row.*"), keep))
    stays = marks.filter("kept").select(F.col("doc_id").alias("__kept"), F.col("digest").alias("__kept_digest")).distinct()
    same = F.col("__id").eqNullSafe(F.col("__kept")) & (F.col("__digest") == F.col("__kept_digest"))
    left = rows.join(stays, same, "left_semi")
    repeats = marks.filter("NOT kept").filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if not repeats.isEmpty():
        left = left.dropDuplicates(["__id", "__digest"])
    return left.select("__row.*")
