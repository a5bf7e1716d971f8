"""Chat logs: collapse cumulative snapshots of a conversation, then render what remains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from tapecheck.operators.blocks import materialize

#: Turn numbers per piece of a conversation; a piece is the unit of ordering and rendering.
PIECE_TURNS = 1024
#: Rows and characters of the slices into which a longer conversation is cut, each rendered by itself.
SLICE_ROWS = 1024
SLICE_CHARS = 1 << 26


def _piece() -> Column:
    """Pieces follow turn order; rows without a turn number come first."""
    return F.when(F.col("turn").isNull(), F.lit(-(1 << 53))).otherwise(
        F.floor(F.col("turn") / F.lit(PIECE_TURNS)).cast("long")
    )


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns by two 64-bit hashes. A row repeated whole counts once."""
    body = [F.col("turn"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    return (
        conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
        .select(
            "conv_id",
            "turn",
            _piece().alias("piece"),
            F.xxhash64(F.lit(1), *body).alias("h1"),
            F.xxhash64(F.lit(2), *body).alias("h2"),
            (F.length(body[1]) + F.length(body[2])).cast("long").alias("chars"),
        )
        .distinct()
    )


def _total() -> list[Column]:
    return [F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.count("*").alias("n")]


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_chars, copies``: conversations that no other one continues.

    A conversation is dropped if its turns are the first turns of a longer one. Of equal
    conversations the smallest ``conv_id`` stays and ``copies`` counts them.

    A prefix is known by the exclusive-or of its turns' 128-bit hashes, each of which covers
    the turn number, so running prefixes can be computed piece by piece and completed
    with the totals of earlier pieces: a conversation of any length spreads over many tasks.
    Rows that share a turn number are one total before they are ordered, so a piece holds
    at most as many rows as turn numbers, however often those repeat.
    Prefixes and whole conversations are both made distinct before they meet in the
    anti-join, so a very common first turn is one row there.

    Prefixes end at turn numbers: rows that share a number belong together. A NULL ``role``
    or ``text`` equals an empty one; rows without ``turn`` come first; rows without
    ``conv_id`` form one conversation; a row repeated whole counts once; an empty table gives
    an empty result.
    """
    turns = materialize(_turns(conversations))
    whole = turns.groupBy("conv_id").agg(*_total(), F.sum("chars").alias("n_chars"))
    earlier = (
        Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        turns.groupBy("conv_id", "piece")
        .agg(*_total())
        .select(
            F.col("conv_id").alias("c_conv"),
            F.col("piece").alias("c_piece"),
            F.coalesce(F.bit_xor("x1").over(earlier), F.lit(0)).alias("c1"),
            F.coalesce(F.bit_xor("x2").over(earlier), F.lit(0)).alias("c2"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("cn"),
        )
    )
    run = Window.partitionBy("conv_id", "piece").orderBy("turn")
    inside = (
        turns.groupBy("conv_id", "piece", "turn")
        .agg(*_total())
        .select(
            "conv_id",
            "piece",
            F.bit_xor("x1").over(run).alias("r1"),
            F.bit_xor("x2").over(run).alias("r2"),
            F.sum("n").over(run).alias("rn"),
        )
    )
    totals = whole.select(F.col("conv_id").alias("w_conv"), F.col("n").alias("wn"))
    prefixes = (
        inside.join(
            carried,
            F.col("conv_id").eqNullSafe(F.col("c_conv")) & (F.col("piece") == F.col("c_piece")),
        )
        .join(totals, F.col("conv_id").eqNullSafe(F.col("w_conv")))
        .filter(F.col("rn") + F.col("cn") < F.col("wn"))
        .select(
            F.col("r1").bitwiseXOR(F.col("c1")).alias("x1"),
            F.col("r2").bitwiseXOR(F.col("c2")).alias("x2"),
            (F.col("rn") + F.col("cn")).alias("n"),
        )
        .distinct()
    )
    distinct = whole.groupBy("x1", "x2", "n").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"), F.first("n_chars").alias("n_chars")
    )
    return distinct.join(prefixes, ["x1", "x2", "n"], "left_anti").select(
        "conv_id", F.col("n").alias("n_turns"), "n_chars", "copies"
    )


def _escaped(text: Column) -> Column:
    """Keep text from opening or closing a turn by itself."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _rendered(pieces: GroupedData) -> DataFrame:
    """One text for each group of turns, in order; repeated turns count once."""
    turns = F.sort_array(F.collect_set(F.struct("turn", "role", "text")))
    return pieces.agg(
        F.array_join(
            F.transform(
                turns,
                lambda t: F.concat(
                    F.lit("<|"), _escaped(t["role"]), F.lit("|>\n"), _escaped(t["text"]), F.lit("<|end|>\n")
                ),
            ),
            "",
        ).alias("text")
    )


def _sliced(turns: DataFrame) -> DataFrame:
    """Distinct ``turns`` with the ``slice`` and ``block`` of their piece, which follow its order.

    Rows are dealt by range over their whole order, so that one piece may spread over many
    tasks; places within a range are completed with the counts of the ranges before it.
    """
    ranged = materialize(
        turns.repartitionByRange("conv_id", "turn", "role", "text")
        .withColumn("run", F.spark_partition_id())
        .distinct()
        .withColumn("chars", F.length("text").cast("long") + F.length("role"))
    )
    earlier = Window.partitionBy("conv_id", "piece").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ranged.groupBy("conv_id", "piece", "run")
        .agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
        .select(
            F.col("conv_id").alias("c_conv"),
            F.col("piece").alias("c_piece"),
            F.col("run").alias("c_run"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("cn"),
            F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("cc"),
        )
    )
    here = Window.partitionBy("conv_id", "piece", "run").orderBy("turn", "role", "text")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("rn", F.row_number().over(here) - 1)
        .withColumn("rc", F.coalesce(F.sum("chars").over(before), F.lit(0)))
        .join(
            carried,
            F.col("conv_id").eqNullSafe(F.col("c_conv"))
            & (F.col("piece") == F.col("c_piece"))
            & (F.col("run") == F.col("c_run")),
        )
        .withColumn("slice", F.floor((F.col("rn") + F.col("cn")) / SLICE_ROWS))
        .withColumn("block", F.floor((F.col("rc") + F.col("cc")) / SLICE_CHARS))
    )


def render_chats(conversations: DataFrame) -> DataFrame:
    """Render every conversation of :func:`maximal_conversations`.

    Returns ``conv_id, part, n_turns, copies, text``. A conversation is one row with ``part``
    0, unless its turn numbers leave the range of one piece or it has more than ``SLICE_ROWS`` turns or more than
    ``SLICE_CHARS`` characters: then it is cut by both, and each slice is a row, in order of ``part``, whose texts follow
    one another. So no row and no task gathers a long conversation, whether of many turns or of few huge ones, also
    without turn numbers or ``conv_id``; one turn is never cut. A turn reads ``<|role|>``, a line
    break, its text and ``<|end|>`` with a line break; ``<|`` inside a text becomes ``< |``.
    Turns with one number are ordered by role, then text, NULL first.
    """
    kept = materialize(maximal_conversations(conversations)).withColumnRenamed("conv_id", "k_conv")
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    brief = (F.col("n_turns") <= SLICE_ROWS) & (F.col("n_chars") <= SLICE_CHARS)
    turns = (
        turns.withColumn("piece", _piece())
        .join(kept, F.col("conv_id").eqNullSafe(F.col("k_conv")))
        .drop("k_conv")
    )
    short = _rendered(
        turns.filter(brief)
        .repartition("conv_id", "piece")  # by itself, so that a skewed join before it can be split
        .groupBy("conv_id", "piece", "n_turns", "copies")
    ).withColumn("part", F.row_number().over(Window.partitionBy("conv_id").orderBy("piece")) - 1)
    key = ["conv_id", "piece", "slice", "block"]
    long = materialize(
        _rendered(_sliced(turns.filter(~brief)).groupBy(*key, "n_turns", "copies"))
    )
    # Parts are numbered without their texts, which stay spread.
    order = Window.partitionBy("conv_id").orderBy(*key[1:])
    numbers = long.select(*(F.col(k).alias(f"p_{k}") for k in key), (F.row_number().over(order) - 1).alias("part"))
    same = F.col("conv_id").eqNullSafe(F.col("p_conv_id"))
    for k in key[1:]:
        same &= F.col(k) == F.col(f"p_{k}")
    out = ["conv_id", "part", "n_turns", "copies", "text"]
    return short.select(*out).unionByName(long.join(numbers, same).select(*out))
