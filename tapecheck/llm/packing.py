"""Best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapecheck.operators.blocks import materialize, numbered

CAPACITIES = (512, 1024, 2048, 4096)


@dataclass(frozen=True)
class Step:
    """Pieces ``first..first+count-1`` of one length go, ``per_bin`` at a time, to bins from ``first_bin`` on."""

    length: int
    first: int
    count: int
    first_bin: int
    per_bin: int
    offset: int


@dataclass(frozen=True)
class Plan:
    steps: tuple[Step, ...]
    #: ``(first bin, number of bins, tokens used, capacity)``, covering all bins in order.
    bins: tuple[tuple[int, int, int, int], ...]


def default_cost(capacity: int) -> float:
    """Tokens of a sequence, with a part for attention that grows with the square of its length."""
    return capacity + capacity * capacity / 16384


def _opening(length: int, later: Sequence[int], capacities: Sequence[int], cost) -> int:
    """The permitted capacity that costs least for each token it can be filled with.

    What a bin can be filled with is found by adding the largest length still waiting that
    fits, again and again; ``later`` holds those lengths in ascending order.
    """

    def filled(capacity: int) -> int:
        used = length
        while (i := bisect_left(later, capacity - used + 1)) > 0:
            used += later[i - 1] * ((capacity - used) // later[i - 1])
        return used

    return min((c for c in capacities if c >= length), key=lambda c: (cost(c) / filled(c), c))


def plan_bins(
    histogram: Mapping[int, int], capacities: Sequence[int] = CAPACITIES, cost=default_cost
) -> Plan:
    """Best fit over lengths in descending order, for all pieces of a length at a time.

    ``histogram`` counts pieces by length, which is at most the largest capacity; so the
    work and the plan are bounded by that capacity and not by the number of pieces. Each
    piece goes to the open bin with the least sufficient room; if there is none, a bin of
    the least-cost capacity is opened. In the end every bin shrinks to the smallest
    permitted capacity that holds its contents.

    Bins with the same room are interchangeable, hence kept as ranges of bin numbers.
    """
    capacities = sorted(capacities)
    ranges: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room: [(first bin, bins, used)]
    rooms: list[int] = []
    steps: list[Step] = []
    waiting = sorted(n for n, c in histogram.items() if n > 0 and c > 0)
    bins = 0

    def put(first: int, count: int, used: int, room: int) -> None:
        if count:
            if not ranges[room]:
                insort(rooms, room)
            ranges[room].append((first, count, used))

    for length in reversed(list(waiting)):
        left, done = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                capacity = _opening(length, waiting, capacities, cost)
                need = -(-left // (capacity // length))
                put(bins, need, 0, capacity)
                bins += need
                continue
            room = rooms[at]
            first, count, used = ranges[room].pop()
            if not ranges[room]:
                rooms.pop(at)
            per_bin = room // length
            full = min(count, left // per_bin)
            if full:
                steps.append(Step(length, done, full * per_bin, first, per_bin, used))
                done, left = done + full * per_bin, left - full * per_bin
                put(first, full, used + per_bin * length, room - per_bin * length)
                first, count = first + full, count - full
            if left and count:
                part = min(left, per_bin)
                steps.append(Step(length, done, part, first, per_bin, used))
                done, left = done + part, left - part
                put(first, 1, used + part * length, room - part * length)
                first, count = first + 1, count - 1
            put(first, count, used, room)
        waiting.pop()
    ends = sorted((first, count, used) for group in ranges.values() for first, count, used in group)
    return Plan(
        tuple(steps),
        tuple((f, c, u, next(k for k in capacities if k >= u)) for f, c, u in ends),
    )


def assignments(plan: Plan) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """The steps, cut where the final contents of their bins change.

    ``(length, first rank, pieces, first bin, pieces per bin, offset, used, capacity)``.
    """
    starts = [first for first, *_ in plan.bins]
    out = []
    for s in plan.steps:
        done, at = 0, bisect_right(starts, s.first_bin) - 1
        while done < s.count:
            first, count, used, capacity = plan.bins[at]
            begin = s.first_bin + done // s.per_bin
            size = min(s.count - done, (first + count - begin) * s.per_bin)
            out.append((s.length, s.first + done, size, begin, s.per_bin, s.offset, used, capacity))
            done, at = done + size, at + 1
    return out


def _rows(spark: SparkSession, rows: Sequence[Sequence[int]], names: str) -> DataFrame:
    """Integer rows of bounded number as a table, through one constant string."""
    fields = [n.strip() for n in names.split(",")]
    text = ";".join(" ".join(map(str, r)) for r in rows)
    cells = spark.range(1).select(F.explode(F.split(F.lit(text), ";")).alias("row"))
    return cells.filter("row != ''").select(
        *[F.split("row", " ")[i].cast("long").alias(n) for i, n in enumerate(fields)]
    )


def word_count(text: Column) -> Column:
    """Words between ASCII white space; the sequence length when no tokenizer is given."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\x09-\\x0D]+")).cast("long")


def cut(docs: DataFrame, largest: int, length: Column | None = None) -> DataFrame:
    """``doc_id, piece, start, length``: documents longer than ``largest`` in several pieces."""
    sized = docs.select("doc_id", (word_count(F.col("text")) if length is None else length).alias("n"))
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(largest)).cast("long"))
    return (
        sized.filter(F.col("n") > 0)
        .select("doc_id", "n", F.explode(pieces).alias("piece"))
        .select(
            "doc_id",
            "piece",
            (F.col("piece") * largest).alias("start"),
            F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).cast("long").alias("length"),
        )
    )


def pack(
    docs: DataFrame,
    capacities: Sequence[int] = CAPACITIES,
    length: Column | None = None,
    cost=default_cost,
) -> DataFrame:
    """Pack all documents; one row per piece of a document.

    Returns ``doc_id, piece, start, length, bin_id, offset, capacity, used``: words
    ``start .. start+length-1`` of the document lie at ``offset`` in sequence ``bin_id``, which has
    ``capacity`` places of which ``used`` are filled. Documents longer than the largest capacity are cut into
    pieces of that size and a rest.

    Only the counts by length reach the driver, at most one for each length up to the
    largest capacity. Pieces are numbered within their length by ranges
    (:func:`tapecheck.operators.blocks.numbered`), so that a length shared by a third of all rows, with ids or without, is
    no single task, and find their bin by joining the plan, whose size is bounded as the counts are.

    Texts without words (NULL, empty) need no place and get no row. Repeated rows are packed
    as often as they occur; pieces of equal length are numbered by id, those that repeat it in the
    order they are read; a NULL ``doc_id`` is packed like others. An empty table gives an empty result.
    ``length`` replaces the word count by a column of the caller.
    """
    spark = docs.sparkSession
    pieces = materialize(cut(docs, max(capacities), length))
    histogram = {
        r["length"]: r["rows"]
        for r in pieces.groupBy("length").agg(F.count("*").alias("rows")).collect()
    }
    plan = plan_bins(histogram, capacities, cost)
    # The last column tells rows apart that have no id, so that they too spread over ranges.
    tied = pieces.withColumn("tie", F.monotonically_increasing_id())
    ranked = numbered(tied, ["length"], ("doc_id", "piece", "start", "tie"), "rank").drop("tie")
    steps = _rows(
        spark,
        assignments(plan),
        "s_length, s_first, s_count, s_bin, s_per_bin, s_offset, used, capacity",
    )
    nth = F.col("rank") - F.col("s_first")
    return ranked.join(
        F.broadcast(steps),
        (F.col("length") == F.col("s_length"))
        & (F.col("rank") >= F.col("s_first"))
        & (F.col("rank") < F.col("s_first") + F.col("s_count")),
    ).select(
        "doc_id",
        "piece",
        "start",
        "length",
        (F.col("s_bin") + F.floor(nth / F.col("s_per_bin"))).cast("long").alias("bin_id"),
        (F.col("s_offset") + F.pmod(nth, F.col("s_per_bin")) * F.col("length")).alias("offset"),
        "capacity",
        "used",
    )
