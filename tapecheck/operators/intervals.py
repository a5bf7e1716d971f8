"""Rows and intervals, rows and boundaries: joins in time against tables of any size.

Splits and windows that are few and fixed are cheapest as literals (:mod:`tapecheck.operators.timeline`). Here they are
tables: per product, overlapping or not, in any number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapecheck.operators.blocks import epoch_seconds, materialize, numbered, with_earlier


def _micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp."""
    column = F.col(ts) if isinstance(ts, str) else ts
    fraction = (F.date_part(F.lit("SECOND"), column) * 1_000_000).cast("bigint") % 1_000_000
    return epoch_seconds(column) * 1_000_000 + fraction


def interval_join(
    rows: DataFrame,
    spans: DataFrame,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    start: str = "start",
    end: str = "end",
    closed: str = "left",
) -> DataFrame:
    """Every row next to every interval of its ``keys`` that holds its time: ``rows.*`` and the rest of ``spans``.

    Intervals are half-open, ``[start, end)``, or ``(start, end]`` with ``closed="right"``; they may overlap, and one
    that ends before it starts holds nothing. Columns of ``spans`` must not be among those of ``rows``, but for ``keys``.

    An interval lies in at most two bins as wide as the power of two above its length, so it is an equi-join on
    ``keys``, length class and bin with the exact test after; a row is looked up once for every length class
    that occurs among the intervals of its keys (at most 64), and not at all if there are none. A long interval does not make a bin of
    short ones larger. Rows or intervals without a key or a time join nothing.

    Spark's size estimates do not see how intervals multiply, so it is told to sort and merge: neither side is ever sent whole
    through the driver, and Spark may split a large bin.
    """
    keys = list(keys)
    shift = 1 if closed == "right" else 0
    lo, hi = _micros(start) + shift, _micros(end) + shift
    width = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1))
    level = F.length(F.conv((width - 1).cast("string"), 10, 2))
    spans = materialize(spans.withColumns({"__lo": lo, "__hi": hi}).where("__lo < __hi").withColumn("__level", level))
    bin_of = lambda at: F.call_function("shiftright", at, F.col("__level"))
    laid = spans.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("__lo")), bin_of(F.col("__hi") - 1))))
    classes = spans.select(*keys, "__level").distinct()
    at = rows.withColumn("__at", _micros(ts)).join(classes, keys).withColumn("__bin", bin_of(F.col("__at")))
    met = at.join(laid.hint("merge"), [*keys, "__level", "__bin"]).where("__at >= __lo and __at < __hi")
    return met.drop("__at", "__lo", "__hi", "__level", "__bin")


def rows_in_windows(rows: DataFrame, windows: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Rows next to each window ``keys, window, start, end`` that holds them; a row may lie in several."""
    return interval_join(rows, windows, keys, ts).drop("start", "end")


def rows_in_splits(rows: DataFrame, splits: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Rows with the ``split`` of ``keys, name, start, end_exclusive`` they fall in; rows outside all are dropped."""
    spans = splits.select(*keys, F.col("name").alias("split"), "start", F.col("end_exclusive").alias("end"))
    return interval_join(rows, spans, keys, ts).drop("start", "end")


def allowed_rows(
    rows: DataFrame, splits: DataFrame, allowed: Sequence[str], keys: Sequence[str] = ("symbol",), ts: str = "ts"
) -> DataFrame:
    """Rows of the allowed splits of their own product, columns unchanged."""
    return rows_in_splits(rows, splits.where(F.col("name").isin(*allowed)), keys, ts).select(*rows.columns)


def crossing_trips(trips: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trips next to each window ``keys, window, start, end`` one of whose bounds they hold: entry < bound <= exit.

    The distinct bounds are looked up in the trips, however many windows share them, so trips that cross nothing are never
    laid next to windows. A trip that holds both bounds of a window comes once.
    """
    keys = list(keys)
    bounds = windows.select(*keys, F.explode(F.array("start", "end")).alias("__bound")).distinct()
    met = interval_join(bounds, trips, keys, "__bound", "entry_ts", "exit_ts", closed="right")
    met = materialize(met.dropDuplicates([*keys, "__bound", "entry_ts", "exit_ts"]))
    laid = windows.select(*keys, "window", "start", "end").distinct()
    at = lambda c: laid.withColumn("__bound", F.col(c)).join(met.hint("merge"), [*keys, "__bound"]).drop("__bound")
    # What holds the start is given there, so the end only adds trips that do not.
    ends = at("end").where(~((F.col("entry_ts") < F.col("start")) & (F.col("start") <= F.col("exit_ts"))) | F.col("start").isNull())
    return at("start").unionByName(ends)


def as_of(
    points: DataFrame,
    rows: DataFrame,
    values: Sequence[str],
    keys: Sequence[str] = ("symbol",),
    at: str = "ts",
    strict: bool = True,
    chunk_rows: int = 4096,
    status: str = "status",
) -> DataFrame:
    """``points`` with the time ``as_of_ts``, the ``values`` and a ``status`` of the last row before each (or at it, if not ``strict``).

    A merge: both tables are put in one order by time, cut into chunks of ``chunk_rows`` by place
    (:func:`tapecheck.operators.blocks.numbered`), and the last row is carried forward inside a chunk and from chunk to
    chunk. So neither table has to be small, and a series or a run of points of any density spreads out. Points are
    kept all, also repeated ones; without an earlier row, or without a key or time, the values are NULL and the status
    is ``no_earlier_row``. Of rows at one time the greatest ``values`` count. ``points`` must not have columns called
    like ``values``.
    """
    keys = list(keys)
    extra = [c for c in points.columns if c not in keys]
    found = F.struct(F.col("ts").alias("as_of_ts"), *values)
    seen = rows.where("ts is not null").select(
        *keys, F.col("ts").alias("__ts"), F.lit(0 if not strict else 1).alias("__side"), found.alias("__row"),
    )
    asked = points.select(
        *keys, F.col(at).alias("__ts"), F.lit(1 if not strict else 0).alias("__side"), F.struct(*extra).alias("__point")
    )
    placed_keys = " and ".join([*(f"`{k}` is not null" for k in keys), "__ts is not null"])
    lost = asked.where(f"not ({placed_keys})").withColumn("__last", F.lit(None).cast(seen.schema["__row"].dataType))
    both = seen.unionByName(asked.where(placed_keys), allowMissingColumns=True)
    merged = numbered(both, keys, ("__ts", "__side", "__row"), "__idx")
    merged = merged.withColumn("chunk", F.floor(F.col("__idx") / F.lit(chunk_rows)))
    inside = Window.partitionBy(*keys, "chunk").orderBy("__idx").rowsBetween(Window.unboundedPreceding, 0)
    newest = F.last("__row", ignorenulls=True)
    ends = merged.groupBy(*keys, "chunk").agg(F.max("__row").alias("__newest"))  # rows ascend within a chunk
    carried = with_earlier(ends, keys, {"__carry": ("max", F.col("__newest"))}).select(*keys, "chunk", "__carry")
    answered = (
        merged.withColumn("__near", newest.over(inside))
        .where("__point is not null")
        .join(carried, [*keys, "chunk"])
        .withColumn("__last", F.coalesce("__near", "__carry"))
    )
    out = answered.select(*keys, "__point", "__last").unionByName(lost.select(*keys, "__point", "__last"))
    judged = F.when(F.col("__last").isNull(), "no_earlier_row").otherwise("ok").alias(status)
    return out.select(*keys, "__point.*", "__last.*", judged)


def labels(rows: DataFrame, splits: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """All rows with their ``split``, NULL outside; the splits of a product must not overlap."""
    starts = splits.select(*keys, F.col("start").alias("ts"), F.col("end_exclusive").alias("__end"), F.col("name").alias("__name"))
    near = as_of(rows, starts, ["__end", "__name"], keys, ts, strict=False, status="__status")
    inside = F.when(F.col(ts) < F.col("__end"), F.col("__name"))
    return near.withColumn("split", inside).select(*rows.columns, "split")
