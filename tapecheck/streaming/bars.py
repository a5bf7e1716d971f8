"""Daily bars from ticks, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapecheck.constants import DAY_SECONDS
from tapecheck.operators.blocks import Layout, epoch_seconds, with_blocks


def ohlcv() -> list[Column]:
    return [
        F.min_by("px", "seq").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "seq").alias("close"),
        F.sum("qty").alias("volume"),
    ]


def bars_from_ticks(ticks: DataFrame) -> DataFrame:
    """Daily OHLCV bars from ``symbol, ts, px, qty, seq``.

    ``seq`` is any orderable value that is unique within a symbol and day;
    it decides which tick opens and which closes the bar. Every aggregate has a
    partial form, so ticks are reduced before anything is shuffled and a symbol
    that holds most of the ticks costs no more than any other.
    """
    day = F.col("ts").cast("date").cast("timestamp_ntz").alias("ts")
    return ticks.groupBy("symbol", day).agg(*ohlcv())


def clustered_bars(ticks: DataFrame, layout: Layout, tasks: int | None = None) -> DataFrame:
    """The same bars with the ``chunk`` of ``layout``, lying as panels read them (``Stored(layout.block_bars)``).

    For many symbols with few ticks a day, which a reduction before the shuffle would only sort once more: ticks are
    exchanged by symbol and chunk, and the sort that makes the bars is also the order that windows over them need, so
    ticks are exchanged and sorted once until the panel stands. A chunk's ticks are in one task, which spills what it can't hold.
    ``tasks`` is their number, by default that of Spark's shuffle partitions.
    """
    placed = with_blocks(ticks, layout)
    placed = placed.repartition(tasks, "symbol", "chunk") if tasks else placed.repartition("symbol", "chunk")
    day = F.col("ts").cast("date").cast("timestamp_ntz").alias("ts")
    return placed.groupBy("symbol", "chunk", day).agg(*ohlcv())


def closed_bars_stream(ticks: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """Streaming form: a bar comes out once its day is over.

    In append mode a day is emitted when the watermark (newest tick time minus
    ``lateness``) has passed its end, and it is never revised afterwards. The
    watermark needs an instant; it is taken from the zone-free time as if in
    UTC, and turned back the same way, so the session's zone plays no part.
    """
    day = F.date_from_unix_date((F.unix_seconds("bucket.start") / DAY_SECONDS).cast("int"))
    return (
        ticks.withColumn("instant", F.timestamp_seconds(epoch_seconds(F.col("ts"))))
        .withWatermark("instant", lateness)
        .groupBy("symbol", F.window("instant", "1 day").alias("bucket"))
        .agg(*ohlcv())
        .select("symbol", day.cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")
    )
