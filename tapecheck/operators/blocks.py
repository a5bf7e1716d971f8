"""How a long series is cut into bounded pieces that Spark can spread out.

A series (one symbol) may hold a large share of all bars, so no operator may
order a whole series inside one task. Rows are cut by *time* instead, or by their
place in the series where the spacing is not known: a
``chunk`` holds a bounded number of bar slots and is the unit of shuffling, and
a ``blk`` is a smaller slice of a chunk used where numerics need short runs.
Running quantities are computed inside chunks and completed with a carry that
is a prefix over the (few) chunk summaries of each series.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapecheck.constants import DAY_SECONDS


@dataclass(frozen=True)
class Layout:
    """Bar spacing and the number of bar slots per block and per chunk.

    The default chunk has 4096 slots, which window operators buffer in memory.
    """

    bar_seconds: int = DAY_SECONDS
    block_bars: int = 256
    chunk_blocks: int = 16

    @property
    def block_seconds(self) -> int:
        return self.bar_seconds * self.block_bars


DAILY = Layout()


@dataclass(frozen=True)
class Positions:
    """Chunks by place in the series: at most ``chunk_rows`` rows each, at any density.

    Costs one exchange by range and a checkpoint more than a :class:`Layout`, which suits bars of known spacing.
    """

    chunk_rows: int = 4096
    block_bars: int = 256


BY_POSITION = Positions()


@dataclass(frozen=True)
class Stored:
    """Bars that carry their ``chunk`` and lie clustered by key and chunk (:func:`tapecheck.sources.bars.write_clustered`)."""

    block_bars: int = 256


STORED = Stored()


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ("ts",), name: str = "idx") -> DataFrame:
    """Add each row's place in its series, from 0; rows with a NULL key are left out.

    No series is ordered in one task: rows are partitioned by range of ``keys`` and ``order``, numbered inside their
    partition, and the rows of a series in earlier partitions are counted (one count per series and partition).
    """
    keys = list(keys)
    rows = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    # Ranges come from a sample, so a partition is written before its numbers are used.
    ranged = materialize(
        rows.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("__at", F.monotonically_increasing_id())
    ).withColumn("__part", F.shiftright("__at", 33))
    parts = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    place = F.col("__before") + F.col("__at") - F.col("__first")
    return ranged.join(starts, [*keys, "__part"]).withColumn(name, place).drop("__at", "__part", "__first", "__before")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-free timestamp; no zone conversion."""
    return (
        F.unix_date(ts.cast("date")).cast("long") * DAY_SECONDS
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    )


def with_blocks(bars: DataFrame, layout: Layout | Positions | Stored = DAILY, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add ``chunk`` and ``blk``; both are monotone in ``ts``."""
    if isinstance(layout, Stored):
        return bars.where("ts is not null").withColumn("blk", F.lit(0).cast("bigint"))
    if isinstance(layout, Positions):
        placed = numbered(bars.where("ts is not null"), keys, name="__idx")
        chunk, blk = (F.floor(F.col("__idx") / F.lit(n)) for n in (layout.chunk_rows, layout.block_bars))
        return placed.withColumns({"blk": blk, "chunk": chunk}).drop("__idx")
    blk = F.floor(epoch_seconds(F.col("ts")) / F.lit(layout.block_seconds))
    return bars.withColumn("blk", blk).withColumn(
        "chunk", F.floor(F.col("blk") / F.lit(layout.chunk_blocks))
    )


def chunk_window(keys: Sequence[str]):
    """Rows of one chunk in time order (same sort as :func:`block_window`)."""
    return Window.partitionBy(*keys, "chunk").orderBy("blk", "ts")


def block_window(keys: Sequence[str]):
    return Window.partitionBy(*keys, "chunk", "blk").orderBy("ts")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediates that ``spark.checkpoint.dir`` names.

    Only a local session (tests) may do without; it gets one beside the warehouse, which is
    removed when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        folder = f"{warehouse}/intermediate-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(folder)
        _remove_at_exit(spark, folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared one, for a table that is written and read back.

    Removed when the process ends, since a result that reads it may be consumed until then.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    _remove_at_exit(spark, folder)
    return folder


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def remove() -> None:
        with contextlib.suppress(Exception):  # the JVM may have ended before
            files.delete(path, True)

    atexit.register(remove)


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches read, and cut its lineage.

    A reliable checkpoint: a lost executor costs a re-read and not a recomputation.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


# Chunks per span: summaries of a series are combined span by span, and only the
# spans of a series (one per half a million bars) meet in one place.
SPAN_CHUNKS = 128


def span() -> Column:
    return F.floor(F.col("chunk") / F.lit(SPAN_CHUNKS))


_RUNNING = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "product": (F.product, lambda a, b: F.coalesce(a, F.lit(1.0)) * F.coalesce(b, F.lit(1.0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def with_earlier(
    totals: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, Column]]
) -> DataFrame:
    """Add, per chunk summary, the total of all earlier chunks of its series.

    ``wanted`` maps names to ``(sum | product | max, value)``. Without earlier
    chunks a sum is 0, a product is 1 and a maximum is NULL.
    """
    keys = list(keys)
    rows = totals.withColumns({"__span": span(), **{f"__{n}": v for n, (_, v) in wanted.items()}})

    def earlier(parts: Sequence[str], order: str):
        return Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    fn = {n: _RUNNING[how][0] for n, (how, _) in wanted.items()}
    in_span = rows.withColumns(
        {f"__in_{n}": f(F.col(f"__{n}")).over(earlier([*keys, "__span"], "chunk")) for n, f in fn.items()}
    )
    spans = (
        rows.groupBy(*keys, "__span")
        .agg(*[f(F.col(f"__{n}")).alias(f"__{n}") for n, f in fn.items()])
        .select(
            *keys,
            "__span",
            *[f(F.col(f"__{n}")).over(earlier(keys, "__span")).alias(f"__out_{n}") for n, f in fn.items()],
        )
    )
    merged = {
        n: _RUNNING[how][1](F.col(f"__in_{n}"), F.col(f"__out_{n}")) for n, (how, _) in wanted.items()
    }
    scratch = ["__span", *[f"__{k}{n}" for n in wanted for k in ("", "in_", "out_")]]
    return in_span.join(spans, [*keys, "__span"]).withColumns(merged).drop(*scratch)


def running(
    rows: DataFrame,
    keys: Sequence[str],
    values: dict[str, Column],
    how: str,
    order: Sequence[str | Column] = ("blk", "ts"),
) -> DataFrame:
    """Add the inclusive running sum, product or maximum over whole series.

    ``rows`` must carry ``chunk``, which is monotone in ``order``. Chunks are
    scanned in parallel; only their totals are combined per series.
    """
    keys = list(keys)
    total, merge = _RUNNING[how]
    inside = (
        Window.partitionBy(*keys, "chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    totals = rows.groupBy(*keys, "chunk").agg(*[total(v).alias(f"t_{n}") for n, v in values.items()])
    carries = with_earlier(totals, keys, {f"c_{n}": (how, F.col(f"t_{n}")) for n in values})
    carries = carries.select(*keys, "chunk", *[f"c_{n}" for n in values])
    scanned = rows.withColumns({n: total(v).over(inside) for n, v in values.items()})
    joined = scanned.join(carries, [*keys, "chunk"])
    return joined.withColumns({n: merge(F.col(n), F.col(f"c_{n}")) for n in values}).drop(
        *[f"c_{n}" for n in values]
    )
