"""Crossover signals and the position they ask for on the next bar.

Signals of all parameter cells travel together as the bits of one integer
(``sig``): cell ``i`` of :func:`cells` is bit ``i``. A row also carries the bits
of the bar before (``tgt``, the position to hold now, decided at the previous
close) and of the bar before that (``ptgt``). A fill happens where they differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapecheck.constants import FAST_PERIODS, MAX_CELLS, SLOW_PERIODS
from tapecheck.operators.blocks import BY_POSITION, Layout, Positions, Stored, chunk_window, with_blocks, with_earlier
from tapecheck.operators.indicators import check_period, ema_column, ema_panel

Cell = tuple[int, int]


def cells(
    fast: Sequence[int] = FAST_PERIODS,
    slow: Sequence[int] = SLOW_PERIODS,
    limit: int = MAX_CELLS,
) -> list[Cell]:
    """Valid (fast, slow) pairs in configured order, never more than the cap."""
    if limit > MAX_CELLS:
        raise ValueError(f"limit {limit} exceeds the structural cap {MAX_CELLS}")
    pairs = [(f, s) for f in fast for s in slow if f < s]
    if len(pairs) > limit:
        raise ValueError(f"{len(pairs)} valid cells exceed the limit {limit}")
    return pairs


def check_cell(fast: int, slow: int) -> Cell:
    check_period(fast)
    check_period(slow)
    if fast >= slow:
        raise ValueError(f"fast period {fast} must be less than slow period {slow}")
    return fast, slow


def bit(mask: str | Column, i: int) -> Column:
    column = F.col(mask) if isinstance(mask, str) else mask
    return F.getbit(column, F.lit(i)) == 1


def _periods(grid: Sequence[Cell]) -> list[int]:
    return sorted({p for cell in grid for p in cell})


def _mask(grid: Sequence[Cell], price: str, gap: str, idx: str) -> str:
    """Bits of the cells that are long at one bar, in SQL."""
    periods = _periods(grid)
    bits = [
        f"if({idx} >= {slow - 1} and {price} - {gap}[{periods.index(fast)}] > "
        f"{price} - {gap}[{periods.index(slow)}], {1 << i}L, 0L)"
        for i, (fast, slow) in enumerate(grid)
    ]
    return " | ".join(bits)


def signal_panel(
    bars: DataFrame,
    grid: Sequence[Cell],
    keys: Sequence[str] = ("symbol",),
    layout: Layout | Positions | Stored = BY_POSITION,
) -> DataFrame:
    """Signals of every cell of ``grid`` on every bar, from one pass over bars.

    Each distinct period is averaged once, however many cells use it. Columns:
    ``keys, chunk, blk, ts, open, close, prev_close, idx, sig, tgt, ptgt``. Rows without a
    key or a time are left out; ``quality.ohlcv_violations`` lists them. The cap on cells is a
    rule of the study, not of the implementation.
    """
    for fast, slow in grid:
        check_cell(fast, slow)
    if len(grid) > MAX_CELLS:
        raise ValueError(f"{len(grid)} cells exceed the cap {MAX_CELLS}")
    keys = list(keys)
    before = {
        "one_back": _mask(grid, "entry.x1", "entry.d1", "entry.off - 1"),
        "two_back": _mask(grid, "entry.x2", "entry.d2", "entry.off - 2"),
    }
    stored = ["chunk"] if isinstance(layout, Stored) else []
    rows = ema_panel(bars.select(*keys, *stored, "ts", "open", "close"), _periods(grid), keys, layout, before)
    series = chunk_window(keys)
    rows = rows.withColumn("sig", F.expr(_mask(grid, "close", "gap", "idx"))).withColumns(
        {
            "tgt": F.coalesce(F.lag("sig", 1).over(series), "one_back"),
            "ptgt": F.coalesce(
                F.lag("sig", 2).over(series), F.expr("if(r = 1, two_back, one_back)")
            ),
        }
    )
    return rows.select(
        *keys, "chunk", "blk", "ts", "open", "close", "prev_close", "idx", "sig", "tgt", "ptgt"
    )


def crossover_signal(
    bars: DataFrame,
    fast: int,
    slow: int,
    keys: Sequence[str] = ("symbol",),
    layout: Layout | Positions | Stored = BY_POSITION,
) -> DataFrame:
    """``fast_ema``, ``slow_ema`` (NULL in warm-up) and ``signal`` 0/1."""
    check_cell(fast, slow)
    periods = [fast, slow]
    rows = ema_panel(bars, periods, keys, layout)
    f, s = ema_column(periods, fast), ema_column(periods, slow)
    return rows.select(*keys, "ts", f.alias("fast_ema"), s.alias("slow_ema")).withColumn(
        "signal", F.when(F.col("fast_ema") > F.col("slow_ema"), 1).otherwise(0)
    )


def positions(
    bars: DataFrame,
    keys: Sequence[str] = ("symbol",),
    signal: str = "signal",
    layout: Layout | Positions = BY_POSITION,
) -> DataFrame:
    """The same panel for a given 0/1 ``signal`` column (a one-cell grid)."""
    keys = list(keys)
    series = chunk_window(keys)
    valid = F.when(F.col(signal).isin(0, 1), F.col(signal).cast("bigint")).otherwise(
        F.raise_error(F.lit("signal must contain only 0 (flat) or 1 (long)")).cast("bigint")
    )
    rows = (
        with_blocks(bars.select(*keys, "ts", "open", "close", valid.alias("sig")), layout, keys)
        .repartition(*keys, "chunk")
        .withColumn("r", F.row_number().over(series))
        .withColumn("lag1", F.lag("sig", 1).over(series))
        .withColumn("lag2", F.lag("sig", 2).over(series))
        .withColumn("lag_close", F.lag("close").over(series))
        .withColumn("last_in_chunk", F.lead("ts").over(series).isNull())
    )
    # Two newest signals at the end of each chunk; a chunk of one bar takes its
    # second value from the chunk before.
    ends = rows.where("last_in_chunk").select(
        *keys, "chunk", F.col("r").alias("n"), "sig", "lag1", "close"
    )
    ends = with_earlier(
        ends,
        keys,
        {"before": ("max", F.struct("chunk", "sig", "close")), "off": ("sum", F.col("n").cast("bigint"))},
    ).withColumn("second", F.coalesce("lag1", "before.sig", F.lit(0).cast("bigint")))
    ends = with_earlier(ends, keys, {"before2": ("max", F.struct("chunk", "second"))}).select(
        *keys,
        "chunk",
        "off",
        F.coalesce("before.sig", F.lit(0).cast("bigint")).alias("one_back"),
        F.coalesce("before2.second", F.lit(0).cast("bigint")).alias("two_back"),
        F.col("before.close").alias("close_back"),
    )
    first = F.col("r") == 1
    return (
        rows.join(ends, [*keys, "chunk"])
        .withColumn("idx", F.col("off") + F.col("r") - 1)
        .withColumn("tgt", F.coalesce("lag1", "one_back"))
        .withColumn("ptgt", F.coalesce("lag2", F.when(first, F.col("two_back")).otherwise(F.col("one_back"))))
        .withColumn("prev_close", F.coalesce("lag_close", "close_back"))
        .select(
            *keys, "chunk", "blk", "ts", "open", "close", "prev_close", "idx", "sig", "tgt", "ptgt"
        )
    )


def per_cell(panel: DataFrame, grid: Sequence[Cell], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per bar and cell: ``signal``, ``target`` and ``prev_target``."""
    cell = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(fast).alias("fast"),
                    F.lit(slow).alias("slow"),
                    bit("sig", i).cast("int").alias("signal"),
                    bit("tgt", i).cast("int").alias("target"),
                    bit("ptgt", i).cast("int").alias("prev_target"),
                )
                for i, (fast, slow) in enumerate(grid)
            ]
        )
    )
    return panel.select(*keys, "ts", cell.alias("c")).select(*keys, "ts", "c.*")


def entry_exit_events(panel: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Entry/exit flags of a one-cell panel.

    ``entry``/``exit`` sit on the bar whose close changed the signal (the state
    before the series counts as flat); ``fill_entry``/``fill_exit`` are the same
    events moved to the bar that can act on them.
    """
    now, before, older = bit("sig", 0), bit("tgt", 0), bit("ptgt", 0)
    return panel.select(
        *keys,
        "ts",
        (now & ~before).alias("entry"),
        (~now & before).alias("exit"),
        (before & ~older).alias("fill_entry"),
        (~before & older).alias("fill_exit"),
    )


def signal_transitions(panel: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Number of signal changes; the first bar has nothing to change from."""
    changed = (F.col("idx") > 0) & (bit("sig", 0) != bit("tgt", 0))
    return panel.groupBy(*keys).agg(F.count_if(changed).alias("transitions"))
