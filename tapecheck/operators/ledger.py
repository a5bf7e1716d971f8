"""Fills, mark-to-market curves and round trips for many runs at once.

A run is one parameter cell under one cost scenario. Positions are all-in or
all-out, so the state is a single amount: units while long, cash while flat. A
buy multiplies it by ``1 / (open*(1+slippage)*(1+commission))``, a sell by
``open*(1-slippage)*(1-commission)``, and every other bar by one. Amounts are
therefore running products, which need no bar-by-bar loop.
"""

from __future__ import annotations

import math
import numbers
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapecheck.constants import COST_SCENARIOS, INITIAL_CASH, QUANTITY_TOLERANCE
from tapecheck.operators.blocks import BY_POSITION, Layout, Positions, running, with_blocks, with_earlier
from tapecheck.operators.signals import Cell, positions

RUN_KEYS = ("fast", "slow", "scenario")


@dataclass(frozen=True)
class Run:
    """Bit ``index`` of the signal masks, traded at the given proportional costs."""

    index: int
    fast: int
    slow: int
    scenario: str
    commission: float
    slippage: float
    cash: float = INITIAL_CASH

    def __post_init__(self) -> None:
        for name in ("commission", "slippage", "cash"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, numbers.Real):
                raise ValueError(f"{name} must be a real number, got {value!r}")
            if not math.isfinite(value):
                raise ValueError(f"{name} must be finite, got {value}")
        if self.cash <= 0:
            raise ValueError(f"cash must be > 0, got {self.cash}")
        for name in ("commission", "slippage"):
            if not 0 <= getattr(self, name) < 1:
                raise ValueError(f"{name} must satisfy 0 <= {name} < 1")


def runs(
    grid: Sequence[Cell],
    costs: Mapping[str, tuple[float, float]] | None = None,
    cash: float = INITIAL_CASH,
) -> list[Run]:
    """Every cell of ``grid`` under every cost scenario (baseline only by default)."""
    costs = costs or {"baseline": COST_SCENARIOS["baseline"]}
    return [
        Run(i, fast, slow, name, commission, slippage, cash)
        for i, (fast, slow) in enumerate(grid)
        for name, (commission, slippage) in costs.items()
    ]


def book_rows(book: Sequence[Run]) -> Column:
    """The runs as a literal array, to be exploded next to each row."""
    return F.array(
        *[
            F.struct(
                F.lit(n).alias("run"),
                F.lit(r.index).alias("index"),
                F.lit(r.fast).alias("fast"),
                F.lit(r.slow).alias("slow"),
                F.lit(r.scenario).alias("scenario"),
                F.lit(float(r.commission)).alias("commission_rate"),
                F.lit(float(r.slippage)).alias("slippage_rate"),
                F.lit(float(r.cash)).alias("start_cash"),
            )
            for n, r in enumerate(book)
        ]
    )


def _long(mask: str) -> Column:
    return F.getbit(F.col(mask), F.col("index")) == 1


def _with_factor(rows: DataFrame) -> DataFrame:
    """Add ``held`` (before), ``long`` (now), the fill ``price`` and ``factor``."""
    price = F.when(F.col("long"), F.col("open") * (1.0 + F.col("slippage_rate"))).otherwise(
        F.col("open") * (1.0 - F.col("slippage_rate"))
    )
    buy = 1.0 / (F.col("price") * (1.0 + F.col("commission_rate")))
    sell = F.col("price") * (1.0 - F.col("commission_rate"))
    return (
        rows.withColumn("long", _long("tgt"))
        .withColumn("held", _long("ptgt"))
        .withColumn("price", price)
        .withColumn(
            "factor",
            F.when(F.col("long") == F.col("held"), 1.0).when(F.col("long"), buy).otherwise(sell),
        )
    )


def fills(panel: DataFrame, book: Sequence[Run], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars and runs on which the position changes, with the state's ``factor``.

    Bars on which no run trades are dropped before runs are laid out, so the
    work grows with the number of fills and not with bars times runs.
    """
    rows = panel.where("tgt != ptgt").select(
        *keys, "chunk", "blk", "ts", "open", "tgt", "ptgt", F.inline(book_rows(book))
    )
    return _with_factor(rows.where(_long("tgt") != _long("ptgt"))).drop("tgt", "ptgt", "held")


def fill_ledger(
    panel: DataFrame, book: Sequence[Run], keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """One row per executed fill: the position changed, at this bar's open."""
    rows = running(
        fills(panel, book, keys), [*keys, "run"], {"growth": F.col("factor")}, "product"
    )
    after = F.col("growth") * F.col("start_cash")
    buy = F.col("long")
    return (
        rows.withColumn("after", after)
        .withColumn("quantity", F.when(buy, F.col("after")).otherwise(F.col("after") / F.col("factor")))
        .select(
            *keys,
            *RUN_KEYS,
            "chunk",
            "blk",
            "ts",
            F.when(buy, "buy").otherwise("sell").alias("side"),
            "price",
            "quantity",
            (F.col("quantity") * F.col("price") * F.col("commission_rate")).alias("commission"),
            F.when(buy, 0.0).otherwise(F.col("after")).alias("cash_after"),
            F.when(buy, F.col("after")).otherwise(0.0).alias("units_after"),
        )
    )


def _carried(panel: DataFrame, book: Sequence[Run], keys: Sequence[str]) -> DataFrame:
    """Per chunk, the runs with the growth they bring in from earlier chunks."""
    of_run = [*keys, "run"]
    totals = fills(panel, book, keys).groupBy(*of_run, "chunk").agg(F.product("factor").alias("p"))
    chunks = panel.select(*keys, "chunk").distinct()
    laid_out = chunks.select("*", F.inline(book_rows(book)))
    run_columns = [c for c in laid_out.columns if c not in (*keys, "chunk")]
    grown = with_earlier(
        laid_out.join(totals, [*of_run, "chunk"], "left"), of_run, {"carry": ("product", F.col("p"))}
    )
    return (
        grown.groupBy(*keys, "chunk")
        .agg(F.collect_list(F.struct(*run_columns, "carry")).alias("book"))
    )


def equity_curve(
    panel: DataFrame, book: Sequence[Run], keys: Sequence[str] = ("symbol",), tasks: int | None = None
) -> DataFrame:
    """Cash, units, position value and equity at every close, per run.

    ``prev_equity`` is the equity at the previous close, NULL on the first bar.
    The carried growth is joined by chunk before runs are laid out: what may be
    exchanged is the narrow panel, never the curve with its row per bar and run. ``tasks`` is the number of
    parts the panel is exchanged into, by default that of Spark's shuffle partitions.
    """
    keys = list(keys)
    dealt = panel.repartition(tasks, *keys, "chunk") if tasks else panel
    rows = dealt.join(_carried(panel, book, keys), [*keys, "chunk"]).select(
        *keys, "chunk", "blk", "ts", "open", "close", "prev_close", "tgt", "ptgt", F.inline("book")
    )
    inside = (
        Window.partitionBy(*keys, "chunk", "run")
        .orderBy("blk", "ts")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    amount, before = F.col("amount"), F.col("amount") / F.col("factor")
    return (
        _with_factor(rows)
        .withColumn("amount", F.product("factor").over(inside) * F.col("carry") * F.col("start_cash"))
        .withColumn("cash", F.when(F.col("long"), 0.0).otherwise(amount))
        .withColumn("units", F.when(F.col("long"), amount).otherwise(0.0))
        .withColumn("position_value", F.col("units") * F.col("close"))
        .withColumn("equity", F.col("cash") + F.col("position_value"))
        .withColumn(
            "prev_equity",
            F.when(
                F.col("prev_close").isNotNull(),
                F.when(F.col("held"), before * F.col("prev_close")).otherwise(before),
            ),
        )
        .select(
            *keys, *RUN_KEYS, "chunk", "blk", "ts",
            "cash", "units", "position_value", "equity", "prev_equity",
        )
    )


def run_signal(
    bars: DataFrame,
    commission: float = 0.0,
    slippage: float = 0.0,
    cash: float = INITIAL_CASH,
    keys: Sequence[str] = ("symbol",),
    signal: str = "signal",
    layout: Layout | Positions = BY_POSITION,
) -> tuple[DataFrame, DataFrame]:
    """Ledger and curve of an explicit 0/1 signal column."""
    panel = positions(bars, keys, signal, layout)
    book = [Run(0, 0, 0, "given", commission, slippage, cash)]
    return fill_ledger(panel, book, keys), equity_curve(panel, book, keys)


def _ordered(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number each trade by the buys so far, and the buys still open before it."""
    buy, sell = F.col("side") == "buy", F.col("side") == "sell"
    counts = {"buys": buy.cast("bigint"), "sells": sell.cast("bigint")}
    rows = running(trades, keys, counts, "sum")
    return rows.withColumn("trip", F.col("buys")).withColumn(
        "open_before", F.col("buys") - F.col("sells") - F.when(buy, 1).when(sell, -1).otherwise(0)
    )


def paired_trades(trades: DataFrame, keys: Sequence[str] = ("symbol", *RUN_KEYS)) -> DataFrame:
    """One row per buy with the sell that follows it; no sell if still open.

    Pairs meet through their trip number, so they are spread over the cluster
    by ``(keys, trip)`` whatever the size of one series.
    """
    keys = list(keys)
    fields = F.struct("ts", "price", "quantity", "commission")
    return (
        _ordered(trades, keys)
        .groupBy(*keys, "trip")
        .agg(
            F.max(F.when(F.col("side") == "buy", fields)).alias("b"),
            F.max(F.when(F.col("side") == "sell", fields)).alias("s"),
        )
        .select(
            *keys,
            "trip",
            F.col("b.ts").alias("entry_ts"),
            F.col("s.ts").alias("exit_ts"),
            F.col("b.price").alias("entry_price"),
            F.col("s.price").alias("exit_price"),
            F.col("b.quantity").alias("quantity"),
            F.col("b.commission").alias("entry_commission"),
            F.col("s.commission").alias("exit_commission"),
            (
                (F.col("s.price") - F.col("b.price")) * F.col("b.quantity")
                - F.col("b.commission")
                - F.col("s.commission")
            ).alias("realized_pnl"),
        )
    )


def round_trips(trades: DataFrame, keys: Sequence[str] = ("symbol", *RUN_KEYS)) -> DataFrame:
    """Closed trips only."""
    return paired_trades(trades, keys).where("exit_ts is not null")


def open_positions(trades: DataFrame, keys: Sequence[str] = ("symbol", *RUN_KEYS)) -> DataFrame:
    """The trailing buy of every series that ends invested."""
    return paired_trades(trades, keys).where("exit_ts is null").drop(
        "exit_ts", "exit_price", "exit_commission", "realized_pnl"
    )


def trade_violations(
    trades: DataFrame, keys: Sequence[str] = ("symbol", *RUN_KEYS)
) -> DataFrame:
    """Trades that cannot be paired: bad side, two buys, orphan sell, quantity gap.

    Sells before any buy share trip 0, which may be large; quantities therefore meet in a
    join, which Spark may split, and not in a window.
    """
    keys = list(keys)
    known = F.col("side").isin("buy", "sell")
    gap = F.abs(F.col("quantity") - F.col("bought")) > QUANTITY_TOLERANCE
    reason = (
        F.when(~known, "unknown_side")
        .when((F.col("side") == "buy") & (F.col("open_before") > 0), "consecutive_buys")
        .when((F.col("side") == "sell") & (F.col("open_before") < 1), "orphan_sell")
        .when((F.col("side") == "sell") & gap, "quantity_mismatch")
    )
    ordered = _ordered(trades, keys)
    bought = ordered.where("side = 'buy'").groupBy(*keys, "trip").agg(F.max("quantity").alias("bought"))
    return (
        ordered.join(bought, [*keys, "trip"], "left")
        .withColumn("reason", reason)
        .where("reason is not null")
        .select(*keys, "ts", "side", "reason")
    )


def with_chunks(
    trades: DataFrame, layout: Layout | Positions = BY_POSITION, keys: Sequence[str] = ("symbol", *RUN_KEYS)
) -> DataFrame:
    """Prepare a ledger read from storage for the pairing functions."""
    return with_blocks(trades, layout, keys)


def buy_and_hold(
    bars: DataFrame,
    start,
    end,
    cash: float = INITIAL_CASH,
    commission: float = COST_SCENARIOS["baseline"][0],
    slippage: float = COST_SCENARIOS["baseline"][1],
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Price-only benchmark: first open at or after ``start``, last close before ``end``.

    The purchase uses the sizing of a fill; nothing is sold at the end, so no
    exit cost applies. ``status`` says why a symbol has no benchmark.
    """
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    entry, last = F.col("ts") >= lo, F.col("ts") < hi
    picked = bars.groupBy(*keys).agg(
        F.min(F.when(entry, F.col("ts"))).alias("entry_ts"),
        F.min_by("open", F.when(entry, F.col("ts"))).alias("entry_open"),
        F.max(F.when(last, F.col("ts"))).alias("final_ts"),
        F.max_by("close", F.when(last, F.col("ts"))).alias("final_close"),
    )
    status = (
        F.when(F.col("entry_ts").isNull(), "no_rows_from_start")
        .when(F.col("final_ts").isNull(), "no_rows_before_end")
        .when(F.col("final_ts") < F.col("entry_ts"), "end_precedes_start")
        .otherwise("ok")
    )
    ok = F.col("status") == "ok"
    return (
        picked.withColumn("status", status)
        .withColumn("entry_price", F.when(ok, F.col("entry_open") * F.lit(1.0 + slippage)))
        .withColumn("quantity", F.lit(cash) / (F.col("entry_price") * F.lit(1.0 + commission)))
        .withColumn("entry_commission", F.col("quantity") * F.col("entry_price") * F.lit(commission))
        .withColumn("final_value", F.col("quantity") * F.col("final_close"))
        .withColumn("total_return", F.col("final_value") / F.lit(cash) - 1)
    )
