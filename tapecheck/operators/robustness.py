"""Parameter-neighbourhood, cost and concentration diagnostics.

Nothing here selects or ranks a cell; results keep the configured order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapecheck.constants import BASELINE_CELL, INITIAL_CASH, ISOLATED_CELL_MULTIPLIER
from tapecheck.functions.numbers import sign_positive
from tapecheck.operators.ledger import RUN_KEYS, Run, book_rows, fills
from tapecheck.operators.signals import Cell
from tapecheck.operators.timeline import Period, as_of_boundaries, boundaries, segment, stamp


def boundary_equity(
    panel: DataFrame,
    book: Sequence[Run],
    bounds: Sequence[str],
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Equity of every run just before each boundary, without building curves.

    NULL where a series has no earlier bar.

    Only two reductions of the panel are needed: the last close and position
    bits before a boundary, and the product of fill factors before it. Both
    combine map-side to one row per key, run and segment.
    """
    keys, bounds = list(keys), sorted(bounds)
    latest = as_of_boundaries(panel, bounds, keys, ["close", "tgt"])
    growth = (
        fills(panel.where(F.col("ts") < stamp(bounds[-1])), book, keys)
        .groupBy(*keys, "run", segment(bounds).alias("seg"))
        .agg(F.product("factor").alias("p"))
        .withColumn("b", F.explode(F.sequence(F.col("seg"), F.lit(len(bounds) - 1))))
        .groupBy(*keys, "run", "b")
        .agg(F.product("p").alias("growth"))
    )
    price = F.when(F.getbit(F.col("tgt"), F.col("index")) == 1, F.col("close")).otherwise(1.0)
    equity = F.when(F.col("ts").isNotNull(), F.col("start_cash") * F.coalesce("growth", F.lit(1.0)) * price)
    return (
        latest.select("*", F.inline(book_rows(book)))
        .join(growth, [*keys, "run", "b"], "left")
        .select(*keys, *RUN_KEYS, "boundary", equity.alias("equity"))
    )


def window_returns(
    at_bounds: DataFrame, windows: Sequence[Period], keys: Sequence[str]
) -> DataFrame:
    """``equity before end / equity before start - 1`` per window, no reset.

    A window whose start or end has no earlier equity is kept, with NULL and a ``status``.
    """
    roles = F.array(
        *[
            F.struct(F.lit(w.name).alias("window"), stamp(at).alias("at"), F.lit(role).alias("role"))
            for w in windows
            for role, at in (("start", w.start), ("end", w.end))
        ]
    )
    rows = at_bounds.select(*keys, "boundary", "equity", F.inline(roles)).where("boundary = at")
    pick = lambda role: F.max(F.when(F.col("role") == role, F.col("equity")))
    return rows.groupBy(*keys, "window").agg(
        pick("start").alias("start_equity"), pick("end").alias("end_equity")
    ).withColumns(
        {
            "window_return": F.col("end_equity") / F.col("start_equity") - 1,
            "status": F.when(F.col("start_equity").isNull(), "no_equity_before_start").otherwise("ok"),
        }
    )


def grid_returns(
    panel: DataFrame,
    book: Sequence[Run],
    windows: Sequence[Period],
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Window returns of every run and their compounded aggregate.

    Every series has a row for every run and window. A run of which a window has no
    return has no aggregate either, and ``aggregate_status`` says so.
    """
    of_run = [*keys, *RUN_KEYS]
    at_bounds = boundary_equity(panel, book, boundaries(windows), keys)
    rows = window_returns(at_bounds, windows, of_run)
    whole = Window.partitionBy(*of_run)
    complete = F.count("window_return").over(whole) == len(windows)
    compounded = F.product(1 + F.col("window_return")).over(whole) - 1
    return rows.select(
        *of_run,
        "window",
        "window_return",
        "status",
        F.when(complete, compounded).alias("aggregate_return"),
        F.when(complete, "ok").otherwise("missing_window").alias("aggregate_status"),
    )


def cost_stress(
    panel: DataFrame,
    grid: Sequence[Cell],
    grid_result: DataFrame,
    costs: Mapping[str, tuple[float, float]],
    windows: Sequence[Period],
    cell: Cell = BASELINE_CELL,
    baseline: str = "baseline",
    cash: float = INITIAL_CASH,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """One fixed cell under each scenario; the baseline comes from the grid."""
    fast, slow = cell
    index = list(grid).index(cell)
    worse = [
        Run(index, fast, slow, name, c, s, cash) for name, (c, s) in costs.items() if name != baseline
    ]
    known = grid_result.where(
        (F.col("fast") == fast) & (F.col("slow") == slow) & (F.col("scenario") == baseline)
    )
    return known.unionByName(grid_returns(panel, worse, windows, keys)) if worse else known


def leave_one_out(returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compounded return without each window, sign flips and the largest change.

    A series has few windows, so they are gathered per key. Where a window has no return, all
    results are NULL and ``status`` says so.
    """
    product = lambda xs: F.aggregate(xs, F.lit(1.0), lambda a, x: a * (1 + x["window_return"]))
    rows = (
        returns.groupBy(*keys)
        .agg(
            F.array_sort(F.collect_list(F.struct("window", "window_return"))).alias("all"),
            (F.count("*") == F.count("window_return")).alias("complete"),
        )
        .withColumn("complete", F.when(F.col("complete"), F.lit(1.0)))
        .withColumn("full_aggregate", (product(F.col("all")) - 1) * F.col("complete"))
        .withColumn(
            "out",
            F.transform(
                "all",
                lambda w: F.struct(
                    w["window"].alias("window"),
                    ((product(F.filter("all", lambda x: x["window"] != w["window"])) - 1) * F.col("complete")).alias("without"),
                ),
            ),
        )
    )
    change = F.array_max(F.transform("out", lambda o: F.abs(o["without"] - F.col("full_aggregate"))))
    return (
        rows.withColumn("largest_change", change)
        .select(
            *keys,
            "full_aggregate",
            "largest_change",
            F.when(F.col("complete").isNull(), "missing_window").otherwise("ok").alias("status"),
            F.inline("out"),
        )
        .withColumn("sign_flip", sign_positive(F.col("without")) != sign_positive(F.col("full_aggregate")))
    )


def with_positions(results: DataFrame, fast: Sequence[int], slow: Sequence[int]) -> DataFrame:
    """Array positions ``fi``, ``si`` of each cell; adjacency is by position."""
    position = lambda xs, c: F.array_position(F.array(*[F.lit(x) for x in xs]), F.col(c)).cast("int") - 1
    return results.withColumn("fi", position(fast, "fast")).withColumn("si", position(slow, "slow"))


def grid_neighbors(
    results: DataFrame, fast: Sequence[int], slow: Sequence[int], keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Directed pairs of 4-connected cells that are both present."""
    left = with_positions(results, fast, slow)
    step = F.array(
        *[
            F.struct(F.lit(df).alias("df"), F.lit(ds).alias("ds"))
            for df, ds in ((-1, 0), (1, 0), (0, -1), (0, 1))
        ]
    )
    right = left.select(
        *keys,
        F.col("fi").alias("nfi"),
        F.col("si").alias("nsi"),
        F.col("fast").alias("n_fast"),
        F.col("slow").alias("n_slow"),
        F.col("aggregate_return").alias("n_return"),
    )
    wanted = (
        left.select(*keys, "fast", "slow", "fi", "si", "aggregate_return", F.inline(step))
        .withColumn("nfi", F.col("fi") + F.col("df"))
        .withColumn("nsi", F.col("si") + F.col("ds"))
    )
    return wanted.join(right, [*keys, "nfi", "nsi"]).select(
        *keys, "fast", "slow", "fi", "si", "nfi", "nsi", "aggregate_return", "n_fast", "n_slow", "n_return"
    )


def _unordered(neighbors: DataFrame) -> DataFrame:
    return neighbors.where((F.col("nfi") > F.col("fi")) | (F.col("nsi") > F.col("si")))


def _same_sign() -> Column:
    return sign_positive(F.col("aggregate_return")) == sign_positive(F.col("n_return"))


def sign_flip_pairs(neighbors: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Adjacent cells whose aggregate returns differ in sign, each pair once."""
    return _unordered(neighbors).where(~_same_sign()).select(
        *keys, "fast", "slow", "n_fast", "n_slow"
    )


def sign_consistency(
    results: DataFrame, neighbors: DataFrame, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Share of adjacent pairs with equal sign; 1.0 where there are no pairs.

    NULL for a series with a cell that has no aggregate return.
    """
    keys = list(keys)
    pairs = _unordered(neighbors).groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.count_if(_same_sign()).alias("matching")
    )
    return (
        results.groupBy(*keys)
        .agg(F.bool_and(F.col("aggregate_return").isNotNull()).alias("complete"))
        .join(pairs, keys, "left")
        .select(
            *keys,
            F.coalesce("pairs", F.lit(0)).alias("pairs"),
            F.coalesce("matching", F.lit(0)).alias("matching"),
            F.when(F.col("complete"), F.coalesce(F.col("matching") / F.col("pairs"), F.lit(1.0))).alias("sign_consistency"),
        )
    )


def baseline_neighbors(
    neighbors: DataFrame, cell: Cell = BASELINE_CELL, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    return neighbors.where((F.col("fast") == cell[0]) & (F.col("slow") == cell[1])).select(
        *keys, F.col("aggregate_return").alias("baseline_return"), "n_fast", "n_slow", "n_return"
    )


def window_dispersion(returns: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Minimum, median and maximum window return across cells, per window."""
    r = F.col("window_return")
    return returns.groupBy(*keys, "window").agg(
        F.min(r).alias("min_return"), F.median(r).alias("median_return"), F.max(r).alias("max_return")
    )


def isolated_cells(neighbors: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Distance of each cell to its neighbours' mean against the grid's own scale."""
    keys = list(keys)
    gap = F.abs(F.col("aggregate_return") - F.col("n_return"))
    sums = neighbors.groupBy(*keys, "fast", "slow").agg(
        F.first("aggregate_return").alias("aggregate_return"),
        F.avg("n_return").alias("neighbor_mean"),
        F.sum(gap).alias("gap_sum"),
        F.count("*").alias("gaps"),
    )
    whole = Window.partitionBy(*keys)
    threshold = ISOLATED_CELL_MULTIPLIER * F.sum("gap_sum").over(whole) / F.sum("gaps").over(whole)
    return (
        sums.withColumn("threshold", threshold)
        .withColumn("difference", F.abs(F.col("aggregate_return") - F.col("neighbor_mean")))
        .select(
            *keys, "fast", "slow", "neighbor_mean", "difference", "threshold",
            (F.col("difference") > F.col("threshold")).alias("isolated"),
        )
    )
