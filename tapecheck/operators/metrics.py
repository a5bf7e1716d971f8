"""Per-window, whole-curve and trade-quality metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapecheck.constants import (
    MIN_RETURNS_FOR_SHARPE,
    MIN_RETURNS_FOR_VOLATILITY,
    MIN_TRIPS,
    PERIODS_PER_YEAR,
)
from tapecheck.functions.gates import INSUFFICIENT, gated
from tapecheck.operators.blocks import epoch_seconds, running, span
from tapecheck.operators.ledger import RUN_KEYS
from tapecheck.operators.timeline import Period, stamp, window_array, window_name, within

CURVE_KEYS = ("symbol", *RUN_KEYS)


def daily_returns(curve: DataFrame, keys: Sequence[str] = CURVE_KEYS) -> DataFrame:
    """Close-to-close equity returns; the very first bar has none."""
    return curve.where("prev_equity is not null").select(
        *keys, "chunk", "blk", "ts", (F.col("equity") / F.col("prev_equity") - 1).alias("ret")
    )


def drawdown_curve(curve: DataFrame, keys: Sequence[str] = CURVE_KEYS) -> DataFrame:
    """Running peak and the drawdown from it on every bar."""
    rows = running(curve, list(keys), {"peak": F.col("equity")}, "max")
    return rows.select(
        *keys, "ts", "equity", "peak", (F.col("equity") / F.col("peak") - 1).alias("drawdown")
    )


def _merged(parts: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """Merge consecutive summaries of a group into one of the same form.

    Moments are merged around the common mean; a drawdown that spans parts is
    the lowest equity of a part against the highest equity before it.
    """
    everything = Window.partitionBy(*group)
    earlier = everything.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    mean = F.coalesce("mean", F.lit(0.0))
    rows = parts.withColumns(
        {
            "common": F.sum(F.col("n") * mean).over(everything) / F.nullif(F.sum("n").over(everything), F.lit(0)),
            "high_before": F.max("high").over(earlier),
        }
    )
    spread = F.col("m2") + F.col("n") * F.pow(mean - F.coalesce("common", F.lit(0.0)), F.lit(2.0))
    return rows.groupBy(*group).agg(
        F.sum("bars").alias("bars"),
        F.sum("n").alias("n"),
        F.first("common").alias("mean"),
        F.sum(spread).alias("m2"),
        F.min("ret_min").alias("ret_min"),
        F.max("ret_max").alias("ret_max"),
        F.sum("long_bars").alias("long_bars"),
        F.min_by("first_prev", order).alias("first_prev"),
        F.min_by("first_equity", order).alias("first_equity"),
        F.max_by("last_equity", order).alias("last_equity"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.min(F.least("dd", F.col("low") / F.col("high_before") - 1)).alias("dd"),
    )


def _summaries(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """One summary per group: returns, exposure, ends and drawdowns.

    Rows are summarised chunk by chunk, chunks span by span, spans per group.
    """
    group = list(group)
    inside = (
        Window.partitionBy(*group, "chunk")
        .orderBy("blk", "ts")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    parts = (
        rows.withColumn("dd", F.col("equity") / F.max("equity").over(inside) - 1)
        .withColumn("ret", F.col("equity") / F.col("prev_equity") - 1)
        .groupBy(*group, "chunk")
        .agg(
            F.count("*").alias("bars"),
            F.count("ret").alias("n"),
            F.avg("ret").alias("mean"),
            (F.coalesce(F.var_pop("ret"), F.lit(0.0)) * F.count("ret")).alias("m2"),
            F.min("ret").alias("ret_min"),
            F.max("ret").alias("ret_max"),
            F.count_if(F.col("units") != 0).alias("long_bars"),
            F.min_by("prev_equity", "ts").alias("first_prev"),
            F.min_by("equity", "ts").alias("first_equity"),
            F.max_by("equity", "ts").alias("last_equity"),
            F.max("equity").alias("high"),
            F.min("equity").alias("low"),
            F.min("dd").alias("dd"),
        )
    )
    spans = _merged(parts.withColumn("span", span()), [*group, "span"], "chunk")
    vs_start = F.col("low") / F.col("first_prev") - 1
    return _merged(spans, group, "span").select(
        *group,
        "bars",
        "n",
        "mean",
        F.sqrt(F.col("m2") / F.when(F.col("n") > 1, F.col("n") - 1)).alias("stdev"),
        "ret_min",
        "ret_max",
        "long_bars",
        F.col("first_prev").alias("start_equity"),
        "first_equity",
        F.col("last_equity").alias("end_equity"),
        F.col("dd").alias("drawdown_from_peak"),
        F.least(F.lit(0.0), "dd", vs_start).alias("drawdown_from_start"),
    )


def curve_metrics(
    curve: DataFrame, trades: DataFrame, keys: Sequence[str] = CURVE_KEYS
) -> DataFrame:
    """Total return, maximum drawdown and number of completed trades."""
    keys = list(keys)
    sells = trades.groupBy(*keys).agg(F.count_if(F.col("side") == "sell").alias("sells"))
    return (
        _summaries(curve, keys)
        .join(sells, keys, "left")
        .select(
            *keys,
            (F.col("end_equity") / F.col("first_equity") - 1).alias("total_return"),
            F.col("drawdown_from_peak").alias("max_drawdown"),
            F.coalesce("sells", F.lit(0)).alias("num_completed_trades"),
        )
    )


def _volatility(periods: int, name: str = "volatility") -> list[Column]:
    return gated(
        name,
        F.col("stdev") * F.sqrt(F.lit(float(periods))),
        F.col("n"),
        MIN_RETURNS_FOR_VOLATILITY,
    )


def _sharpe(periods: int, risk_free: float) -> list[Column]:
    excess = F.col("mean") - F.lit(risk_free / periods)
    return gated(
        "sharpe_like",
        excess / F.col("stdev") * F.sqrt(F.lit(float(periods))),
        F.col("n"),
        MIN_RETURNS_FOR_SHARPE,
        # Equal extremes are an exact test for zero spread, whatever the merge order.
        F.col("ret_min") == F.col("ret_max"),
    )


def trip_counts(trips: DataFrame, windows: Sequence[Period], keys: Sequence[str]) -> DataFrame:
    """Per window: trips completed in it, and trips that cross one of its bounds."""
    rows = cross_boundary(trips, windows, keys)
    completed = (F.col("exit_ts") >= F.col("start")) & (F.col("exit_ts") < F.col("end"))
    return rows.groupBy(*keys, "window").agg(
        F.count_if(completed).alias("completed"), F.count_if("crosses").alias("crossing")
    )


def cross_boundary(trips: DataFrame, windows: Sequence[Period], keys: Sequence[str]) -> DataFrame:
    """Every trip next to every window, with ``crosses``."""
    entry, leave = F.col("entry_ts"), F.col("exit_ts")
    rows = trips.select(*keys, "entry_ts", "exit_ts", F.inline(window_array(windows)))
    at = lambda b: (entry < F.col(b)) & (F.col(b) <= leave)
    return rows.withColumn("crosses", at("start") | at("end"))


def window_metrics(
    curve: DataFrame,
    trips: DataFrame,
    windows: Sequence[Period],
    keys: Sequence[str] = CURVE_KEYS,
    periods: int = PERIODS_PER_YEAR,
) -> DataFrame:
    """Return, volatility, local drawdown, exposure and trip counts per window.

    ``status`` is ``no_equity_before_start`` where a window has no boundary
    value and ``empty_window`` where it has no bars; such rows are kept.
    """
    keys = list(keys)
    # Rows outside all windows are kept as one more group, so that every run is
    # present and the (large) curve is read once.
    stats = _summaries(curve.withColumn("window", window_name(windows)), [*keys, "window"])
    fields = [c for c in stats.columns if c not in (*keys, "window")]
    found = stats.groupBy(*keys).agg(F.collect_list(F.struct("window", *fields)).alias("found"))
    placed = found.select(*keys, "found", F.inline(window_array(windows))).select(
        *keys,
        "window",
        F.get(F.filter("found", lambda s: s["window"] == F.col("window")), F.lit(0)).alias("s"),
    )
    counts = trip_counts(trips, windows, keys)
    return (
        placed.select(*keys, "window", *[F.col("s")[c].alias(c) for c in fields])
        .join(counts, [*keys, "window"], "left")
        .select(
            *keys,
            "window",
            "start_equity",
            "end_equity",
            (F.col("end_equity") / F.col("start_equity") - 1).alias("total_return"),
            *_volatility(periods),
            F.col("drawdown_from_start").alias("local_max_drawdown"),
            (F.col("long_bars") / F.col("bars")).alias("exposure"),
            F.coalesce("completed", F.lit(0)).alias("completed_trips"),
            F.coalesce("crossing", F.lit(0)).alias("cross_boundary_trips"),
            F.when(F.col("bars").isNull(), "empty_window")
            .when(F.col("start_equity").isNull(), "no_equity_before_start")
            .otherwise("ok")
            .alias("status"),
        )
    )


def eligible_round_trips(trips: DataFrame, start, end) -> DataFrame:
    """Entered at or after ``start`` and exited before ``end``."""
    return trips.where((F.col("entry_ts") >= stamp(start)) & (F.col("exit_ts") < stamp(end)))


def burn_in_round_trips(trips: DataFrame, start) -> DataFrame:
    """Entered before ``start``, exited at or after it."""
    return trips.where((F.col("entry_ts") < stamp(start)) & (F.col("exit_ts") >= stamp(start)))


def trip_quality(trips: DataFrame, keys: Sequence[str] = CURVE_KEYS) -> DataFrame:
    """Hit rate and profit factor, gated on the number of trips."""
    pnl = F.col("realized_pnl")
    sums = trips.groupBy(*keys).agg(
        F.count("*").alias("trips"),
        F.count_if(pnl > 0).alias("wins"),
        F.sum(F.when(pnl > 0, pnl).otherwise(0.0)).alias("gross_profit"),
        F.sum(F.when(pnl < 0, -pnl).otherwise(0.0)).alias("gross_loss"),
    )
    return sums.select(
        *keys,
        "trips",
        *gated("hit_rate", F.col("wins") / F.col("trips"), F.col("trips"), MIN_TRIPS),
        *gated(
            "profit_factor",
            F.col("gross_profit") / F.nullif(F.col("gross_loss"), F.lit(0.0)),
            F.col("trips"),
            MIN_TRIPS,
            F.col("gross_loss") == 0,
        ),
    )


def aggregate_metrics(
    curve: DataFrame,
    trips: DataFrame,
    open_positions: DataFrame,
    windows: Sequence[Period],
    keys: Sequence[str] = CURVE_KEYS,
    periods: int = PERIODS_PER_YEAR,
    risk_free: float = 0.0,
) -> DataFrame:
    """One row per run over all evaluation windows together.

    Growth is annualised over the number of windows; ``risk_free`` is annual.
    """
    keys = list(keys)
    start, end, years = windows[0].start, windows[-1].end, len(windows)
    # As in window_metrics: rows outside the range only keep their run present.
    stats = _summaries(curve.withColumn("inside", within(F.col("ts"), start, end)), [*keys, "inside"])
    fields = [c for c in stats.columns if c not in (*keys, "inside")]
    stats = stats.groupBy(*keys).agg(
        F.max(F.when(F.col("inside"), F.struct(*fields))).alias("s")
    ).select(*keys, *[F.col("s")[c].alias(c) for c in fields])
    eligible = eligible_round_trips(trips, start, end)
    quality = trip_quality(eligible, keys)
    burn_in = burn_in_round_trips(trips, start).groupBy(*keys).agg(F.count("*").alias("burn_in"))
    still_open = open_positions.select(*keys).distinct().withColumn("still_open", F.lit(True))
    growth = F.col("end_equity") / F.col("start_equity")

    def gates_of_no_trips(name: str) -> list[Column]:
        """The columns of a gated metric; a run without eligible trips has too few of them."""
        none = F.col("trips").isNull()
        of_none = {"status": F.lit(INSUFFICIENT), "required": F.lit(MIN_TRIPS), "actual": F.lit(0).cast("bigint")}
        filled = [F.when(none, v).otherwise(F.col(f"{name}_{k}")).alias(f"{name}_{k}") for k, v in of_none.items()]
        return [F.col(name), *filled]

    return (
        stats.join(quality, keys, "left")
        .join(burn_in, keys, "left")
        .join(still_open, keys, "left")
        .select(
            *keys,
            "start_equity",
            "end_equity",
            (F.pow(growth, F.lit(1.0 / years)) - 1).alias("cagr"),
            F.when(F.col("start_equity").isNull(), "no_equity_before_start").otherwise("ok").alias("cagr_status"),
            *_volatility(periods),
            F.col("drawdown_from_start").alias("max_drawdown"),
            (F.col("long_bars") / F.col("bars")).alias("exposure"),
            F.coalesce("trips", F.lit(0)).alias("eligible_trips"),
            *gates_of_no_trips("hit_rate"),
            *gates_of_no_trips("profit_factor"),
            *_sharpe(periods, risk_free),
            F.coalesce("burn_in", F.lit(0)).alias("burn_in_trips"),
            F.coalesce("still_open", F.lit(False)).alias("still_open_at_end"),
        )
    )


def pnl_concentration(trips: DataFrame, keys: Sequence[str] = CURVE_KEYS) -> DataFrame:
    """Share of the largest winner, and how many top winners make half the gains.

    Winners are reduced to distinct amounts and scanned from the largest down in
    slices of nearly equal amounts, so that no series is sorted in one task.
    """
    keys = list(keys)
    everyone = trips.select(*keys).distinct()
    amounts = (
        trips.where("realized_pnl > 0")
        .groupBy(*keys, F.col("realized_pnl").alias("pnl"))
        .agg(F.count("*").alias("n"))
        .withColumn("chunk", F.floor(-F.log2("pnl") * 1024))
        .withColumn("won", F.col("pnl") * F.col("n"))
    )
    totals = amounts.groupBy(*keys).agg(
        F.sum("won").alias("total_positive_pnl"), F.max("pnl").alias("largest")
    )
    # The total comes with the sum over slices, so no row meets it by its bare key.
    slices = amounts.groupBy(*keys, "chunk").agg(F.sum("won").alias("in_slice"))
    half = (F.sum("in_slice").over(Window.partitionBy(*keys)) * 0.5).alias("half")
    ranked = running(
        amounts, keys, {"cum": F.col("won"), "cum_n": F.col("n")}, "sum", order=[F.desc("pnl")]
    ).join(slices.select(*keys, "chunk", half), [*keys, "chunk"])
    before = F.col("cum") - F.col("won")
    needed = F.col("cum_n") - F.col("n") + F.ceil((F.col("half") - before) / F.col("pnl"))
    count = (
        ranked.where(F.col("cum") >= F.col("half"))
        .groupBy(*keys)
        .agg(F.min_by(needed, "cum_n").alias("trips_for_half"))
    )
    return (
        everyone.join(totals, keys, "left")
        .join(count, keys, "left")
        .select(
            *keys,
            (F.col("largest") / F.col("total_positive_pnl")).alias("largest_positive_fraction"),
            F.col("trips_for_half").cast("bigint").alias("trips_for_half"),
            F.coalesce("total_positive_pnl", F.lit(0.0)).alias("total_positive_pnl"),
            F.when(F.col("largest").isNull(), "no positive round trips").alias("note"),
        )
    )


def largest_move(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Largest absolute close-to-close change and its bar.

    ``bars`` is a panel with ``prev_close``.
    """
    change = F.col("close") / F.col("prev_close") - 1
    moves = bars.where("prev_close is not null").withColumn("size", F.abs(change))
    # The earliest bar wins among equal changes.
    best = F.max_by(F.struct("ts", change.alias("change")), F.struct("size", -epoch_seconds(F.col("ts"))))
    return moves.groupBy(*keys).agg(best.alias("best")).select(
        *keys, F.col("best.ts").alias("ts"), F.col("best.change").alias("change")
    )
