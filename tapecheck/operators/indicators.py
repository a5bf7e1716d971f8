"""Exponential moving averages over panels of series.

The average ``y[t] = a*x[t] + (1-a)*y[t-1]`` is tracked through its distance to
the price, ``d = x - y``, which obeys ``d[t] = q*(d[t-1] + x[t] - x[t-1])`` with
``q = 1 - a`` and ``d[0] = 0``. A flat series therefore has ``d = 0`` exactly and
both averages equal the price, with no rounding noise to fake a crossover.

The recurrence is linear, so a run of bars acts on the distance it starts with
as ``d_out = q^n * u + b``. Short blocks compute ``b`` with a window sum; runs of blocks,
chunks and spans are composed by scans in doubling steps (composition is associative), and the
carried distance is added back to each row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapecheck.operators.blocks import BY_POSITION, Layout, Positions, Stored, span, with_blocks

# State between two runs: bars so far, and distance and price of the last
# (``d1``, ``x1``) and the last but one bar (``d2``, ``x2``).
_STATE = "struct<off:bigint,d1:array<double>,x1:double,d2:array<double>,x2:double>"


def check_period(period: object) -> int:
    if isinstance(period, bool) or not isinstance(period, int):
        raise ValueError(f"period must be an integer, got {period!r}")
    if period < 1:
        raise ValueError(f"period must be a positive integer, got {period}")
    return period


def _power(period: int, exponent: str) -> str:
    """``q^exponent`` in SQL; a period of one keeps nothing of the past."""
    return "0.0D" if period == 1 else f"pow({(period - 1) / (period + 1)!r}D, {exponent})"


def _empty_state(periods: Sequence[int]) -> str:
    zeros = "array(" + ", ".join("0.0D" for _ in periods) + ")"
    return f"named_struct('off', 0L, 'd1', {zeros}, 'x1', 0.0D, 'd2', {zeros}, 'x2', 0.0D)"


def _advance(periods: Sequence[int], state: str, run: str) -> str:
    """State after a run, in SQL.

    A run starts with the carried distance corrected for the price jump into it.
    """
    d1, d2 = [], []
    for i, p in enumerate(periods):
        start = f"if({state}.off = 0, 0.0D, {state}.d1[{i}] + {run}.first_x - {state}.x1)"
        d1.append(f"{_power(p, f'{run}.n')} * {start} + {run}.b1[{i}]")
        d2.append(f"if({run}.n < 2, {state}.d1[{i}], {_power(p, f'{run}.n - 1')} * {start} + {run}.b2[{i}])")
    return (
        f"named_struct('off', {state}.off + {run}.n, 'd1', array({', '.join(d1)}), 'x1', {run}.last_x, "
        f"'d2', array({', '.join(d2)}), 'x2', if({run}.n < 2, {state}.x1, {run}.prev_x))"
    )


_RUN_FIELDS = ("n", "first_x", "last_x", "prev_x", "b1", "b2")


def _joined(periods: Sequence[int], left: str, right: str) -> str:
    """Two adjacent runs as one, in SQL: how the first leaves the distance is how the second starts.

    The operation is associative, so runs may be combined in any order of brackets.
    """
    b1, b2 = [], []
    for i, p in enumerate(periods):
        start = f"({left}.b1[{i}] + {right}.first_x - {left}.last_x)"
        b1.append(f"{_power(p, f'{right}.n')} * {start} + {right}.b1[{i}]")
        b2.append(f"if({right}.n < 2, {left}.b1[{i}], {_power(p, f'{right}.n - 1')} * {start} + {right}.b2[{i}])")
    return (
        f"named_struct('n', {left}.n + {right}.n, 'first_x', {left}.first_x, 'last_x', {right}.last_x, "
        f"'prev_x', if({right}.n < 2, {left}.last_x, {right}.prev_x), "
        f"'b1', array({', '.join(b1)}), 'b2', array({', '.join(b2)}))"
    )


def _scanned(runs: str, periods: Sequence[int]) -> str:
    """For every run of an ordered array, all up to it as one, in SQL.

    Distances double from step to step: after the step at distance d each run has taken in the 2d - 1 before it.
    """
    plain = f"transform({runs}, x -> struct({', '.join(f'x.{f}' for f in _RUN_FIELDS)}))"
    steps = f"transform(sequence(0, cast(ceil(log2(greatest(size({runs}), 2))) as int) - 1), e -> shiftleft(1, e))"
    step = f"transform(acc, (x, i) -> if(i < d, x, {_joined(periods, 'acc[i - d]', 'x')}))"
    return f"aggregate({steps}, {plain}, (acc, d) -> {step})"


def _with_totals(df: DataFrame, runs: str, periods: Sequence[int]) -> DataFrame:
    """Add ``scan``, the runs up to each, and ``done``, all of them as one."""
    return df.withColumn("scan", F.expr(_scanned(runs, periods))).withColumn("done", F.expr("element_at(scan, -1)"))


def _states_before(start: str, periods: Sequence[int]) -> Column:
    """For every run of ``scan``, the state it starts from, given that of the first."""
    return F.expr(f"transform(scan, (x, i) -> if(i = 0, {start}, {_advance(periods, start, 'scan[i - 1]')}))")


def ema_panel(
    bars: DataFrame,
    periods: Sequence[int],
    keys: Sequence[str] = ("symbol",),
    layout: Layout | Positions | Stored = BY_POSITION,
    on_entry: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows with ``idx`` (position in the series), ``gap`` (array of ``close - ema``
    per period) and ``prev_close``.

    ``on_entry`` maps column names to SQL over ``entry``, the state a chunk starts
    from; they are evaluated once per chunk and attached to its rows, together
    with ``r``, the row's place in its chunk.

    Chunks are runs of ``layout.chunk_rows`` rows of a series, so that none grows with the density of bars; a
    :class:`~tapecheck.operators.blocks.Layout` cuts bars of known spacing by time instead and saves an exchange, and bars
    that are stored in clusters (:class:`~tapecheck.operators.blocks.Stored`) need none. Blocks are
    runs of ``layout.block_bars`` rows inside a chunk. Times should be unique in a series. Rows without a key or a time have no place in a
    series and are left out here; :func:`ema` returns them, and the quality rules list them.
    """
    keys = list(keys)
    for p in periods:
        check_period(p)
    part = ", ".join(f"`{k}`" for k in [*keys, "chunk"])
    series = f"OVER (PARTITION BY {part} ORDER BY ts)"
    run_of = f"OVER (PARTITION BY {part}, blk ORDER BY ts)"
    to_here = f"OVER (PARTITION BY {part}, blk ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    carried = [c for c in bars.columns if c not in (*keys, "chunk")]

    local = [
        "0.0D"
        if p == 1
        else f"{_power(p, 'k')} * coalesce(sum({_power(p, '1 - k')} * step) {to_here}, 0.0D)"
        for p in periods
    ]
    # The joins below, on chunks and on spans, would drop rows without a key or a time anyway. Saying so
    # first gives every branch the same filter, so that they share one scan and one exchange.
    present = " and ".join(f"`{k}` is not null" for k in [*keys, "chunk"])
    placed = with_blocks(bars, layout, keys).where(present).where(span().isNotNull())
    if not isinstance(layout, Stored):
        placed = placed.repartition(*keys, "chunk")
    rows = (
        placed.withColumns({"r": F.expr(f"row_number() {series}"), "lag_close": F.expr(f"lag(close) {series}")})
        .withColumn("blk", F.expr(f"(r - 1) div {layout.block_bars}"))
        .withColumns(
            {
                "k": F.expr(f"(r - 1) % {layout.block_bars}"),
                "pos": F.expr("cast(blk + 1 as int)"),
                "step": F.expr(f"close - lag(close) {run_of}"),
                "first_x": F.expr(f"first(close) {run_of}"),
                "run_end": F.expr(f"lead(ts) {run_of} is null"),
            }
        )
        .withColumn("b", F.expr(f"array({', '.join(local)})"))
    )

    # The row struct is not used by the fold: with it both branches of the join
    # below read the same columns, so the planner shuffles the bars once and
    # reuses the exchange.
    item = (
        f"struct(blk, n, first_x, close AS last_x, x_prev AS prev_x, b AS b1, b_prev AS b2, "
        f"struct({', '.join(f'`{c}`' for c in carried)}) AS row)"
    )
    runs = (
        rows.withColumns(
            {"b_prev": F.expr(f"lag(b) {run_of}"), "x_prev": F.expr(f"lag(close) {run_of}")}
        )
        .where("run_end")
        .withColumn("n", F.expr("k + 1"))
        .groupBy(*keys, "chunk")
        .agg(F.expr(f"array_sort(collect_list({item})) AS runs"))
        # These few rows are used twice; an exchange of their own lets both uses
        # share one scan, and the modulus spreads the chunks of a long series.
        .repartition(*keys, F.pmod("chunk", F.lit(64)))
    )
    # Chunks are composed as if each started the series, then spans of chunks; the scans of
    # the spans of a series and of the chunks of a span give every chunk the state it really
    # starts from. A scan of n runs takes n log n steps.
    composed = f"struct({{order}}, {', '.join(f'done.{f}' for f in _RUN_FIELDS)}) AS item"
    runs = _with_totals(runs, "runs", periods)
    chunks = runs.select(*keys, span().alias("span"), F.expr(composed.format(order="chunk")))
    spans = chunks.groupBy(*keys, "span").agg(F.expr("array_sort(collect_list(item)) AS items"))
    spans = _with_totals(spans, "items", periods)
    quoted = [f"`{k}`" for k in keys]
    span_starts = (
        spans.select(*keys, F.expr(composed.format(order="span")))
        .groupBy(*keys)
        .agg(F.expr("array_sort(collect_list(item)) AS items"))
    )
    span_starts = (
        _with_totals(span_starts, "items", periods)
        .withColumn("start", F.expr(_empty_state(periods)))
        .withColumn("starts", _states_before("start", periods))
        .selectExpr(*quoted, "inline(arrays_zip(items.span, starts)) AS (span, start)")
    )
    starts = (
        spans.join(span_starts, [*keys, "span"])
        .withColumn("entry", _states_before("start", periods))
        .selectExpr(*quoted, "inline(arrays_zip(items.chunk, entry)) AS (chunk, entry)")
    )
    on_entry = dict(on_entry or {})
    carries = runs.join(starts, [*keys, "chunk"]).select(
        *keys,
        "chunk",
        _states_before("entry", periods).alias("states"),
        *[F.expr(f"{sql} AS {name}") for name, sql in on_entry.items()],
    )

    gaps = [
        f"{_power(p, 'k + 1')} * if(state.off = 0, 0.0D, state.d1[{i}] + first_x - state.x1) + b[{i}]"
        for i, p in enumerate(periods)
    ]
    return (
        rows.join(carries, [*keys, "chunk"])
        .withColumn("state", F.expr("element_at(states, pos)"))
        .select(
            *keys,
            "chunk",
            "blk",
            *carried,
            "r",
            F.expr("state.off + k AS idx"),
            F.expr(f"array({', '.join(gaps)}) AS gap"),
            F.expr("coalesce(lag_close, if(state.off > 0, state.x1, NULL)) AS prev_close"),
            *on_entry,
        )
    )


def ema_column(periods: Sequence[int], period: int) -> Column:
    """The average itself; NULL on the first ``period - 1`` bars."""
    i = list(periods).index(period)
    return F.when(F.col("idx") >= period - 1, F.col("close") - F.col("gap")[i])


def ema(
    bars: DataFrame,
    periods: Sequence[int],
    keys: Sequence[str] = ("symbol",),
    layout: Layout | Positions | Stored = BY_POSITION,
) -> DataFrame:
    """``keys, ts, close`` and one ``ema_<period>`` column per period.

    Rows without a key or a time are kept, with NULL averages.
    """
    rows = ema_panel(bars, periods, keys, layout)
    placed = rows.select(
        *keys, "ts", "close", *[ema_column(periods, p).alias(f"ema_{p}") for p in periods]
    )
    unplaced = bars.where(" or ".join(f"`{c}` is null" for c in [*keys, "ts"]))
    none = F.lit(None).cast("double")
    return placed.unionByName(
        unplaced.select(*keys, "ts", "close", *[none.alias(f"ema_{p}") for p in periods])
    )
