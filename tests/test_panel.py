"""Averages, signals, ledgers and curves against plain loops, for several layouts."""

import pandas as pd
import pytest
from walks import random_walk, simulate
from pyspark.sql import functions as F
from tapecheck.operators import indicators, ledger, signals
from tapecheck.operators.blocks import BY_POSITION, Layout, Positions

LAYOUTS = [Positions(7, 3), Positions(64, 64), Layout(), Layout(86400, 4, 3), Layout(86400, 1, 2), Layout(86400, 9, 1)]
GRID = [(1, 3), (2, 5), (3, 9)]


@pytest.fixture(scope="module")
def walks(spark):
    rows = random_walk(300, 1, "A", gap_every=11) + random_walk(7, 2, "B") + random_walk(1, 3, "C")
    frame = pd.DataFrame(rows, columns=["symbol", "day", "open", "close", "signal"])
    frame["ts"] = pd.Timestamp("2020-01-01") + pd.to_timedelta(frame.day, unit="D")
    sdf = spark.createDataFrame(frame.drop(columns="day")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return frame, sdf.cache()


def _sorted(df):
    return df.toPandas().sort_values(["symbol", "ts"])


@pytest.mark.parametrize("layout", LAYOUTS)
def test_averages_match_the_recursion(walks, layout):
    frame, sdf = walks
    out = _sorted(indicators.ema(sdf, [1, 2, 5, 30], layout=layout))
    for symbol, g in frame.groupby("symbol"):
        for p in (1, 2, 5, 30):
            want = g.close.ewm(span=p, adjust=False, min_periods=p).mean().to_numpy()
            got = out[out.symbol == symbol][f"ema_{p}"].to_numpy(dtype=float)
            assert got == pytest.approx(want, rel=1e-12, nan_ok=True)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_ledger_and_curve_match_a_loop(walks, layout):
    frame, sdf = walks
    panel = signals.signal_panel(sdf, GRID, layout=layout).cache()
    bits = _sorted(panel)
    book = ledger.runs(GRID, {"dear": (0.01, 0.02)}, cash=1000.0)
    trades = ledger.fill_ledger(panel, book).toPandas().sort_values(["symbol", "ts"])
    curve = ledger.equity_curve(panel, book).toPandas().sort_values(["symbol", "ts"])
    for symbol, g in frame.groupby("symbol"):
        for i, (fast, slow) in enumerate(GRID):
            signal = [(m >> i) & 1 for m in bits[bits.symbol == symbol].sig]
            e = {p: g.close.ewm(span=p, adjust=False, min_periods=p).mean() for p in (fast, slow)}
            assert signal == (e[fast] > e[slow]).astype(int).tolist()
            fills, equity = simulate(g.open.tolist(), g.close.tolist(), signal, 0.01, 0.02, 1000.0)
            t = trades[(trades.symbol == symbol) & (trades.fast == fast)]
            assert t.side.tolist() == [f[1] for f in fills]
            assert t.price.tolist() == pytest.approx([f[2] for f in fills], rel=1e-12)
            assert t.quantity.tolist() == pytest.approx([f[3] for f in fills], rel=1e-11)
            assert t.commission.tolist() == pytest.approx([f[4] for f in fills], rel=1e-11)
            c = curve[(curve.symbol == symbol) & (curve.fast == fast)]
            assert c.equity.tolist() == pytest.approx(equity, rel=1e-11)
            assert c.prev_equity.tolist()[1:] == pytest.approx(equity[:-1], rel=1e-11)
            assert pd.isna(c.prev_equity.iloc[0])


@pytest.mark.parametrize("layout", LAYOUTS)
def test_given_signal_is_shifted_across_chunks(walks, layout):
    frame, sdf = walks
    marked = sdf.withColumn("signal", (F.dayofyear("ts") % 3 == 0).cast("int"))
    want = _sorted(marked)
    got = _sorted(signals.positions(marked, layout=layout))
    for symbol, g in want.groupby("symbol"):
        s = g.signal.tolist()
        o = got[got.symbol == symbol]
        assert o.tgt.tolist() == [0, *s[:-1]]
        assert o.ptgt.tolist() == [0, 0, *s[:-2]][: len(s)]
        assert o.idx.tolist() == list(range(len(s)))


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_same_answer_however_rows_are_spread(walks, partitions):
    _, sdf = walks
    base = _sorted(signals.signal_panel(sdf, GRID)).reset_index(drop=True)
    again = _sorted(signals.signal_panel(sdf.repartition(partitions), GRID)).reset_index(drop=True)
    pd.testing.assert_frame_equal(base, again)


def test_later_bars_do_not_change_the_past(walks):
    _, sdf = walks
    cut = F.lit("2020-09-01").cast("timestamp_ntz")
    moved = sdf.withColumn("close", F.when(F.col("ts") >= cut, F.col("close") * 3).otherwise(F.col("close")))
    a, b = (_sorted(signals.signal_panel(d, GRID).where(F.col("ts") < cut)) for d in (sdf, moved))
    assert a.sig.tolist() == b.sig.tolist() and a.tgt.tolist() == b.tgt.tolist()


def test_events_and_transitions(make_bars):
    bars = make_bars([("X", i, 10, 10, s) for i, s in enumerate([1, 1, 0, 1, 0])])
    panel = signals.positions(bars)
    rows = sorted(signals.entry_exit_events(panel).collect(), key=lambda r: r.ts)
    assert [r.entry for r in rows] == [True, False, False, True, False]
    assert [r.exit for r in rows] == [False, False, True, False, True]
    assert [r.fill_entry for r in rows] == [False, True, False, False, True]
    assert signals.signal_transitions(panel).first().transitions == 3


def test_dense_bars_need_no_layout(spark):
    many = spark.range(2000).select(
        F.lit("X").alias("symbol"),
        (F.lit("2020-01-01").cast("timestamp_ntz") + F.expr("make_interval(0,0,0,0,0,id)")).alias("ts"),
        F.lit(1.0).alias("open"), (F.col("id") % 7 * 1.0).alias("close"),
    )
    value, want = 0.0, []
    for i in range(2000):
        value = value + (i % 7 - value) * 2 / 11 if i else 0.0
        want.append(value)
    for layout in (Layout(), Layout(bar_seconds=1), Layout(bar_seconds=1, block_bars=16, chunk_blocks=4), BY_POSITION, Positions(64, 16)):
        got = [r.ema_10 for r in indicators.ema(many, [10], layout=layout).orderBy("ts").collect()]
        assert got[:9] == [None] * 9
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[9:], want[9:]))


def test_small_layouts_cut_a_series_into_chunks(spark):
    bars = spark.range(300).select(
        F.lit("X").alias("symbol"), F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(cast(id as int))").alias("ts"),
        F.lit(1.0).alias("open"), F.lit(1.0).alias("close"),
    )
    chunks = signals.signal_panel(bars, [(2, 3)], layout=Layout(block_bars=16, chunk_blocks=4)).agg(F.min("chunk"), F.max("chunk")).first()
    assert chunks[1] - chunks[0] >= 4


def test_rows_without_time_or_key_are_kept(spark):
    rows = [("X", "2024-01-01", 1.0), ("X", None, 2.0), (None, "2024-01-02", 3.0), ("X", "2024-01-02", 4.0)]
    bars = spark.createDataFrame(rows, "symbol string, d string, close double").select("symbol", F.col("d").cast("timestamp_ntz").alias("ts"), "close")
    assert sorted((r.close, r.ema_1) for r in indicators.ema(bars, [1]).collect()) == [(1.0, 1.0), (2.0, None), (3.0, None), (4.0, 4.0)]


@pytest.mark.parametrize("period", [0, -1, 2.0, True, "3"])
def test_bad_periods(walks, period):
    with pytest.raises(ValueError):
        indicators.ema(walks[1], [period])


def test_cells_keep_order_and_cap():
    assert signals.cells([3, 1], [2, 4]) == [(3, 4), (1, 2), (1, 4)]
    with pytest.raises(ValueError):
        signals.cells(range(1, 7), range(10, 16))
    with pytest.raises(ValueError):
        signals.cells([1], [2], limit=26)
    with pytest.raises(ValueError):
        signals.check_cell(5, 5)


def _trades(spark, rows):
    df = spark.createDataFrame(
        [("X", 1, 2, "s", d, side, float(p), float(q), float(c)) for d, side, p, q, c in rows],
        "symbol string, fast int, slow int, scenario string, d int, side string, price double, quantity double, commission double",
    )
    ts = F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).cast("timestamp_ntz")
    return ledger.with_chunks(df.withColumn("ts", ts).drop("d"), Layout(86400, 1, 2))


def test_round_trips_by_hand(spark):
    t = _trades(spark, [(0, "buy", 10, 5, 1), (9, "sell", 12, 5, 2), (20, "buy", 11, 4, 1)])
    trip = ledger.round_trips(t).collect()
    assert len(trip) == 1 and trip[0].realized_pnl == pytest.approx(2 * 5 - 1 - 2)
    assert [r.entry_ts.day for r in ledger.open_positions(t).collect()] == [21]
    assert ledger.trade_violations(t).count() == 0


@pytest.mark.parametrize(
    "rows, reason",
    [
        ([(0, "buy", 1, 1, 0), (5, "buy", 1, 1, 0)], "consecutive_buys"),
        ([(0, "sell", 1, 1, 0)], "orphan_sell"),
        ([(0, "buy", 1, 1, 0), (5, "sell", 1, 1.1, 0)], "quantity_mismatch"),
        ([(0, "short", 1, 1, 0)], "unknown_side"),
    ],
)
def test_trades_that_cannot_pair(spark, rows, reason):
    assert [r.reason for r in ledger.trade_violations(_trades(spark, rows)).collect()] == [reason]


def test_buy_and_hold(make_bars):
    bars = make_bars([("X", i, 10 + i, 10.5 + i) for i in range(5)])
    r = ledger.buy_and_hold(bars, "2024-01-02", "2024-01-04", 1000.0, 0.01, 0.02).first()
    q = 1000 / (11 * 1.02 * 1.01)
    assert r.quantity == pytest.approx(q) and r.final_value == pytest.approx(q * 12.5)
    statuses = lambda a, b: ledger.buy_and_hold(bars, a, b).first().status
    assert statuses("2025-01-01", "2026-01-01") == "no_rows_from_start"
    assert statuses("2023-01-01", "2023-02-01") == "no_rows_before_end"
    assert statuses("2024-01-04", "2024-01-02") == "end_precedes_start"
