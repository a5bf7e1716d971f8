"""Hand-specified cases with literal expected fills."""

import pytest
from walks import series
from tapecheck.operators import ledger, signals

CASES = {
    "fill at next open": (
        series([10, 10, 10, 30], [10, 10, 20, 33], [0, 0, 1, 1]), 0.0, 0.0,
        [(3, "buy", 30.0, 1000 / 30)], [1000, 1000, 1000, 1100],
    ),
    "signal on the last bar never fills": (
        series([10] * 4, [10] * 4, [0, 0, 0, 1]), 0.0, 0.0, [], [1000] * 4,
    ),
    "never enter": (
        series([10, 12, 9, 11], [10, 12, 9, 11]), 0.001, 0.0005, [], [1000] * 4,
    ),
    "never exit": (
        series([10, 10, 20, 22], [10, 10, 20, 22], [0, 1, 1, 1]), 0.0, 0.0,
        [(2, "buy", 20.0, 50.0)], [1000, 1000, 1000, 1100],
    ),
    "gap open": (
        series([10, 10, 200], [10, 10, 205], [0, 1, 1]), 0.0, 0.01,
        [(2, "buy", 202.0, 1000 / 202)], [1000, 1000, 1000 / 202 * 205],
    ),
    "missing days are positional": (
        series([10, 10, 15], [10, 10, 15], [0, 1, 1], days=[0, 1, 5]), 0.0, 0.0,
        [(5, "buy", 15.0, 1000 / 15)], [1000, 1000, 1000],
    ),
    "costs on both sides": (
        series([10, 10, 100, 100, 120], [10, 10, 100, 100, 120], [0, 1, 1, 0, 0]), 0.01, 0.02,
        [(2, "buy", 102.0, 9.70685303824), (4, "sell", 117.6, 9.70685303824)],
        [1000, 1000, 970.685303824, 970.685303824, 1130.11065812405376],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_fills_and_equity(name, make_bars):
    rows, commission, slippage, fills, equity = CASES[name]
    bars = make_bars(rows)
    trades, curve = ledger.run_signal(bars, commission, slippage, cash=1000.0)
    start = bars.agg({"ts": "min"}).first()[0]
    got = [
        ((r.ts - start).days, r.side, r.price, r.quantity) for r in sorted(trades.collect(), key=lambda r: r.ts)
    ]
    assert [g[:2] for g in got] == [f[:2] for f in fills]
    for g, f in zip(got, fills):
        assert g[2:] == pytest.approx(f[2:], rel=1e-10)
    values = [r.equity for r in sorted(curve.collect(), key=lambda r: r.ts)]
    assert values == pytest.approx(equity, rel=1e-10)


def test_equal_averages_are_flat(make_bars):
    bars = make_bars(series([100] * 10, [100] * 10))
    out = signals.crossover_signal(bars, 2, 3).collect()
    assert all(r.signal == 0 for r in out)
    assert all(r.fast_ema in (None, 100.0) for r in out)


def test_no_trade_in_warm_up(make_bars):
    closes = [10, 50, 90, 95, 96]
    panel = signals.signal_panel(make_bars(series(closes, closes)), [(2, 3)])
    fills = ledger.fill_ledger(panel, ledger.runs([(2, 3)], {"free": (0.0, 0.0)})).collect()
    assert [r.side for r in fills] == ["buy"] and fills[0].ts.day == 4


@pytest.mark.parametrize("bad", [-1, float("nan"), 1.0, True])
def test_cost_rates_are_checked(bad):
    with pytest.raises(ValueError):
        ledger.Run(0, 1, 2, "x", bad, 0.0)


def test_signal_values_are_checked(make_bars):
    with pytest.raises(Exception, match="only 0"):
        ledger.run_signal(make_bars([("X", 0, 1, 1, 2)]))[1].collect()
