"""Metrics against plain Python on the same numbers."""

import math
import statistics

import pytest
from walks import random_walk
from pyspark.sql import functions as F
from tapecheck.operators import ledger, metrics, robustness, signals, timeline
from tapecheck.operators.blocks import Layout

GRID = [(2, 5), (2, 9), (3, 5), (3, 9)]
SMALL = Layout(86400, 8, 4)


@pytest.fixture(scope="module")
def study(spark):
    rows = random_walk(1400, 5, "A") + random_walk(1400, 6, "B")
    df = spark.createDataFrame(rows, "symbol string, day int, open double, close double, signal int")
    ts = F.date_add(F.lit("2019-12-31").cast("date"), F.col("day")).cast("timestamp_ntz")
    bars = df.withColumn("ts", ts).drop("day").cache()
    panel = signals.signal_panel(bars, GRID, layout=SMALL).cache()
    book = ledger.runs(GRID)
    curve = ledger.equity_curve(panel, book).cache()
    trades = ledger.fill_ledger(panel, book).cache()
    return bars, panel, book, curve, trades


_, WINDOWS = timeline.build_windows(2020, [2021, 2022, 2023])


def _equity(curve, symbol="A", fast=2, slow=5):
    rows = curve.where((F.col("symbol") == symbol) & (F.col("fast") == fast) & (F.col("slow") == slow))
    return sorted((r.ts, r.equity, r.units) for r in rows.collect())


def _pick(df, symbol="A", fast=2, slow=5):
    return [r for r in df.collect() if (r.symbol, r.fast, r.slow) == (symbol, fast, slow)]


def test_window_metrics(study):
    *_, curve, trades = study
    trips = ledger.round_trips(trades)
    got = {r.window: r for r in _pick(metrics.window_metrics(curve, trips, WINDOWS))}
    eq = _equity(curve)
    for w in WINDOWS:
        inside = [(e, u) for t, e, u in eq if str(t)[:4] == str(w.name)]
        start = [e for t, e, _ in eq if t.year < w.name][-1]
        rets, peak, dd, prev = [], start, 0.0, start
        for e, _ in inside:
            rets.append(e / prev - 1)
            prev, peak = e, max(peak, e)
            dd = min(dd, e / peak - 1)
        r = got[w.name]
        assert r.start_equity == pytest.approx(start)
        assert r.total_return == pytest.approx(inside[-1][0] / start - 1)
        assert r.volatility == pytest.approx(statistics.stdev(rets) * math.sqrt(252))
        assert r.local_max_drawdown == pytest.approx(dd)
        assert r.exposure == pytest.approx(sum(u != 0 for _, u in inside) / len(inside))
        pairs = [(t.entry_ts, t.exit_ts) for t in _pick(trips)]
        assert r.completed_trips == sum(b.year == w.name for _, b in pairs)
        lo, hi = (F_year(w.name), F_year(w.name + 1))
        assert r.cross_boundary_trips == sum((a < lo <= b) or (a < hi <= b) for a, b in pairs)


def F_year(y):
    from datetime import datetime

    return datetime(y, 1, 1)


def test_window_without_rows_is_reported(study):
    *_, curve, trades = study
    _, far = timeline.build_windows(2029, [2030])
    row = metrics.window_metrics(curve, ledger.round_trips(trades), far).first()
    assert row.status == "empty_window" and row.total_return is None
    _, first = timeline.build_windows(2019, [2020])
    row = metrics.window_metrics(curve, ledger.round_trips(trades), first).first()
    assert row.status == "no_equity_before_start" and row.total_return is None


def test_curve_and_aggregate_metrics(study):
    *_, curve, trades = study
    eq = [e for _, e, _ in _equity(curve)]
    peak, dd = eq[0], 0.0
    for e in eq:
        peak = max(peak, e)
        dd = min(dd, e / peak - 1)
    got = _pick(metrics.curve_metrics(curve, trades))[0]
    assert got.total_return == pytest.approx(eq[-1] / eq[0] - 1)
    assert got.max_drawdown == pytest.approx(dd)
    assert got.num_completed_trades == len(_pick(ledger.round_trips(trades)))

    out = metrics.aggregate_metrics(
        curve, ledger.round_trips(trades), ledger.open_positions(trades), WINDOWS, risk_free=0.02
    )
    got = _pick(out)[0]
    rows = [(t, e) for t, e, _ in _equity(curve) if 2020 <= t.year <= 2023]
    values = [e for t, e in rows if t.year >= 2021]
    start = [e for t, e in rows if t.year == 2020][-1]
    rets = [b / a - 1 for a, b in zip([start, *values], values)]
    excess = [r - 0.02 / 252 for r in rets]
    assert got.cagr == pytest.approx((values[-1] / start) ** (1 / 3) - 1)
    assert got.sharpe_like == pytest.approx(statistics.fmean(excess) / statistics.stdev(excess) * math.sqrt(252))
    pnls = [t.realized_pnl for t in _pick(ledger.round_trips(trades))
            if t.entry_ts >= F_year(2021) and t.exit_ts < F_year(2024)]
    assert got.eligible_trips == len(pnls) >= 20
    assert got.hit_rate == pytest.approx(sum(p > 0 for p in pnls) / len(pnls))
    assert got.profit_factor == pytest.approx(sum(p for p in pnls if p > 0) / -sum(p for p in pnls if p < 0))


def test_flat_curve_has_no_sharpe(study):
    bars, *_ = study
    panel = signals.positions(bars)
    curve = ledger.equity_curve(panel, ledger.runs([(1, 2)]))
    trades = ledger.fill_ledger(panel, ledger.runs([(1, 2)]))
    r = metrics.aggregate_metrics(curve, ledger.round_trips(trades), ledger.open_positions(trades), WINDOWS).first()
    assert r.sharpe_like is None and r.sharpe_like_status == "not_applicable"
    assert r.hit_rate_status == "insufficient_sample" and r.volatility == 0


def _pnls(spark, values):
    return spark.createDataFrame([("X", 1, 2, "s", float(v)) for v in values],
                                 "symbol string, fast int, slow int, scenario string, realized_pnl double")


@pytest.mark.parametrize(
    "values, status",
    [([1] * 19, "insufficient_sample"), ([1] * 20, "not_applicable"), ([1] * 10 + [-2] * 10, "ok"), ([0] * 20, "not_applicable")],
)
def test_trip_gates(spark, values, status):
    r = metrics.trip_quality(_pnls(spark, values)).first()
    assert r.profit_factor_status == status
    assert (r.profit_factor is None) == (status != "ok")
    if len(values) >= 20:
        assert r.hit_rate == sum(v > 0 for v in values) / 20


@pytest.mark.parametrize(
    "values",
    [[10], [10, 10], [1, 2, 3, 4, -50], [5] * 7 + [1], [-1, -2], [1e-6, 1e6, 3e5, 3e5, 7.25], list(range(1, 200))],
)
def test_concentration(spark, values):
    r = metrics.pnl_concentration(_pnls(spark, values)).first()
    wins = sorted((v for v in values if v > 0), reverse=True)
    if not wins:
        assert r.largest_positive_fraction is None and r.note == "no positive round trips"
        return
    total, cum, k = sum(wins), 0, 0
    for v in wins:
        cum, k = cum + v, k + 1
        if cum >= total / 2:
            break
    assert (r.trips_for_half, r.largest_positive_fraction) == (k, pytest.approx(wins[0] / total))


def test_grid_agrees_with_full_curves(study):
    _, panel, book, curve, _ = study
    grid = robustness.grid_returns(panel, book, WINDOWS).collect()
    assert len(grid) == 2 * len(GRID) * len(WINDOWS)
    for r in grid:
        eq = _equity(curve, r.symbol, r.fast, r.slow)
        before = lambda y: [e for t, e, _ in eq if t.year < y][-1]
        assert r.window_return == pytest.approx(before(r.window + 1) / before(r.window) - 1, rel=1e-9, abs=1e-12)


def test_cost_stress_reuses_the_baseline(study):
    _, panel, book, *_ = study
    grid = robustness.grid_returns(panel, book, WINDOWS)
    costs = {"baseline": (0.001, 0.0005), "worse": (0.01, 0.01)}
    rows = robustness.cost_stress(panel, GRID, grid, costs, WINDOWS, cell=(2, 9)).collect()
    assert {r.scenario for r in rows} == {"baseline", "worse"} and len(rows) == 2 * 2 * 3
    by = {(r.symbol, r.window, r.scenario): r.aggregate_return for r in rows}
    assert all(by[s, w, "worse"] < by[s, w, "baseline"] for s, w, _ in by)


def test_fragility_by_hand(spark):
    cells = {(2, 5): 0.1, (2, 9): -0.1, (3, 5): 0.2, (3, 9): 0.0}
    df = spark.createDataFrame([("X", f, s, a) for (f, s), a in cells.items()],
                               "symbol string, fast int, slow int, aggregate_return double")
    nb = robustness.grid_neighbors(df, [2, 3], [5, 9])
    assert nb.count() == 8
    r = robustness.sign_consistency(df, nb).first()
    assert (r.pairs, r.matching, r.sign_consistency) == (4, 2, 0.5)
    assert {(x.fast, x.slow, x.n_fast, x.n_slow) for x in robustness.sign_flip_pairs(nb).collect()} == {
        (2, 5, 2, 9), (2, 9, 3, 9)}
    base = robustness.baseline_neighbors(nb, (2, 5)).collect()
    assert {(x.n_fast, x.n_slow, x.n_return) for x in base} == {(3, 5, 0.2), (2, 9, -0.1)}
    iso = {(x.fast, x.slow): x for x in robustness.isolated_cells(nb).collect()}
    assert iso[2, 5].threshold == pytest.approx(2 * (0.2 + 0.1 + 0.2 + 0.1) / 4)
    assert not any(x.isolated for x in iso.values())
    alone = robustness.grid_neighbors(df.where("fast = 2 and slow = 5"), [2, 3], [5, 9])
    assert robustness.sign_consistency(df, alone).first().sign_consistency == 1.0


def test_leave_one_out_by_hand(spark):
    df = spark.createDataFrame([("X", 2021, 0.5), ("X", 2022, -0.2), ("X", 2023, -0.2)],
                               "symbol string, window int, window_return double")
    rows = {r.window: r for r in robustness.leave_one_out(df, ["symbol"]).collect()}
    full = 1.5 * 0.8 * 0.8 - 1
    assert rows[2021].full_aggregate == pytest.approx(full)
    assert rows[2021].without == pytest.approx(-0.36) and not rows[2021].sign_flip
    assert rows[2022].without == pytest.approx(0.2) and rows[2022].sign_flip
    assert rows[2022].largest_change == pytest.approx(max(abs(-0.36 - full), abs(0.2 - full)))


def test_sealed_rows_do_not_matter(study):
    bars, *_ = study
    splits = [("train", "2020-01-01", "2022-01-01"), ("validation", "2022-01-01", "2023-01-01"), ("test", "2023-01-01", "2024-01-01")]
    _, windows = timeline.build_windows(2020, [2021, 2022])
    spoiled = bars.withColumn("close", F.when(F.year("ts") >= 2023, -9.0).otherwise(F.col("close")))

    def result(df):
        panel = signals.signal_panel(timeline.research_filter(df, splits), GRID)
        return sorted(map(tuple, robustness.grid_returns(panel, ledger.runs(GRID), windows).collect()))

    assert result(bars) == result(spoiled)
