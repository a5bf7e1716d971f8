"""Averages, signals and positions of a stream of bars, with state kept from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapecheck.operators.signals import check_cell

_STATE = "bars long, ts long, close double, fast_gap double, slow_gap double, signal int"
_OUT = "symbol string, ts timestamp_ntz, close double, fast_ema double, slow_ema double, signal int, target int, late boolean"


def averages_stream(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    """Every bar of a stream ``symbol, ts, close`` with both averages, its signal and the position to hold on it.

    State is one small row for each symbol (number of bars, last time and close, distance of both averages, last signal), so a
    restart from the checkpoint goes on where it stopped, and any cut of the bars into batches gives what
    :func:`tapecheck.operators.signals.crossover_signal` gives for all at once. Averages are NULL in warm-up. A bar that is
    not newer than the newest seen before of its symbol cannot be taken back into an average: it is returned as ``late``, without values,
    and changes nothing; of bars at one time in one batch the first counts. Rows without symbol, time or close are left out.
    """
    check_cell(fast, slow)
    keep = {p: (p - 1) / (p + 1) for p in (fast, slow)}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, close, fast_gap, slow_gap, signal = state.get if state.exists else (0, None, 0.0, 0.0, 0.0, 0)
        given = list(batches)
        rows = (given[0] if len(given) == 1 else pd.concat(given)).sort_values("ts", kind="stable")
        out = []
        # Plain numbers: a boxed time a row costs more than the averages.
        for at, price in zip(rows["ts"].to_numpy("datetime64[ns]").astype("int64").tolist(), rows["close"].tolist()):
            if last is not None and at <= last:
                out.append((None, None, None, None, True))
                continue
            if n:
                fast_gap, slow_gap = keep[fast] * (fast_gap + price - close), keep[slow] * (slow_gap + price - close)
            n, last, close, target = n + 1, at, price, signal
            quick = price - fast_gap if n >= fast else None
            calm = price - slow_gap if n >= slow else None
            signal = int(calm is not None and quick > calm)
            out.append((quick, calm, signal, target, False))
        state.update((n, last, close, fast_gap, slow_gap, signal))
        quick, calm, signals, targets, late = zip(*out)
        yield pd.DataFrame({
            "symbol": key[0], "ts": rows["ts"].array, "close": rows["close"].array,
            "fast_ema": pd.array(quick, "Float64"), "slow_ema": pd.array(calm, "Float64"),
            "signal": pd.array(signals, "Int32"), "target": pd.array(targets, "Int32"), "late": late,
        })

    known = bars.where("symbol is not null and ts is not null and close is not null").select("symbol", "ts", "close")
    return known.groupBy("symbol").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
