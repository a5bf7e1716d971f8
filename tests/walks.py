"""Seeded series and a bar-by-bar simulation to compare with."""


def series(opens, closes, signal=None, days=None, symbol="X"):
    signal = signal or [0] * len(opens)
    days = days or range(len(opens))
    return [(symbol, d, o, c, s) for d, o, c, s in zip(days, opens, closes, signal)]


def random_walk(n, seed, symbol="X", gap_every=0):
    """Seeded bars with occasional missing days."""
    import numpy as np

    rng = np.random.default_rng(seed)
    close = 100 * np.cumprod(1 + rng.normal(0, 0.02, n))
    opens = np.concatenate([[100.0], close[:-1] * (1 + rng.normal(0, 0.002, n - 1))])
    days, d = [], 0
    for i in range(n):
        d += 1 + (3 if gap_every and i % gap_every == 0 else 0)
        days.append(d)
    return [(symbol, d, float(o), float(c), 0) for d, o, c in zip(days, opens, close)]


def simulate(opens, closes, signal, commission, slippage, cash):
    """Bar by bar, for comparison: fills and equity."""
    target = [0, *signal[:-1]]
    units, held, trades, equity = 0.0, 0, [], []
    for i, (o, c) in enumerate(zip(opens, closes)):
        if target[i] != held:
            if target[i]:
                price = o * (1 + slippage)
                units = cash / (price * (1 + commission))
                fee, qty, cash, side = units * price * commission, units, 0.0, "buy"
            else:
                price = o * (1 - slippage)
                qty, fee, side = units, units * price * commission, "sell"
                cash, units = units * price - fee, 0.0
            held = target[i]
            trades.append((i, side, price, qty, fee, cash, units))
        equity.append(cash + units * c)
    return trades, equity
