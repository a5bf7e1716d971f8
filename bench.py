"""Headline queries, timed. Prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. Every timed run
executes the whole query (all rows and columns, through a sink that drops them).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def supplier_panel(spark, sf):
    """1,000 symbols at sf0.1, all cells."""
    from tapecheck.operators import signals
    from tapecheck.operators.blocks import DAILY, materialize
    from tapecheck.operators.timeline import research_filter
    from tapecheck.plans import workload

    bars = research_filter(workload.bars(spark, sf, "l_suppkey"), workload.SPLITS)
    return materialize(signals.signal_panel(bars, signals.cells(), layout=DAILY))


def grid_returns(spark, sf):
    from tapecheck.operators import ledger, robustness, signals
    from tapecheck.plans.queries import WINDOWS

    return robustness.grid_returns(supplier_panel(spark, sf), ledger.runs(signals.cells()), WINDOWS)


def grid_curves(spark, sf):
    from tapecheck.operators import ledger, signals

    return ledger.equity_curve(supplier_panel(spark, sf), ledger.runs(signals.cells()))


def window_metrics(spark, sf):
    from tapecheck.operators import ledger, metrics, signals
    from tapecheck.plans.queries import WINDOWS

    panel = supplier_panel(spark, sf)
    book = [r for r in ledger.runs(signals.cells()) if (r.fast, r.slow) == (10, 30)]
    trips = ledger.round_trips(ledger.fill_ledger(panel, book))
    return metrics.window_metrics(ledger.equity_curve(panel, book), trips, WINDOWS)


def revision_counts(spark, sf):
    from tapecheck.operators import revision
    from tapecheck.plans import workload

    raw = workload.raw_candles(workload.bars(spark, sf, "l_suppkey"))
    baseline = workload.baseline_copy(raw)
    return revision.revision_counts(baseline, workload.audit_copy(raw), workload.reference_days(baseline))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "20g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from tapecheck.plans.queries import REGISTERED

    timed = {
        "grid_returns_by_supplier": grid_returns,
        "grid_curves_by_supplier": grid_curves,
        "window_metrics_by_supplier": window_metrics,
        "revision_counts_by_supplier": revision_counts,
    } | {
        n: REGISTERED[n]
        for n in (
            "bars_from_ticks", "ohlcv_violations", "crossover_signal", "fill_ledger", "equity_curve",
            "aggregate_metrics", "cost_stress", "ledger_reconcile", "calendar_gaps", "decode_candles",
            "latest_artifact", "registry_violations",
        )
    }
    spark.range(1).count()
    seconds = {}
    for name, query in timed.items():
        begin = time.perf_counter()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
