"""Clustered storage without exchanges, streams with state, exact medians."""

import random
import re
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from walks import random_walk
from tapecheck.plans import queries, workload
from tapecheck.operators import order_statistics, signals
from tapecheck.operators.blocks import STORED, Layout
from tapecheck.sources import bars as bar_tables
from tapecheck.streaming.averages import averages_stream

BAR = "symbol string, ts timestamp_ntz, close double"


@pytest.fixture(scope="module")
def bars(spark):
    rows = random_walk(400, 1, "A", gap_every=9) + random_walk(90, 2, "B") + random_walk(3, 3, "C")
    df = spark.createDataFrame([(s, datetime(2020, 1, 1) + timedelta(days=d), o, c) for s, d, o, c, _ in rows],
                               "symbol string, ts timestamp_ntz, open double, close double")
    return df.withColumns({"high": F.greatest("open", "close"), "low": F.least("open", "close"), "volume": F.lit(1.0)}).cache()


def _rows(df):
    return sorted((r.symbol, r.ts, r.fast_ema, r.slow_ema, r.signal) for r in df.collect())


def _same(got, want):
    assert [g[:2] + g[4:] for g in got] == [w[:2] + w[4:] for w in want]
    for g, w in zip(got, want):
        for a, b in zip(g[2:4], w[2:4]):
            assert a == b if a is None or b is None else a == pytest.approx(b, rel=1e-12)


def test_stored_bars_are_not_exchanged(spark, bars, tmp_path):
    layout = Layout(block_bars=8, chunk_blocks=4)
    stored = bar_tables.write_clustered(bars, "clustered_bars_test", str(tmp_path / "t"), 5, layout)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = signals.crossover_signal(stored, 3, 9, layout=STORED)
        plan = out._jdf.queryExecution().executedPlan().toString()
        _same(_rows(out), _rows(signals.crossover_signal(bars, 3, 9, layout=layout)))
        # Bars are not dealt by chunk again, as they are without clusters; what moves are summaries of chunks.
        by_chunk = re.compile(r"hashpartitioning\(symbol#\d+, chunk#\d+L, \d+\), REPARTITION")
        other = signals.crossover_signal(bars, 3, 9, layout=layout)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and not by_chunk.search(plan) and by_chunk.search(other)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS clustered_bars_test")


def test_any_cut_into_batches_and_a_restart_change_nothing(spark, bars, tmp_path):
    rows = sorted((r.ts, r.symbol, r.close) for r in bars.collect())
    source, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    cuts = [0, 7, 8, 150, 151, 300, len(rows)]

    def run():
        stream = spark.readStream.schema(BAR).option("maxFilesPerTrigger", 1).parquet(source)
        query = (
            averages_stream(stream, 3, 9).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        query.awaitTermination(300)

    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = [(s, t, c) for t, s, c in rows[a:b]]
        if i == 3:
            part.append(("A", datetime(2019, 1, 1), 1e9))  # comes too late
        spark.createDataFrame(part, BAR).coalesce(1).write.mode("append").parquet(source)
        if i in (2, 5):
            run()  # stopped and started again between
    found = spark.read.parquet(out)
    assert [(r.symbol, r.close, r.fast_ema, r.signal) for r in found.where("late").collect()] == [("A", 1e9, None, None)]
    want = signals.crossover_signal(bars, 3, 9)
    _same(_rows(found.where("not late")), _rows(want))
    by = sorted((r.symbol, r.ts, r.signal, r.target) for r in found.where("not late").collect())
    for (s, _, signal, _), (t, _, _, target) in zip(by, by[1:]):
        assert target == (signal if s == t else 0)


def test_medians(spark, monkeypatch):
    monkeypatch.setattr(order_statistics, "CHUNK_VALUES", 7)
    rng = random.Random(3)
    rows = [("hot", float(rng.randint(-50, 50))) for _ in range(901)] + [("even", float(i)) for i in (4, 1, 9, 2)]
    rows += [("same", 2.5)] * 400 + [("one", -1.0), ("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r["count"], r.median) for r in order_statistics.exact_median(df, "v", ["k"]).collect()}
    values = {k: [v for x, v in rows if x == k and v is not None] for k, _ in rows}
    assert got == {k: (len(v), statistics.median(v)) for k, v in values.items() if v}
    assert order_statistics.exact_median(df, "v").first().median == statistics.median([v for _, v in rows if v is not None])
    assert order_statistics.exact_median(df.limit(0), "v").count() == 0


def test_parts_of_the_stream_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    """A part of the history is one batch, but not one file: no task writes all of it."""
    monkeypatch.setattr(queries, "new_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(queries, "_supplier_bars", lambda s, sf: workload.bars(s, sf, "l_suppkey").repartition(3))
    got = queries.crossover_signal_stream(spark, "/root/testdata/sf0.001")
    assert got.count() == workload.bars(spark, "/root/testdata/sf0.001", "l_suppkey").count()
    assert len(spark.read.parquet(f"{tmp_path}/bars").inputFiles()) == 12
