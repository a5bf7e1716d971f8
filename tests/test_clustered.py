"""Panels over ticks that are exchanged and sorted once."""

import __spark_entry__ as entry_points
import pytest
from pyspark.sql import functions as F
from tapecheck.operators import signals
from tapecheck.operators.blocks import Layout, Stored
from tapecheck.plans import workload as w
from tapecheck.streaming.bars import bars_from_ticks, clustered_bars

SF = "/root/testdata/sf0.001"
SMALL = Layout(block_bars=4, chunk_blocks=4)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("tasks", [None, 9])
def test_same_panel_as_from_bars(spark, tasks):
    ticks = w.ticks(spark, SF, "l_suppkey")
    want = signals.signal_panel(bars_from_ticks(ticks), [(2, 5), (3, 9)], layout=SMALL)
    got = signals.signal_panel(clustered_bars(ticks, SMALL, tasks), [(2, 5), (3, 9)], layout=Stored(SMALL.block_bars))
    rows = lambda df: sorted(map(tuple, df.select(*want.columns).collect()))
    assert rows(got) == rows(want) and got.count() > 1000


def test_ticks_are_exchanged_once(spark):
    """Transitions read the ticks twice, and exchanged them and their bars in both readings."""
    df = entry_points.queries()["signal_transitions"](spark, SF)
    df.collect()
    final = _plan(df).split("Initial Plan")[0]
    assert final.count("Scan parquet") == 1


def test_tasks_grow_with_the_ticks(spark, monkeypatch):
    """A fixed number of partitions held ever more ticks each."""
    ticks = w.table(spark, SF, "lineitem").count()
    assert w.tasks(spark, SF) is None
    monkeypatch.setattr(w, "FEW_TICKS", 100)
    monkeypatch.setattr(w, "TASK_TICKS", 500)
    assert w.tasks(spark, SF) == -(-ticks // 500) > 4
    bars = w.bars_by_chunk(spark, SF, "l_suppkey", SMALL)
    assert bars.rdd.getNumPartitions() == -(-ticks // 500)
    names = ("signal_transitions", "window_metrics_by_supplier", "divergences_unequal")
    for name in names:
        few = entry_points.queries()[name](spark, SF)
        monkeypatch.setattr(w, "FEW_TICKS", 10**9)
        many = entry_points.queries()[name](spark, SF)
        monkeypatch.setattr(w, "FEW_TICKS", 100)
        key = lambda df: sorted(map(str, df.collect()))
        assert key(few) == key(many)
