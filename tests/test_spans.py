"""Tiny spans, so that all three levels of a series are combined."""

import pytest
from pyspark.sql import functions as F
from tapecheck.operators import blocks
from test_metrics import (  # noqa: F401
    study,
    test_curve_and_aggregate_metrics,
    test_window_metrics,
)
from test_panel import (  # noqa: F401
    LAYOUTS,
    test_averages_match_the_recursion,
    test_given_signal_is_shifted_across_chunks,
    test_ledger_and_curve_match_a_loop,
    walks,
)


@pytest.fixture(autouse=True, scope="module")
def tiny_spans():
    before, blocks.SPAN_CHUNKS = blocks.SPAN_CHUNKS, 3
    yield
    blocks.SPAN_CHUNKS = before


def test_earlier_totals(spark):
    df = spark.range(20).select(F.lit("X").alias("k"), (F.col("id") * 2 - 7).alias("chunk"), (F.col("id") + 1).alias("v"))
    out = blocks.with_earlier(df, ["k"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "p": ("product", F.lit(2.0))})
    rows = sorted(out.collect(), key=lambda r: r.chunk)
    assert [r.s for r in rows] == [i * (i + 1) // 2 for i in range(20)]
    assert [r.m for r in rows] == [None, *range(1, 20)]
    assert [r.p for r in rows] == [2.0**i for i in range(20)]
