"""Registered queries against DuckDB on the given tables.

A spread of queries by default; set TAPECHECK_ALL=1 for every one.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = (
    "scan_bars flatten_pages registry_scan latest_artifact ohlcv_violations gap_metadata_violations split_violations "
    "plan_windows decode_rejects revision_counts crossover_signal equity_curve window_metrics grid_returns ledger_reconcile"
).split()
NAMES = sorted(entry_points.oracle_sql()) if os.environ.get("TAPECHECK_ALL") else SOME


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _clean(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(name, spark, duck):
    df = entry_points.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(_clean(r[c]) for c in columns) for r in df.collect()]
    rel = duck.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = [tuple(_clean(r[names.index(c)]) for c in columns) for r in rel.fetchall()]
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)


def test_every_check_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 3


def test_flagship_never_reads_sealed_rows(spark, tmp_path):
    """Other prices in the sealed split, and bad ones, change nothing."""
    from pyspark.sql import functions as F

    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    sealed = F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz")
    items.withColumn("l_extendedprice", F.when(sealed, -1e9).otherwise(F.col("l_extendedprice"))).write.parquet(str(tmp_path / "lineitem.parquet"))
    run = lambda sf: sorted(map(tuple, entry_points.queries()["flagship"](spark, sf).collect()))
    assert run(str(tmp_path)) == run(SF)
