"""Interval and as-of joins against plain loops; plans without nested loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tapecheck.operators import blocks, intervals

T0 = datetime(2020, 1, 1)
at = lambda minutes: T0 + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(4)
    rows = [(rng.choice("AAAAAB"), at(rng.randint(0, 3000)), float(i)) for i in range(1200)]
    rows += [("A", at(1500), float(i)) for i in range(300)]  # many at one time
    spans = []
    for i in range(400):
        a = rng.randint(-100, 3000)
        spans.append((rng.choice("ABC"), i, at(a), at(a + rng.choice([-5, 0, 1, 7, 60, 500, 5000]))))
    rows_df = spark.createDataFrame([*rows, ("A", None, 1.0), (None, at(3), 2.0)], "symbol string, ts timestamp_ntz, v double")
    spans_df = spark.createDataFrame([*spans, ("A", 900, None, at(9))], "symbol string, window int, start timestamp_ntz, end timestamp_ntz")
    return rows, spans, rows_df.cache(), spans_df.cache()


def test_interval_join(market):
    rows, spans, rows_df, spans_df = market
    out = intervals.rows_in_windows(rows_df, spans_df)
    got = sorted((r.symbol, r.ts, r.v, r.window) for r in out.collect())
    assert got == sorted((s, t, v, n) for s, t, v in rows for k, n, a, b in spans if s == k and a <= t < b)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_closed_on_the_right(market, spark):
    rows, spans, rows_df, spans_df = market
    got = sorted((r.v, r.window) for r in intervals.interval_join(rows_df, spans_df, closed="right").collect())
    assert got == sorted((v, n) for s, t, v in rows for k, n, a, b in spans if s == k and a < t <= b)
    assert intervals.interval_join(rows_df, spans_df.limit(0)).count() == 0


def test_microseconds_count(spark):
    rows = spark.createDataFrame([("A", T0 + timedelta(microseconds=i)) for i in range(10)], "symbol string, ts timestamp_ntz")
    spans = spark.createDataFrame([("A", T0 + timedelta(microseconds=3), T0 + timedelta(microseconds=5))], "symbol string, start timestamp_ntz, end timestamp_ntz")
    assert sorted(r.ts.microsecond for r in intervals.interval_join(rows, spans).collect()) == [3, 4]


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("chunk_rows", [5, 4096])
def test_as_of(market, spark, strict, chunk_rows):
    rows, _, rows_df, _ = market
    rng = random.Random(8)
    points = [(rng.choice("ABC"), at(rng.randint(-50, 3100)), i) for i in range(500)] + [("A", at(1500), 501), ("A", at(1500), 501), ("A", None, 502), (None, at(9), 503)]
    asked = spark.createDataFrame(points, "symbol string, ts timestamp_ntz, id int")
    out = intervals.as_of(asked, rows_df, ["v"], strict=strict, chunk_rows=chunk_rows).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    got = sorted(((r.symbol, r.ts, r.id, r.as_of_ts, r.v, r.status) for r in out), key=key)
    want = []
    for s, t, i in points:
        before = [(x, v) for k, x, v in rows if s == k and t is not None and (x < t or (x == t and not strict))]
        want.append((s, t, i, *(max(before) if before else (None, None)), "ok" if before else "no_earlier_row"))
    assert got == sorted(want, key=key)


def test_labels_keep_every_row(market, spark):
    rows, _, rows_df, _ = market
    splits = [("A", 0, "train", at(100), at(900)), ("A", 1, "test", at(900), at(2000)), ("B", 0, "train", at(0), at(50))]
    table = spark.createDataFrame(splits, "symbol string, position int, name string, start timestamp_ntz, end_exclusive timestamp_ntz")
    got = sorted((r.v, r.split or "") for r in intervals.labels(rows_df.where("symbol is not null and ts is not null"), table).collect())
    assert got == sorted((v, next((n for k, _, n, a, b in splits if k == s and a <= t < b), "")) for s, t, v in rows)
    kept = intervals.allowed_rows(rows_df, table, ["train"])
    assert kept.columns == rows_df.columns
    assert sorted(r.v for r in kept.collect()) == sorted(v for s, t, v in rows if any(k == s and a <= t < b and n == "train" for k, _, n, a, b in splits))


def test_places_are_without_gaps_at_any_density(spark):
    """A day with a thousand times the ticks of others, one symbol with nearly all rows."""
    rows = spark.range(5000).select(
        F.when(F.col("id") % 50 == 0, "B").otherwise("A").alias("symbol"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(if(id % 10 = 0, cast(id as int), 0), 0, 0, id / 1000000)").alias("ts"),
    ).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a series spans partitions
    try:
        got = blocks.numbered(rows, ["symbol"]).cache()
        parts = got.groupBy("symbol", F.spark_partition_id()).count().groupBy("symbol").count()
        assert parts.agg(F.max("count")).first()[0] > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for symbol in "AB":
        mine = sorted((r.ts, r.idx) for r in got.where(F.col("symbol") == symbol).collect())
        assert [i for _, i in mine] == list(range(len(mine)))
    chunks = blocks.with_blocks(rows, blocks.Positions(100, 10)).groupBy("symbol", "chunk").count()
    assert chunks.agg(F.max("count")).first()[0] == 100


def test_intervals_are_not_broadcast(market):
    """Their estimated size does not say how they multiply, so even a small table of them is merged."""
    _, _, rows_df, spans_df = market
    met = intervals.interval_join(rows_df, spans_df)
    joins = [x for x in met._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "__bin" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_bounds_of_many_windows_are_looked_up_once(spark, monkeypatch):
    rng = random.Random(3)
    windows = [("A", i, at(rng.randint(0, 9)), at(rng.randint(0, 9))) for i in range(500)] + [("A", 500, None, at(5)), ("A", 500, None, at(5))]
    trips = [("A", at(a), at(a + n)) for a in range(-2, 10) for n in (0, 1, 4)]
    sent = []
    join = intervals.interval_join
    monkeypatch.setattr(intervals, "interval_join", lambda rows, *a, **k: sent.append(rows.count()) or join(rows, *a, **k))
    out = intervals.crossing_trips(
        spark.createDataFrame(trips, "symbol string, entry_ts timestamp_ntz, exit_ts timestamp_ntz"),
        spark.createDataFrame(windows, "symbol string, window int, start timestamp_ntz, end timestamp_ntz"), ["symbol"],
    )
    want = {(n, a, z) for _, n, *bounds in windows for _, a, z in trips if any(b and a < b <= z for b in bounds)}
    got = [(r.window, r.entry_ts, r.exit_ts) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert sent[0] <= 11
