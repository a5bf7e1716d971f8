import pytest
from walks import random_walk
from pyspark.sql import functions as F
from tapecheck.operators import ledger, reconcile, signals
from tapecheck.streaming.bars import bars_from_ticks, closed_bars_stream

TICKS = "symbol string, ts timestamp_ntz, px double, qty double, seq struct<t:timestamp_ntz,i:int>"


def _ticks(spark):
    rows = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "B").otherwise("A").alias("symbol"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_interval(0,0,0,0,0,id * 15)")).alias("ts"),
        (100 + F.col("id") % 17 * 1.5).alias("px"), F.lit(2.0).alias("qty"), F.col("id").cast("int").alias("i"),
    )
    return rows.select("symbol", "ts", "px", "qty", F.struct(F.col("ts").alias("t"), "i").alias("seq"))


def test_stream_emits_only_closed_days(spark, tmp_path):
    ticks = _ticks(spark)
    ticks.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TICKS).parquet(str(tmp_path / "in"))
    query = (
        closed_bars_stream(stream).writeStream.outputMode("append").format("memory").queryName("closed_bars")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {(r.symbol, str(r.ts)[:10]): tuple(r)[2:] for r in spark.table("closed_bars").collect()}
    want = {(r.symbol, str(r.ts)[:10]): tuple(r)[2:] for r in bars_from_ticks(ticks).collect()}
    last = max(d for _, d in want)
    assert got == {k: v for k, v in want.items() if k[1] != last}
    assert len(got) == 2 * 4


@pytest.fixture(scope="module")
def two(spark):
    df = spark.createDataFrame(random_walk(200, 9), "symbol string, day int, open double, close double, signal int")
    bars = df.withColumn("ts", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day")).cast("timestamp_ntz"))
    panel = signals.signal_panel(bars, [(2, 5)]).cache()
    book = ledger.runs([(2, 5)])
    left, right = ledger.fill_ledger(panel, book).cache(), reconcile.event_ledger(panel, book).cache()
    amount = F.when(F.col("side") == "buy", F.col("units_after")).otherwise(F.col("cash_after"))
    return (left, right, reconcile.final_equity(panel, left, book, amount, ["symbol"]).cache(),
            reconcile.final_equity(panel, right, book, F.col("amount_after"), ["symbol"]).cache())


def test_independent_ledgers_agree(two):
    assert reconcile.divergences(*two).count() == 0
    r = reconcile.ledger_reconcile(*two).first()
    assert r.left_trades == r.right_trades > 5 and r.equity_agrees and r.return_agrees


def test_each_divergence_is_reported(two):
    left, right, a, b = two
    third = sorted(r.ts for r in right.collect())[2]
    fields = lambda *args: {r.field for r in reconcile.divergences(*args).collect()}
    later = right.withColumn("ts", F.when(F.col("ts") == F.lit(third), F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts")))
    assert fields(left, later, a, b) == {"entry_dates"}
    dear = right.withColumn("price", F.when(F.col("ts") == F.lit(third), F.col("price") * (1 + 2e-9)).otherwise(F.col("price")))
    assert fields(left, dear, a, b) == {"execution_price"}
    near = right.withColumn("price", F.col("price") * (1 + 5e-10))
    assert fields(left, near, a, b) == set()
    assert "execution_price_count" in fields(left, right.where(F.col("ts") != F.lit(third)), a, b)
    rich = b.withColumns({"final_equity": F.col("final_equity") * 1.01, "total_return": F.col("total_return") + 0.01})
    assert fields(left, right, a, rich) == {"final_equity", "total_return"}
