"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Numbers that come out of long floating-point chains are rounded (ratios to 8
places, money to 4) so that results can be compared by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapecheck.constants import (
    BASELINE_CELL,
    COST_SCENARIOS,
    FAST_PERIODS,
    INITIAL_CASH,
    SLOW_PERIODS,
    SPOT_CHECKS,
)
from tapecheck.functions.decimals import normal_form
from tapecheck.operators import (
    candles,
    indicators,
    intervals,
    ledger,
    metrics,
    order_statistics,
    quality,
    reconcile,
    revision,
    robustness,
    signals,
    timeline,
)
from tapecheck.operators.blocks import DAILY, STORED, Layout, Positions, Stored, materialize, new_folder
from tapecheck.plans import workload as w
from tapecheck.sources import bars as bar_tables
from tapecheck.sources import catalog as catalogs
from tapecheck.sources import digest as digests
from tapecheck.sources import lineage as lineages
from tapecheck.sources import pages as page_tables
from tapecheck.sources import publish as publishing
from tapecheck.sources import registry as registries
from tapecheck.streaming.averages import averages_stream
from tapecheck.streaming.bars import bars_from_ticks

RUN = ("symbol", *ledger.RUN_KEYS)
BURN_IN, WINDOWS = timeline.build_windows(w.BURN_IN_YEAR, w.EVALUATION_YEARS)
START, END = WINDOWS[0].start, WINDOWS[-1].end
GRID = signals.cells()


def _round(df: DataFrame, ratios: str = "", money: str = "") -> DataFrame:
    places = {c: 8 for c in ratios.split()} | {c: 4 for c in money.split()}
    # Adding zero turns a negative zero into a plain one.
    return df.withColumns({c: F.round(F.col(c), n) + 0.0 for c, n in places.items()})


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    return w.bars(spark, sf)


def _research(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.research_filter(_bars(spark, sf), w.SPLITS)


def _panel(spark: SparkSession, sf: str, grid=(BASELINE_CELL,), symbol="l_returnflag", layout=DAILY) -> DataFrame:
    source = timeline.research_filter(w.bars(spark, sf, symbol), w.SPLITS)
    return materialize(signals.signal_panel(source, list(grid), layout=layout))


#: Chunks of 1,024 days: a series of the given tables spans three of them, of some two hundred bars each. (Chunks of 64 days held
#: a dozen bars, so the work on chunks was as large as that on bars.)
SMALL = Layout(block_bars=64, chunk_blocks=16)


def _wide_panel(spark: SparkSession, sf: str, grid=(BASELINE_CELL,), symbol="l_suppkey", layout=SMALL) -> DataFrame:
    """The panel of many symbols (suppliers, parts) with few ticks a day."""
    source = timeline.research_filter(w.bars_by_chunk(spark, sf, symbol, layout), w.SPLITS)
    return materialize(signals.signal_panel(source, list(grid), layout=Stored(layout.block_bars)))


def _wide_curve(spark: SparkSession, sf: str, panel: DataFrame) -> DataFrame:
    return ledger.equity_curve(panel, _book(), tasks=w.tasks(spark, sf))


def _book(grid=(BASELINE_CELL,), costs=None):
    return ledger.runs(list(grid), costs)


def _supplier_bars(spark: SparkSession, sf: str) -> DataFrame:
    return w.bars(spark, sf, "l_suppkey")


# --- sources ------------------------------------------------------------------


def scan_bars(spark, sf):
    path = new_folder(spark) + "/bars"
    padded = F.lpad(F.col("l_linenumber").cast("string"), 5, "0")
    bar_tables.write_bars(w.bars(spark, sf, padded), path, "acme")
    return bar_tables.scan_bars(spark, path)


def research_rows(spark, sf):
    items = bar_tables.research_rows(spark, f"{sf}/lineitem.parquet", w.RESEARCH_CUTOFF, "l_shipdate")
    return items.select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")


def cutoff_violations(spark, sf):
    """Three truncated tables against the same cutoff: sound, truncated later, and empty."""
    read = lambda cutoff: bar_tables.research_rows(spark, f"{sf}/lineitem.parquet", cutoff, "l_shipdate")
    cases = {"sound": "2000-01-01", "late": w.RESEARCH_CUTOFF, "empty": "1900-01-01"}
    found = [
        bar_tables.cutoff_violations(read(cutoff), "2000-01-01", "l_shipdate").select(F.lit(name).alias("case"), "rule")
        for name, cutoff in cases.items()
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


def research_lineage(spark, sf):
    parent, target = (f"{new_folder(spark)}/{name}" for name in ("parent", "research"))
    _bars(spark, sf).write.parquet(parent)
    _, recorded = digests.digest_of(spark.read.parquet(parent))
    lineage = bar_tables.derive_research(spark, parent, target, w.RESEARCH_CUTOFF, recorded)
    # Digests of prices follow Spark's way to write a double; research_verified has them in full.
    return lineage.drop("content_digest").withColumn("source_processed_sha256", F.lit("parent"))


def snapshot_metadata(spark, sf):
    return bar_tables.snapshot_metadata(_supplier_bars(spark, sf))


def _pages(spark, sf):
    return w.request_pages(w.raw_candles(_bars(spark, sf)))


def flatten_pages(spark, sf):
    path = new_folder(spark) + "/pages"
    w.artifacts(_pages(spark, sf)).write.json(path)
    flat = page_tables.flatten_pages(page_tables.read_artifacts(spark, path))
    return flat.drop("started_at_utc")


def artifact_counts(spark, sf):
    return page_tables.artifact_counts(w.artifacts(_pages(spark, sf)))


def page_schema_violations(spark, sf):
    return page_tables.page_schema_violations(
        w.page_documents(_pages(spark, sf)), ["product", "page_no"], products=("A", "N", "R")
    )


def registry_scan(spark, sf):
    path = new_folder(spark) + "/registry"
    records = w.registry_records(spark, sf)
    bad = quality.registry_violations(records).select("experiment_id").distinct()
    registries.append_records(records.join(bad, "experiment_id", "left_anti"), path)
    return registries.registry_scan(spark, path)


def artifact_audit(spark, sf):
    pages = w.table(spark, sf, "pages")
    found = catalogs.hash_rows(pages.where("page_id % 17 != 0"), F.col("page_id").cast("string"), F.col("html"))
    recorded = pages.where("page_id % 19 != 0").select(
        F.col("page_id").cast("string").alias("path"),
        F.sha2(F.when(F.col("page_id") % 10 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")), 256).alias("sha256"),
    )
    return catalogs.artifact_audit(found, recorded)


def latest_artifact(spark, sf):
    return catalogs.latest_artifact(w.catalog(spark, sf))


def lineage_join(spark, sf):
    return catalogs.lineage_join(w.catalog(spark, sf))


def identity_violations(spark, sf):
    return catalogs.identity_violations(w.catalog(spark, sf))


def new_artifacts(spark, sf):
    known = w.catalog(spark, sf)
    return catalogs.new_artifacts(known.where("created_at_utc < '2000-01-01'"), known)


def registry_violations(spark, sf):
    return quality.registry_violations(w.registry_records(spark, sf))


def registry_migrate(spark, sf):
    return registries.registry_migrate(w.old_registry(spark, sf))


def table_digests(spark, sf):
    """Orders by status: digests over rows that arrive in another order than they lie in the file."""
    orders = w.table(spark, sf, "orders").drop("o_totalprice").repartition(7, "o_custkey")
    return digests.table_digest(orders, ["o_orderstatus"])


def digest_violations(spark, sf):
    """A copy in which some customers' orders changed, went missing or came twice."""
    orders = w.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    copies = F.when(k % 997 == 5, F.array(F.lit(1), F.lit(2))).when((k % 991 == 7) | (c % 50 == 3), F.array().cast("array<int>"))
    copy = orders.select(
        "o_custkey", "o_orderkey",
        F.when(k % 983 == 11, "changed").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.explode(copies.otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")
    recorded = digests.table_digest(orders.where("o_custkey % 40 != 9"), ["o_custkey"])
    return digests.digest_violations(copy, recorded, ["o_custkey"])


def research_verified(spark, sf):
    """A truncated copy of the orders, derived only because its parent still is what was recorded."""
    parent, target = (f"{new_folder(spark)}/{name}" for name in ("parent", "research"))
    w.order_events(spark, sf).write.parquet(parent)
    _, recorded = digests.digest_of(spark.read.parquet(parent))
    return bar_tables.derive_research(spark, parent, target, w.RESEARCH_CUTOFF, recorded)


def lineage_closure(spark, sf):
    return lineages.lineage_closure(w.derivations(spark, sf))


def registry_batches(spark, sf):
    """Three deliveries of records in batches; the later ones repeat earlier batches, some are bad."""
    root = new_folder(spark)
    records = w.batched_records(spark, sf)
    number = F.col("number")
    said = [
        registries.append_batches(records.where(part).drop("number"), root).withColumn("delivery", F.lit(i))
        for i, part in enumerate((number % 3 == 0, number % 2 == 0, number % 5 != 1))
    ]
    kept = publishing.visible(spark, root).groupBy("batch_id").agg(F.count("*").alias("kept"))
    out = said[0].unionByName(said[1]).unionByName(said[2])
    return out.join(kept, "batch_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


def published_rows(spark, sf):
    """The visible version of a table of bars by product: sound products once, whatever was tried how often."""
    root = new_folder(spark)
    raw = w.faulty_candles(_stored(w.raw_candles(w.bars(spark, sf, "l_partkey"))))
    decoded = materialize(candles.decode_candles(raw.withColumn("now", F.col("now") + F.expr("INTERVAL 2 DAYS"))))
    for _ in range(2):
        candles.publish_sound(decoded, root)
    return publishing.visible(spark, root).groupBy("symbol").agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# --- quality, timeline ----------------------------------------------------------


def canonical_bars(spark, sf):
    items = w.table(spark, sf, "lineitem")
    provider = items.select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("Open"),
        F.col("l_extendedprice").alias("High"),
        F.col("l_discount").alias("Low"),
        F.col("l_tax").alias("Close"),
        F.col("l_quantity").alias("Volume"),
        F.col("l_tax").alias("Adj Close"),
        F.lit(0.0).alias("Dividends"),
    )
    return quality.canonical_bars(provider)


def ohlcv_violations(spark, sf):
    return quality.ohlcv_violations(w.faulty_bars(spark, sf), arrival="seq")


def corporate_actions(spark, sf):
    return quality.corporate_actions(w.actions(_supplier_bars(spark, sf)), "1995-01-01", "2001-01-01")


def gap_metadata_violations(spark, sf):
    bars = _supplier_bars(spark, sf)
    gaps = timeline.calendar_gaps(bars, w.last_days(bars))
    return quality.gap_metadata_violations(w.gap_metadata(gaps, bars.select("symbol").distinct()))


def split_rows(spark, sf):
    return timeline.split_rows(_bars(spark, sf), w.SPLITS).select("symbol", "ts", "close", "split")


def split_label(spark, sf):
    orders = w.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    return timeline.split_label(orders, w.SPLITS[:2])


def research_filter(spark, sf):
    return _research(spark, sf)


def split_violations(spark, sf):
    return timeline.split_violations(w.split_tables(_supplier_bars(spark, sf)), ["symbol"])


def completed_buckets(spark, sf):
    items = w.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("ts"))
    now = timeline.stamp("2000-06-15 13:30:00")
    return timeline.completed_buckets(items, now)


def evaluation_windows(spark, sf):
    return timeline.windows_of_history(_supplier_bars(spark, sf))


def window_rows(spark, sf):
    return timeline.window_rows(_bars(spark, sf), WINDOWS).select("symbol", "ts", "close", "window")


def windows_by_order(spark, sf):
    """One window per order: bars of its product in the days after it."""
    windows = w.order_windows(spark, sf)
    met = intervals.rows_in_windows(_supplier_bars(spark, sf).select("symbol", "ts"), windows)
    return met.groupBy("symbol", "window").agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def split_labels_by_supplier(spark, sf):
    """Splits of every product's own history."""
    bars = _supplier_bars(spark, sf)
    return intervals.labels(bars.select("symbol", "ts", "close"), w.own_splits(bars))


def research_rows_by_supplier(spark, sf):
    bars = _supplier_bars(spark, sf)
    return intervals.allowed_rows(bars.select("symbol", "ts", "close"), w.own_splits(bars), ("train", "validation"))


def plan_windows(spark, sf):
    return timeline.plan_windows(
        w.last_days(_supplier_bars(spark, sf)),
        F.col("last_day").cast("timestamp_ntz") + F.expr("INTERVAL 34 HOURS"),
        floor=w.REQUEST_FLOOR,
    )


def calendar_gaps(spark, sf):
    bars = _supplier_bars(spark, sf)
    return timeline.calendar_gaps(bars, w.last_days(bars))


def history_summary(spark, sf):
    bars = _supplier_bars(spark, sf)
    out = timeline.history_summary(bars, w.last_days(bars))
    return out.withColumn("missing_days", F.array_join("missing_days", ","))


# --- decoding and revision ------------------------------------------------------


def _decoded(spark, sf):
    return candles.decode_candles(w.faulty_candles(w.raw_candles(_bars(spark, sf))))


def decode_candles(spark, sf):
    return candles.accepted(_decoded(spark, sf)).select(
        "product", "page_no", "ts", *[normal_form(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")]
    )


def decode_rejects(spark, sf):
    products = w.table(spark, sf, "lineitem").select(F.explode(F.array("l_returnflag", "l_linestatus")).alias("product")).distinct()
    return candles.decode_rejects(_decoded(spark, sf), products)


def publishable(spark, sf):
    """Parts of which every candle is accepted, judged two days later than the pages were fetched."""
    raw = w.raw_candles(w.bars(spark, sf, "l_partkey"))
    later = w.faulty_candles(raw).withColumn("now", F.col("now") + F.expr("INTERVAL 2 DAYS"))
    return candles.publishable(candles.decode_candles(later), raw.select("product").distinct())


def canonical_from_pages(spark, sf):
    return candles.sound_bars(materialize(_decoded(spark, sf)))


def page_profile(spark, sf):
    return candles.page_profile(_pages(spark, sf), F.col("run_day"))


def page_plan_mismatch(spark, sf):
    bars = _bars(spark, sf)
    stored = w.request_pages(w.raw_candles(bars))
    planned = timeline.plan_windows(
        w.last_days(bars),
        F.col("last_day").cast("timestamp_ntz") + F.expr("INTERVAL 34 HOURS"),
        floor=w.REQUEST_FLOOR,
    ).withColumnRenamed("symbol", "product")
    return page_tables.page_plan_mismatch(stored, planned)


def _snapshots(spark, sf):
    raw = w.raw_candles(_bars(spark, sf))
    baseline = w.baseline_copy(raw)
    return baseline, w.audit_copy(raw), w.reference_days(baseline)


def revision_diff(spark, sf):
    return revision.revision_diff(*_snapshots(spark, sf))


def revision_counts(spark, sf):
    return revision.revision_counts(*_snapshots(spark, sf))


def revision_verdict(spark, sf):
    return revision.revision_verdict(*_snapshots(spark, sf))


def _stored(df):
    """Written as Parquet and read back: what many branches read is derived once, and each reads its columns only."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _faulty_snapshots(spark, sf):
    return w.faulty_snapshots(_stored(w.raw_candles(_supplier_bars(spark, sf))))


def snapshot_pair_violations(spark, sf):
    return revision.snapshot_pair_violations(*_faulty_snapshots(spark, sf))


def revision_audit(spark, sf):
    return revision.revision_audit(*_faulty_snapshots(spark, sf))


# --- indicators, signals, ledgers ---------------------------------------------------


def bars_from_ticks_query(spark, sf):
    return bars_from_ticks(w.event_ticks(spark, sf))


def ema(spark, sf):
    return _round(indicators.ema(_bars(spark, sf), [10, 30], layout=DAILY), "ema_10 ema_30")


def ema_intraday(spark, sf):
    """Averages over ticks as they come."""
    ticks = w.table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("close")
    )
    return _round(indicators.ema(ticks, [10, 30], layout=Positions(256, 64)), "ema_10 ema_30")


def ema_dense_day(spark, sf):
    """Nine tenths of all ticks on one day, a millisecond apart; chunks hold a bounded number of them all the same."""
    ticks = w.dense_ticks(spark, sf).select("symbol", "ts", F.col("px").alias("close"))
    return _round(indicators.ema(ticks, [10, 30], layout=Positions(128, 32)), "ema_10 ema_30")


def target_position_dense_day(spark, sf):
    """Next-tick positions on the same ticks."""
    ticks = w.dense_ticks(spark, sf).select("symbol", "ts", F.col("px").alias("open"), F.col("px").alias("close"))
    panel = materialize(signals.signal_panel(ticks, [BASELINE_CELL], layout=Positions(128, 32)))
    return signals.per_cell(panel, [BASELINE_CELL])


def crossover_signal(spark, sf):
    return _round(signals.crossover_signal(_bars(spark, sf), *BASELINE_CELL, layout=DAILY), "fast_ema slow_ema")


def crossover_signal_stored(spark, sf):
    """The same of every supplier, over bars stored in clusters, which are never exchanged."""
    folder = new_folder(spark)
    stored = bar_tables.write_clustered(_supplier_bars(spark, sf), f"bars_{folder.rsplit('/', 1)[-1]}", folder, 16, SMALL)
    return _round(signals.crossover_signal(stored, *BASELINE_CELL, layout=STORED), "fast_ema slow_ema")


def crossover_signal_stream(spark, sf):
    """The same over a stream that delivers the history in four parts, with state kept between them."""
    folder = new_folder(spark)
    source, target = f"{folder}/bars", f"{folder}/signals"
    bars = materialize(_supplier_bars(spark, sf).select("symbol", "ts", "close"))
    for low, high in ((1990, 1997), (1997, 1999), (1999, 2000), (2000, 2100)):
        part = bars.where((F.year("ts") >= low) & (F.year("ts") < high))
        part.write.mode("append").parquet(source)  # by all tasks; the stream takes what came as one batch
        stream = spark.readStream.schema(bars.schema).parquet(source)
        query = (
            averages_stream(stream, *BASELINE_CELL).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{folder}/state").option("path", target).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    found = spark.read.parquet(target).where("not late")
    return _round(found.select("symbol", "ts", "fast_ema", "slow_ema", "signal"), "fast_ema slow_ema")


def target_position(spark, sf):
    return signals.per_cell(_panel(spark, sf), [BASELINE_CELL])


def entry_exit_events(spark, sf):
    return signals.entry_exit_events(_panel(spark, sf))


def signal_transitions(spark, sf):
    # No open is read here; given as such, the branch with the bars would read other columns than that with their averages
    # and exchange the ticks once more.
    bars = w.bars_by_chunk(spark, sf, "l_suppkey", DAILY).withColumn("open", F.col("close"))
    return signals.signal_transitions(signals.signal_panel(bars, [BASELINE_CELL], layout=Stored(DAILY.block_bars)))


_TRADE = ("side", "price", "quantity", "commission", "cash_after", "units_after")


def fill_ledger(spark, sf):
    rows = ledger.fill_ledger(_panel(spark, sf), _book())
    return _round(rows.select(*RUN, "ts", *_TRADE), "quantity units_after", "commission cash_after")


def _curve(spark, sf):
    panel = _panel(spark, sf)
    return panel, ledger.equity_curve(panel, _book())


def equity_curve(spark, sf):
    _, curve = _curve(spark, sf)
    return _round(
        curve.select(*RUN, "ts", "cash", "units", "position_value", "equity"),
        "units", "cash position_value equity",
    )


def drawdown_curve(spark, sf):
    _, curve = _curve(spark, sf)
    return _round(metrics.drawdown_curve(curve), "drawdown", "equity peak")


def daily_returns(spark, sf):
    _, curve = _curve(spark, sf)
    return _round(metrics.daily_returns(curve).select(*RUN, "ts", "ret"), "ret")


def equity_before(spark, sf):
    _, curve = _curve(spark, sf)
    return _round(timeline.equity_before(curve, timeline.boundaries(WINDOWS), RUN), "", "equity")


def equity_before_trades(spark, sf):
    """The equity before every fill of every supplier: as many boundaries as trades."""
    panel = _wide_panel(spark, sf)
    fills = ledger.fill_ledger(panel, _book()).select(*RUN, "ts", "side")
    curve = _wide_curve(spark, sf, panel)
    return _round(intervals.as_of(fills, curve, ["equity"], RUN, chunk_rows=256), "", "equity")


def crossing_trips_by_supplier(spark, sf):
    """Trips that hold a bound of one of the windows of :func:`windows_by_order`."""
    panel = _wide_panel(spark, sf)
    trips = ledger.round_trips(ledger.fill_ledger(panel, _book()))
    crossed = intervals.crossing_trips(trips.select("symbol", "entry_ts", "exit_ts"), w.order_windows(spark, sf), ["symbol"])
    return crossed.select("symbol", "window", "entry_ts", "exit_ts")


def fill_ledger_by_supplier(spark, sf):
    rows = ledger.fill_ledger(_wide_panel(spark, sf), _book())
    return _round(rows.select(*RUN, "ts", *_TRADE), "quantity units_after", "commission cash_after")


def drawdown_curve_by_supplier(spark, sf):
    curve = _wide_curve(spark, sf, _wide_panel(spark, sf))
    return _round(metrics.drawdown_curve(curve), "drawdown", "equity peak")


def round_trips_by_supplier(spark, sf):
    panel = _wide_panel(spark, sf)
    return _round(ledger.round_trips(ledger.fill_ledger(panel, _book())), "quantity", _TRIP_MONEY)


def trade_violations(spark, sf):
    trades = ledger.fill_ledger(_wide_panel(spark, sf), _book())
    return ledger.trade_violations(w.faulty_trades(trades))


def _trips(spark, sf, grid=(BASELINE_CELL,)):
    panel = _panel(spark, sf, grid)
    return ledger.round_trips(ledger.fill_ledger(panel, _book(grid)))


_TRIP_MONEY = "entry_commission exit_commission realized_pnl"


def round_trips(spark, sf):
    return _round(_trips(spark, sf), "quantity", _TRIP_MONEY)


def eligible_round_trips(spark, sf):
    rows = metrics.eligible_round_trips(_trips(spark, sf), START, END)
    return _round(rows.select(*RUN, "entry_ts", "exit_ts", "realized_pnl"), "", "realized_pnl")


def burn_in_round_trips(spark, sf):
    rows = metrics.burn_in_round_trips(_trips(spark, sf, GRID), START)
    return _round(rows.select(*RUN, "entry_ts", "exit_ts", "realized_pnl"), "", "realized_pnl")


def cross_boundary(spark, sf):
    return metrics.cross_boundary(_trips(spark, sf), WINDOWS, RUN).where("crosses")


def buy_and_hold(spark, sf):
    bars = timeline.research_filter(_supplier_bars(spark, sf), w.SPLITS)
    out = ledger.buy_and_hold(bars, START, END)
    return _round(
        out, "entry_open entry_price quantity final_close total_return", "entry_commission final_value"
    )


def curve_metrics(spark, sf):
    panel, curve = _curve(spark, sf)
    out = metrics.curve_metrics(curve, ledger.fill_ledger(panel, _book()))
    return _round(out, "total_return max_drawdown")


def window_metrics(spark, sf):
    panel, curve = _curve(spark, sf)
    trips = ledger.round_trips(ledger.fill_ledger(panel, _book()))
    out = metrics.window_metrics(curve, trips, WINDOWS)
    return _round(
        out, "total_return volatility local_max_drawdown exposure", "start_equity end_equity"
    )


def window_metrics_by_supplier(spark, sf):
    panel = _wide_panel(spark, sf)
    trips = ledger.round_trips(ledger.fill_ledger(panel, _book()))
    out = metrics.window_metrics(_wide_curve(spark, sf, panel), trips, WINDOWS)
    return _round(
        out, "total_return volatility local_max_drawdown exposure", "start_equity end_equity"
    )


def aggregate_metrics(spark, sf):
    return _aggregates(_panel(spark, sf))


def aggregate_metrics_by_part(spark, sf):
    """Parts, of which some start after the first window and some end before the last."""
    return _aggregates(_panel(spark, sf, symbol="l_partkey"))


def _aggregates(panel):
    curve = ledger.equity_curve(panel, _book())
    pairs = materialize(ledger.paired_trades(ledger.fill_ledger(panel, _book())))
    out = metrics.aggregate_metrics(
        curve, pairs.where("exit_ts is not null"), pairs.where("exit_ts is null"), WINDOWS
    )
    return _round(
        out,
        "cagr volatility max_drawdown exposure hit_rate profit_factor sharpe_like",
        "start_equity end_equity",
    )


def trip_quality(spark, sf):
    eligible = metrics.eligible_round_trips(_trips(spark, sf, GRID), START, END)
    return _round(metrics.trip_quality(eligible), "hit_rate profit_factor")


def pnl_concentration(spark, sf):
    eligible = materialize(metrics.eligible_round_trips(_trips(spark, sf, GRID), START, END))
    return _round(metrics.pnl_concentration(eligible), "largest_positive_fraction", "total_positive_pnl")


def price_medians(spark, sf):
    """Median price of all lines by return flag: three groups that hold all rows."""
    items = w.table(spark, sf, "lineitem")
    return _round(order_statistics.exact_median(items, "l_extendedprice", ["l_returnflag"]), "", "median")


def largest_move(spark, sf):
    panel = signals.signal_panel(_supplier_bars(spark, sf), [BASELINE_CELL], layout=DAILY)
    return _round(metrics.largest_move(panel), "change")


# --- robustness -----------------------------------------------------------------


def _grid(spark, sf):
    panel = _panel(spark, sf, GRID)
    return panel, robustness.grid_returns(panel, _book(GRID), WINDOWS)


def _cells(spark, sf):
    _, returns = _grid(spark, sf)
    return materialize(returns.select("symbol", "fast", "slow", "aggregate_return").distinct())


def grid_returns(spark, sf):
    return _round(_grid(spark, sf)[1], "window_return aggregate_return")


def grid_returns_by_part(spark, sf):
    panel = _panel(spark, sf, SPOT_CHECKS, "l_partkey")
    return _round(robustness.grid_returns(panel, _book(SPOT_CHECKS), WINDOWS), "window_return aggregate_return")


def leave_one_out_by_part(spark, sf):
    panel = _panel(spark, sf, symbol="l_partkey")
    out = robustness.leave_one_out(robustness.grid_returns(panel, _book(), WINDOWS), RUN)
    return _round(out, "full_aggregate largest_change without")


def window_returns(spark, sf):
    panel = _panel(spark, sf)
    at = robustness.boundary_equity(panel, _book(), timeline.boundaries(WINDOWS))
    return _round(robustness.window_returns(at, WINDOWS, RUN), "window_return", "start_equity end_equity")


def cost_stress(spark, sf):
    panel, returns = _grid(spark, sf)
    out = robustness.cost_stress(panel, GRID, returns, COST_SCENARIOS, WINDOWS)
    return _round(out, "window_return aggregate_return")


def leave_one_out(spark, sf):
    _, returns = _grid(spark, sf)
    out = robustness.leave_one_out(returns, RUN)
    return _round(out, "full_aggregate largest_change without")


def window_dispersion(spark, sf):
    _, returns = _grid(spark, sf)
    return _round(robustness.window_dispersion(returns), "min_return median_return max_return")


def _neighbors(spark, sf):
    cells = _cells(spark, sf)
    return cells, robustness.grid_neighbors(cells, FAST_PERIODS, SLOW_PERIODS)


def grid_neighbors(spark, sf):
    return _round(_neighbors(spark, sf)[1], "aggregate_return n_return")


def sign_consistency(spark, sf):
    cells, neighbors = _neighbors(spark, sf)
    return _round(robustness.sign_consistency(cells, neighbors), "sign_consistency")


def sign_flip_pairs(spark, sf):
    return robustness.sign_flip_pairs(_neighbors(spark, sf)[1])


def baseline_neighbors(spark, sf):
    return _round(robustness.baseline_neighbors(_neighbors(spark, sf)[1]), "baseline_return n_return")


def isolated_cells(spark, sf):
    return _round(robustness.isolated_cells(_neighbors(spark, sf)[1]), "neighbor_mean difference threshold")


# --- reconciliation ---------------------------------------------------------------


def _two_ledgers(panel, book):
    left = materialize(ledger.fill_ledger(panel, book))
    right = materialize(reconcile.event_ledger(panel, book))
    amount = F.when(F.col("side") == "buy", F.col("units_after")).otherwise(F.col("cash_after"))
    keys = ["symbol"]
    return (
        left,
        right,
        reconcile.final_equity(panel, left, book, amount, keys),
        reconcile.final_equity(panel, right, book, F.col("amount_after"), keys),
    )


def _reconciled(spark, sf, grid):
    return _round(
        reconcile.ledger_reconcile(*_two_ledgers(_panel(spark, sf, grid), _book(grid))),
        "left_total_return right_total_return",
        "left_final_equity right_final_equity",
    )


def ledger_reconcile(spark, sf):
    return _reconciled(spark, sf, GRID)


def _unequal_ledgers(spark, sf):
    """Two ledgers that must disagree: another cell and other costs under the same name."""
    grid = [BASELINE_CELL, (12, 35)]
    panel = _wide_panel(spark, sf, grid, layout=DAILY)
    cash = INITIAL_CASH
    fast, slow = BASELINE_CELL
    one = [ledger.Run(0, fast, slow, "baseline", *COST_SCENARIOS["baseline"], cash)]
    two = [ledger.Run(1, fast, slow, "baseline", *COST_SCENARIOS["moderately_worse"], cash)]
    amount = F.when(F.col("side") == "buy", F.col("units_after")).otherwise(F.col("cash_after"))
    left, right = (materialize(ledger.fill_ledger(panel, b)) for b in (one, two))
    ends = [reconcile.final_equity(panel, t, b, amount, ["symbol"]) for t, b in ((left, one), (right, two))]
    return left, right, *ends


def ledger_reconcile_unequal(spark, sf):
    return _round(
        reconcile.ledger_reconcile(*_unequal_ledgers(spark, sf)),
        "left_total_return right_total_return",
        "left_final_equity right_final_equity",
    )


def divergences_unequal(spark, sf):
    """A record for every disagreement of the same ledgers."""
    found = reconcile.divergences(*_unequal_ledgers(spark, sf))
    return found.select(*RUN, "field", "ordinal", "explanation")


def spot_checks(spark, sf):
    return _reconciled(spark, sf, SPOT_CHECKS)


def partition_report(spark, sf):
    """Train and validation apart: averages and positions restart in each."""
    keys = ["symbol", "split"]
    rows = timeline.split_rows(_bars(spark, sf), w.SPLITS).where(F.col("split").isin("train", "validation"))
    panel = materialize(signals.signal_panel(rows, [BASELINE_CELL], keys, DAILY))
    book = _book()
    trades = ledger.fill_ledger(panel, book, keys)
    amount = F.when(F.col("side") == "buy", F.col("units_after")).otherwise(F.col("cash_after"))
    ends = reconcile.final_equity(panel, trades, book, amount, keys)
    sells = trades.groupBy(*keys).agg(F.count_if(F.col("side") == "sell").alias("trades"))
    out = ends.join(sells, keys, "left").select(
        *keys, F.coalesce("trades", F.lit(0)).alias("trades"), "final_equity", "total_return"
    )
    return _round(out, "total_return", "final_equity")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The whole study per symbol, in the order of its stages; rows of the sealed split are never read.

    Guard against splits, data rules, curve and aggregate metrics, grid and its neighbours,
    windows left out, concentration, cost stress, benchmark, and spot checks by a second ledger.
    """
    rows = materialize(_research(spark, sf))
    panel = materialize(signals.signal_panel(rows, GRID, layout=DAILY))
    fast, slow = BASELINE_CELL
    book = [ledger.Run(GRID.index(BASELINE_CELL), fast, slow, "baseline", *COST_SCENARIOS["baseline"], INITIAL_CASH)]
    pairs = materialize(ledger.paired_trades(ledger.fill_ledger(panel, book)))
    closed = pairs.where("exit_ts is not null")
    study = metrics.aggregate_metrics(
        ledger.equity_curve(panel, book), closed, pairs.where("exit_ts is null"), WINDOWS
    ).drop("fast", "slow", "scenario")
    returns = materialize(robustness.grid_returns(panel, _book(GRID), WINDOWS))
    baseline = returns.where((F.col("fast") == fast) & (F.col("slow") == slow))
    cells = materialize(returns.select("symbol", "fast", "slow", "aggregate_return").distinct())
    neighbors = robustness.grid_neighbors(cells, FAST_PERIODS, SLOW_PERIODS)
    stress = robustness.cost_stress(panel, GRID, returns, COST_SCENARIOS, WINDOWS)
    checked = reconcile.ledger_reconcile(*_two_ledgers(panel, _spot_book()))
    per = lambda df, *cols: df.groupBy("symbol").agg(*cols)
    stages = [
        w.actions(rows).transform(quality.corporate_actions, START, END).select("symbol", F.col("status").alias("corporate_actions")),
        per(quality.ohlcv_violations(rows), F.sum("rows").alias("data_violations")),
        robustness.sign_consistency(cells, neighbors),
        per(robustness.isolated_cells(neighbors), F.count_if("isolated").alias("isolated_cells")),
        per(robustness.leave_one_out(baseline, RUN), F.max("largest_change").alias("largest_change"), F.count_if("sign_flip").alias("sign_flips")),
        metrics.pnl_concentration(metrics.eligible_round_trips(closed, START, END)).select("symbol", "largest_positive_fraction", "trips_for_half"),
        per(stress, F.min("aggregate_return").alias("worst_stress_return")),
        ledger.buy_and_hold(rows, START, END).select("symbol", F.col("total_return").alias("buy_and_hold_return")),
        per(checked, F.count_if(F.col("equity_agrees") & F.col("return_agrees")).alias("spot_checks_passed")),
    ]
    for stage in stages:
        study = study.join(stage, "symbol", "left")
    study = study.withColumn("data_violations", F.coalesce("data_violations", F.lit(0)))
    return _round(
        study,
        "cagr volatility max_drawdown exposure hit_rate profit_factor sharpe_like sign_consistency largest_change "
        "largest_positive_fraction worst_stress_return buy_and_hold_return",
        "start_equity end_equity",
    )


def _spot_book():
    return [
        ledger.Run(GRID.index(cell), *cell, "baseline", *COST_SCENARIOS["baseline"], INITIAL_CASH) for cell in SPOT_CHECKS
    ]


REGISTERED = {
    f.__name__: f
    for f in (
        scan_bars, research_rows, research_lineage, snapshot_metadata, flatten_pages, artifact_counts,
        page_schema_violations, registry_scan, artifact_audit, latest_artifact, lineage_join,
        identity_violations, new_artifacts, registry_violations, registry_migrate, canonical_bars,
        ohlcv_violations, corporate_actions, gap_metadata_violations, split_rows, split_label,
        research_filter, split_violations, completed_buckets, evaluation_windows, window_rows,
        plan_windows, calendar_gaps, history_summary, decode_candles, decode_rejects,
        canonical_from_pages, page_profile, page_plan_mismatch, revision_diff, revision_counts,
        revision_verdict, ema, crossover_signal, target_position, entry_exit_events,
        signal_transitions, fill_ledger, equity_curve, drawdown_curve, daily_returns, equity_before,
        round_trips, eligible_round_trips, burn_in_round_trips, cross_boundary, buy_and_hold,
        curve_metrics, window_metrics, aggregate_metrics, trip_quality, pnl_concentration,
        largest_move, grid_returns, window_returns, cost_stress, leave_one_out, window_dispersion,
        grid_neighbors, sign_consistency, sign_flip_pairs, baseline_neighbors, isolated_cells,
        ledger_reconcile, spot_checks, partition_report, snapshot_pair_violations, revision_audit, publishable,
        ema_intraday, ema_dense_day, target_position_dense_day, fill_ledger_by_supplier, drawdown_curve_by_supplier, round_trips_by_supplier,
        window_metrics_by_supplier, aggregate_metrics_by_part, grid_returns_by_part, leave_one_out_by_part,
        ledger_reconcile_unequal, trade_violations, flagship, windows_by_order, split_labels_by_supplier,
        research_rows_by_supplier, equity_before_trades, crossing_trips_by_supplier, table_digests, digest_violations,
        research_verified, lineage_closure, cutoff_violations, divergences_unequal, crossover_signal_stored,
        crossover_signal_stream, price_medians, registry_batches, published_rows,
    )
} | {"bars_from_ticks": bars_from_ticks_query}
