"""Market-shaped inputs derived from the driver's tables.

The driver supplies no price bars, so ticks are read off ``lineitem`` and
everything else (bars, raw candles, snapshot copies, pages, catalogs, registry
rows) is derived from them in Spark. ``symbol`` picks the grouping column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapecheck.constants import DAY_SECONDS, REGISTRY_COLUMNS, REGISTRY_OLD_COLUMNS
from tapecheck.operators.blocks import Layout, epoch_seconds
from tapecheck.streaming.bars import bars_from_ticks, clustered_bars

SPLITS = (
    ("train", "1995-01-01", "1999-01-01"),
    ("validation", "1999-01-01", "2001-01-01"),
    ("test", "2001-01-01", "2002-01-01"),
)
BURN_IN_YEAR = 1995
EVALUATION_YEARS = (1996, 1997, 1998, 1999, 2000)
RESEARCH_CUTOFF = "2001-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, symbol: str | Column = "l_returnflag") -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    px = 100 + (F.col("l_extendedprice") / F.col("l_quantity")) / 1000
    return items.select(
        (F.col(symbol) if isinstance(symbol, str) else symbol).cast("string").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        px.alias("px"),
        F.col("l_quantity").alias("qty"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", px.alias("px")).alias("seq"),
    )


def bars(spark: SparkSession, sf_dir: str, symbol: str | Column = "l_returnflag") -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir, symbol))


#: Ticks of one task on average, and of a table that is left to Spark.
TASK_TICKS, FEW_TICKS = 250_000, 2_000_000


def tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """How many tasks share the ticks; None for few ticks, which are dealt out as Spark likes.

    Left alone, adaptive execution merges partitions up to 64 MB, which hold more than a million ticks, and beyond its
    shuffle partitions they grow with the table. Fewer than those are not asked for, since a join with
    the other side in so many would exchange the bars again. The number of rows is read off the footers of the files.
    """
    ticks = table(spark, sf_dir, "lineitem").count()
    return None if ticks <= FEW_TICKS else max(-(-ticks // TASK_TICKS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def bars_by_chunk(spark: SparkSession, sf_dir: str, symbol: str, layout: Layout) -> DataFrame:
    """Bars of many symbols with few ticks a day, clustered for a panel."""
    return clustered_bars(ticks(spark, sf_dir, symbol), layout, tasks(spark, sf_dir))


# --- raw candles, snapshot copies, pages -------------------------------------

REQUEST_FLOOR = "1995-01-01"
PAGE_DAYS = 300


def _fixed_text(value: Column) -> Column:
    """Decimal text with four places, cut and not rounded."""
    units = F.floor(value * 10000)
    return F.concat(
        F.floor(units / 10000).cast("string"), F.lit("."), F.lpad((units % 10000).cast("string"), 4, "0")
    )


def raw_candles(bars: DataFrame) -> DataFrame:
    """Candle text per product and day; ``d`` is the day number used to vary copies."""
    return bars.select(
        F.col("symbol").alias("product"),
        F.col("ts").cast("date").alias("day"),
        F.unix_date(F.col("ts").cast("date")).alias("d"),
        epoch_seconds(F.col("ts")).cast("string").alias("start"),
        *[_fixed_text(F.col(c)).alias(c) for c in ("low", "high", "open", "close", "volume")],
    )


def baseline_copy(raw: DataFrame) -> DataFrame:
    return raw.where("d % 89 != 0")


def audit_copy(raw: DataFrame) -> DataFrame:
    """Some days dropped, some closes changed, some only written differently."""
    close = (
        F.when(F.col("d") % 53 == 0, F.concat("close", F.lit("1")))
        .when(F.col("d") % 31 == 0, F.concat("close", F.lit("0")))
        .otherwise(F.col("close"))
    )
    return raw.where("d % 97 != 0").withColumn("close", close)


def faulty_snapshots(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Copies of numbered products, of which some break a rule of the comparison; with reference days."""
    p = F.col("product").cast("int")
    reference = reference_days(baseline_copy(raw))
    baseline = baseline_copy(raw).withColumn("interval", F.lit("1d")).join(reference, "product")
    baseline = baseline.where((p % 7 != 1) | (F.date_add("day", 1) < F.col("reference_day"))).drop("reference_day")
    repeated = F.when((p % 7 == 3) & (F.col("d") % 3 == 0), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    audit = (
        audit_copy(raw)
        .withColumn("low", F.when((p % 7 == 2) & (F.col("d") % 5 == 0), "garbage").otherwise(F.col("low")))
        .withColumn("interval", F.when(p % 7 == 4, "1h").otherwise("1d"))
        .withColumn("copy", F.explode(repeated))
        .drop("copy")
    )
    strangers = audit.where(p % 7 == 5).withColumn("product", F.concat(F.lit("x"), "product"))
    return baseline, audit.unionByName(strangers), reference


def reference_days(baseline: DataFrame) -> DataFrame:
    return baseline.groupBy("product").agg(F.date_add(F.max("day"), 1).alias("reference_day"))


def _page_of(day_number: Column) -> Column:
    floor = F.unix_date(F.lit(REQUEST_FLOOR).cast("date"))
    return F.floor((day_number - floor) / PAGE_DAYS)


def faulty_candles(raw: DataFrame) -> DataFrame:
    """Decoder input in which some candles are malformed, misplaced, doubled or open."""
    d = F.col("d")
    page = F.greatest(F.lit(0), _page_of(d) - F.when(d % 59 == 0, 1).otherwise(0))
    floor = F.lit(REQUEST_FLOOR).cast("date")
    first_day = F.date_add(floor, (page * PAGE_DAYS).cast("int"))
    now = raw.groupBy("product").agg(
        (F.max("day").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")).alias("now")
    )
    copies = F.when(d % 47 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return raw.join(now, "product").select(
        "product",
        page.cast("int").alias("page_no"),
        F.explode(copies).alias("copy"),
        "d",
        first_day.alias("first_day"),
        F.date_add(first_day, PAGE_DAYS - 1).alias("last_day"),
        "now",
        F.when(d % 41 == 0, (F.col("start").cast("bigint") + 3600).cast("string"))
        .otherwise(F.col("start"))
        .alias("start"),
        F.when(d % 43 == 0, F.lit("NaN")).otherwise(F.col("low")).alias("low"),
        "high",
        "open",
        "close",
        "volume",
    ).select("*", (F.lit(30000) - F.col("d") + F.col("copy") * 100000).alias("pos"))


def request_pages(raw: DataFrame) -> DataFrame:
    """Stored pages, newest candle first; every seventh asks for a shifted start."""
    page = _page_of(F.col("d")).cast("int")
    floor = F.unix_date(F.lit(REQUEST_FLOOR).cast("date"))
    last = raw.groupBy("product").agg(F.max("d").alias("last_d"))
    first = floor + F.col("page_no") * PAGE_DAYS
    shifted = first + F.when(F.col("page_no") % 7 == 3, 1).otherwise(0)
    end = F.least(first + PAGE_DAYS - 1, F.col("last_d"))
    names = ("start", "low", "high", "open", "close", "volume")
    newest_first = F.reverse(F.array_sort(F.collect_list(F.struct("d", *names))))
    candles = F.transform(newest_first, lambda c: F.struct(*[c[k].alias(k) for k in names]))
    return (
        raw.groupBy("product", page.alias("page_no"))
        .agg(candles.alias("candles"))
        .join(last, "product")
        .select(
            "product",
            "page_no",
            (shifted.cast("bigint") * DAY_SECONDS).cast("string").alias("request_start"),
            (end.cast("bigint") * DAY_SECONDS).cast("string").alias("request_end"),
            "candles",
            F.date_from_unix_date("last_d").alias("run_day"),
        )
    )


def artifacts(pages: DataFrame) -> DataFrame:
    """Nested raw artifacts, one per product, holding all its pages."""
    null_map = F.lit(None).cast("map<string,string>")
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "request_start", "request_end", "candles")))
    retrieval = F.struct(
        F.lit("3").alias("python_version"),
        F.lit("1").alias("sdk_version"),
        F.lit("2002-01-01T00:00:00Z").alias("started_at_utc"),
        F.lit("2002-01-01T00:00:10Z").alias("completed_at_utc"),
    )
    return (
        pages.groupBy("product")
        .agg(ordered.alias("ps"))
        .select(
            F.lit(1).alias("schema_version"),
            F.lit("coinbase").alias("provider"),
            "product",
            F.lit("1d").alias("interval"),
            retrieval.alias("retrieval"),
            F.transform(
                "ps",
                lambda p: F.struct(
                    F.struct(
                        F.col("product").alias("product_id"),
                        p["request_start"].alias("start"),
                        p["request_end"].alias("end"),
                        F.lit("ONE_DAY").alias("granularity"),
                    ).alias("request"),
                    null_map.alias("rate_limit_headers"),
                    p["candles"].alias("candles"),
                ),
            ).alias("pages"),
        )
    )


# --- catalog and registry, one row per order ----------------------------------


#: How creation times are written; all but the second are UTC.
OFFSETS = ("+00:00", "-18:00", "Z", "")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw and a processed artifact per order; a few records are deficient."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    symbol = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    created = F.when(
        F.col("o_orderkey") % 211 == 0, F.lit(None).cast("string")
    ).otherwise(
        F.concat(
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
            F.element_at(F.array(*[F.lit(x) for x in OFFSETS]), (F.col("o_orderkey") % len(OFFSETS) + 1).cast("int")),
        )
    )
    raw_sha = F.sha2(F.concat(F.lit("raw-"), key), 256)
    base = o.select("o_orderkey", key.alias("key"), symbol.alias("symbol"), created.alias("created_at_utc"), raw_sha.alias("raw_sha"))
    raw = base.select(
        F.lit("raw").alias("kind"),
        F.concat(F.lit("raw/"), "symbol", F.lit("/1d/"), "key", F.lit(".parquet")).alias("path"),
        F.lit("acme").alias("provider"),
        "symbol",
        F.lit("1d").alias("interval"),
        "created_at_utc",
        F.col("raw_sha").alias("sha256"),
        F.lit(None).cast("string").alias("source_raw_sha256"),
        F.lit(None).cast("string").alias("source_raw_file"),
    ).withColumn("file", F.col("path"))
    parent = F.concat(F.lit("raw/"), F.when(F.col("o_orderkey") % 31 == 0, "moved").otherwise(F.col("symbol")), F.lit("/1d/"), "key", F.lit(".parquet"))
    lost = F.when(F.col("o_orderkey") % 17 == 0, F.sha2(F.concat(F.lit("lost-"), "key"), 256)).otherwise(F.col("raw_sha"))
    recorded = F.when(F.col("o_orderkey") % 23 == 0, F.concat("symbol", F.lit("x"))).otherwise(F.col("symbol"))
    path = F.concat(F.lit("processed/acme/"), "symbol", F.lit("/1d/"), "key", F.lit(".canonical.parquet"))
    processed = base.select(
        F.lit("processed").alias("kind"),
        path.alias("path"),
        F.lit("acme").alias("provider"),
        recorded.alias("symbol"),
        F.lit("1d").alias("interval"),
        "created_at_utc",
        F.sha2(F.concat(F.lit("proc-"), "key"), 256).alias("sha256"),
        lost.alias("source_raw_sha256"),
        parent.alias("source_raw_file"),
        F.when(F.col("o_orderkey") % 29 == 0, F.lit("elsewhere")).otherwise(path).alias("file"),
    )
    return raw.unionByName(processed)


def registry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order; some break a part of the contract."""
    return table(spark, sf_dir, "orders").select(*_record())


def _record() -> list[Column]:
    """The record of an order."""
    k = F.col("o_orderkey")
    versions = (
        F.when(k % 17 == 0, '{"python":"3","pandas":"2","pyarrow":"1","vectorbt":"0"} and more')
        .when(k % 13 == 0, "[1, 2]")
        .when(k % 11 == 0, "not json")
        .when(k % 7 == 0, '{"python":"3","pandas":"2"}')
        .otherwise('{"python":"3","pandas":"2","pyarrow":"1","vectorbt":"0"}')
    )
    given = {
        "experiment_id": F.concat(F.lit("exp-"), k.cast("string")),
        "date": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "git_commit": F.when(k % 5 == 0, "").otherwise(F.sha2(k.cast("string"), 256)),
        "working_tree_clean": F.when(k % 3 == 0, "false").otherwise("true"),
        "record_status": F.when(k % 19 == 0, "draft").when(k % 2 == 0, "dev").otherwise("finalized"),
        "hypothesis": F.concat(F.lit('says "stable", '), F.col("o_orderpriority")),
        "params_json": F.concat(F.lit('{"fast":'), (k % 12 + 1).cast("string"), F.lit("}")),
        "dependency_versions_json": versions,
        "test_evaluated": F.lit("false"),
    }
    filled = (
        "processed_snapshot_sha256", "source_raw_sha256", "config_sha256",
        "cost_scenario", "window_ids", "metrics_report_path",
    )
    given |= {c: F.lit(c) for c in filled}
    return [given.get(c, F.lit("")).alias(c) for c in REGISTRY_COLUMNS]


def batched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry records in one batch per customer, with the batch's ``number``; most records are mended, so most batches are sound."""
    r = table(spark, sf_dir, "orders").select(*_record(), "o_orderkey", "o_custkey")
    mend = lambda c, good: F.when(F.col("o_orderkey") % 50 == 0, F.col(c)).otherwise(F.lit(good)).alias(c)
    good = {
        "git_commit": "abc", "working_tree_clean": "true", "record_status": "finalized",
        "dependency_versions_json": '{"python":"3","pandas":"2","pyarrow":"1","vectorbt":"0"}',
    }
    columns = [mend(c, good[c]) if c in good else F.col(c) for c in REGISTRY_COLUMNS]
    return r.select(*columns, F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("batch_id"), F.col("o_custkey").alias("number"))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows with a symbol and a time."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").alias("ts"), "o_orderkey", "o_custkey", "o_orderpriority")


def derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts in chains of ten; some chains are rings, some lack a parent or record a wrong hash."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    chain, link = F.floor(F.col("k") / 10), F.col("k") % 10
    parent = F.when(link > 0, F.col("k") - 1).when(chain % 37 == 5, F.col("k") + 9)
    sha = lambda c: F.sha2(c.cast("string"), 256)
    gone = (chain % 41 == 7) & (link == 4)
    name = lambda c: F.concat(F.lit("artifact/"), c.cast("string"))
    return o.select(
        name(F.col("k")).alias("path"),
        sha(F.col("k")).alias("sha256"),
        F.when(gone, F.concat(name(parent), F.lit("-gone"))).otherwise(name(parent)).alias("parent_path"),
        F.when((chain % 43 == 9) & (link == 3), "other").otherwise(sha(parent)).alias("parent_sha256"),
    )


def order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window per order, of no day to three years, on one of a hundred suppliers."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        (k % 100).cast("string").alias("symbol"), k.alias("window"), F.col("o_orderdate").alias("start"),
        (F.col("o_orderdate") + F.make_dt_interval(F.when(k % 100 == 0, 1000).otherwise(k % 45).cast("int"))).alias("end"),
    )


def old_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    given = {
        "experiment_id": F.concat(F.lit("exp-"), F.col("o_orderkey").cast("string")),
        "date": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "params": F.concat(F.lit('{"fast":'), (F.col("o_orderkey") % 12 + 1).cast("string"), F.lit("}")),
        "outcome": F.col("o_orderstatus"),
    }
    return o.select(*[given.get(c, F.lit("")).alias(c) for c in REGISTRY_OLD_COLUMNS])


def gap_metadata(gaps: DataFrame, symbols: DataFrame) -> DataFrame:
    """Snapshot metadata per symbol; by symbol number some are deficient."""
    lists = gaps.groupBy("symbol").agg(F.array_sort(F.collect_list(F.col("day").cast("string"))).alias("days"))
    n = F.col("symbol").cast("int")
    days = F.coalesce("days", F.expr("cast(array() as array<string>)"))
    days = (
        F.when(n % 5 == 1, F.concat(days, F.array(F.lit("1999-1-2"))))
        .when(n % 5 == 2, F.concat(days, F.slice(days, 1, 1)))
        .when(n % 5 == 3, F.reverse(days))
        .otherwise(days)
    )
    rows = symbols.join(lists, "symbol", "left").withColumn("missing_days", days)
    return rows.select(
        "symbol",
        F.when(n % 11 != 0, "acme").alias("provider"),
        F.when(n % 7 != 0, F.col("missing_days")).alias("missing_days"),
        (F.size("missing_days") + F.when(n % 13 == 0, 1).otherwise(0)).alias("missing_day_count"),
        F.when(n % 3 == 0, "").otherwise("base").alias("volume_unit"),
        F.lit("unconfirmed").alias("volume_unit_status"),
        F.lit("base_asset").alias("volume_unit_inference"),
        F.lit("notes").alias("volume_unit_evidence"),
    )


# --- faulty copies of bars, actions, split tables ------------------------------------


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("px"),
        F.lit(1.0).alias("qty"), F.struct("ts", "event_id").alias("seq"),
    )


def dense_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events, of which all but every tenth fall on one day, a millisecond apart."""
    e = table(spark, sf_dir, "events")
    day = F.when(F.col("event_id") % 10 == 0, F.col("event_id") % 40).otherwise(0)
    return e.select(
        F.col("event_type").alias("symbol"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(day.cast("int"), F.lit(0), F.lit(0), F.col("event_id") / 1000)).alias("ts"),
        F.col("value").alias("px"),
    )


def last_days(bars: DataFrame) -> DataFrame:
    """Last planned day per symbol: two days after its last bar."""
    return bars.groupBy("symbol").agg(F.date_add(F.max("ts").cast("date"), 2).alias("last_day"))


def faulty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars per supplier; by day and supplier number some break a rule."""
    b = bars(spark, sf_dir, "l_suppkey")
    d, n = F.unix_date(F.col("ts").cast("date")), F.col("symbol").try_cast("int")
    copies = F.when((d % 101 == 0) & (n % 3 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    change = lambda c, test, value: F.when(test, value).otherwise(F.col(c)).alias(c)
    return b.select(
        "symbol",
        "ts",
        # Ties of a doubled day arrive next to each other; some symbols arrive newest first.
        F.when(n % 4 == 0, 40000 - d).otherwise(d).cast("bigint").alias("seq"),
        change("open", (d % 103 == 0) & (n % 5 == 0), F.lit(float("nan"))),
        change("high", (d % 107 == 0) & (n % 2 == 0), F.col("low") - 1),
        change("low", (d % 109 == 0) & (n % 2 == 1), F.lit(-1.0)),
        change("close", (d % 113 == 0) & (n % 7 == 0), F.lit(float("inf"))),
        change("volume", d % 127 == 0, F.lit(-5.0)),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def actions(bars: DataFrame) -> DataFrame:
    """Corporate actions per supplier; some suppliers have a split or a missing value."""
    d, n = F.unix_date(F.col("ts").cast("date")), F.col("symbol").try_cast("int")
    return bars.select(
        "symbol",
        "ts",
        F.when((n % 9 == 0) & (d % 50 == 0), 2.0)
        .when((n % 10 == 0) & (d % 60 == 0), F.lit(None).cast("double"))
        .otherwise(0.0)
        .alias("stock_splits"),
        F.when(d % 63 == 0, 0.5).otherwise(0.0).alias("dividends"),
    )


def split_tables(bars: DataFrame) -> DataFrame:
    """A three-part split table per symbol from its own history; some are wrong."""
    span = bars.groupBy("symbol").agg(
        F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("z")
    )
    n = F.col("symbol").cast("int")
    cut1, cut2 = F.date_add("a", 1000), F.date_add("a", 1600)
    late = F.date_add(cut1, F.when(n % 4 == 1, 5).when(n % 4 == 2, -5).otherwise(0))
    end = F.when(n % 6 == 0, cut2).otherwise(F.col("z"))
    part = lambda i, name, x, y: F.struct(
        F.lit(i).alias("position"), F.lit(name).alias("name"),
        x.cast("timestamp_ntz").alias("start"), y.cast("timestamp_ntz").alias("end_exclusive"),
    )
    return span.select(
        "symbol",
        F.inline(
            F.array(
                part(0, "train", F.col("a"), cut1), part(1, "validation", late, cut2), part(2, "test", cut2, end)
            )
        ),
    )


def own_splits(bars: DataFrame) -> DataFrame:
    """Sound splits of each symbol's own history, cut at different days; rows after the last are in none."""
    span = bars.groupBy("symbol").agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("z"))
    n = F.col("symbol").cast("int")
    one, two = F.date_add("a", 700 + n % 7 * 50), F.date_add("a", 1400 + n % 11 * 40)
    part = lambda i, name, x, y: F.struct(
        F.lit(i).alias("position"), F.lit(name).alias("name"),
        x.cast("timestamp_ntz").alias("start"), y.cast("timestamp_ntz").alias("end_exclusive"),
    )
    parts = (part(0, "train", F.col("a"), one), part(1, "validation", one, two), part(2, "test", two, F.date_add("z", -20)))
    return span.select("symbol", F.inline(F.array(*parts)))


def page_documents(pages: DataFrame) -> DataFrame:
    """One JSON text per page, in which some parts break the closed schema."""
    n = F.col("page_no")
    request = F.concat(
        F.lit('{"product_id":"'), F.when(n == 2, "X").otherwise(F.col("product")),
        F.lit('","start":'), F.when(n == 3, F.col("request_start")).otherwise(F.concat(F.lit('"'), "request_start", F.lit('"'))),
        F.lit(',"end":"'), F.col("request_end"),
        F.lit('","granularity":"'), F.when(n == 4, "ONE_HOUR").otherwise("ONE_DAY"), F.lit('"}'),
    )
    body = F.concat(
        F.lit('{"schema_version":'), F.when(n == 1, "2").otherwise("1"),
        F.lit(',"provider":"coinbase","product":"'), F.col("product"),
        F.lit('","interval":"1d"'), F.when(n == 5, ',"extra":1').otherwise(""),
        F.lit(',"retrieval":{"python_version":"3","sdk_version":"1","started_at_utc":"'),
        F.when(n == 6, "yesterday").otherwise("2002-01-01T00:00:00Z"),
        F.lit('","completed_at_utc":"2002-01-01T00:00:10+00:00"},"pages":[{"request":'), request,
        F.lit(',"rate_limit_headers":'), F.when(n == 7, '{"x-other":"1"}').otherwise("null"),
        F.lit(',"candles":'), F.to_json(F.transform("candles", lambda c: F.struct(*[c[k].alias(k) for k in ("start", "low", "high", "open", "close", "volume")]))),
        F.lit("}]}"), F.when((n == 0) & (F.col("product") == "A"), "}").otherwise(""),
    )
    return pages.select("product", "page_no", body.alias("body"))


def faulty_trades(trades: DataFrame) -> DataFrame:
    """A ledger with buys missing, sides unknown and quantities that do not match."""
    d = F.unix_date(F.col("ts").cast("date"))
    buy = F.col("side") == "buy"
    return trades.where(~(buy & (d % 7 == 0))).withColumns(
        {
            "quantity": F.when(~buy & (d % 11 == 0), F.col("quantity") * 1.5).otherwise(F.col("quantity")),
            "side": F.when(d % 13 == 0, "hold").otherwise(F.col("side")),
        }
    )
