"""Strict decoding of raw candles into canonical bars.

Input rows carry six text fields plus ``product``, ``page_no``, ``pos`` (place
in the response), the page's inclusive ``first_day``/``last_day`` and ``now``,
the provider's own time of retrieval. Nothing is repaired: each row that cannot
be used gets the first reason that applies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapecheck.constants import CANDLE_KEYS, CANDLE_NUMERIC, DAY_SECONDS
from tapecheck.functions.decimals import (
    is_finite_decimal,
    is_non_finite_decimal,
    to_double,
)
from tapecheck.operators.blocks import materialize
from tapecheck.operators.quality import ohlcv_violations
from tapecheck.sources.publish import append_batches

# Last second a calendar date can name (end of year 9999).
LAST_EPOCH = 253_402_300_799


def epoch(start: Column) -> Column:
    """Epoch seconds of an all-digits text, NULL if it is not one or too large."""
    number = F.when(start.rlike(r"\A[0-9]+\z"), start).try_cast("bigint")
    return F.when(number.between(0, LAST_EPOCH), number)


def bucket(seconds: Column) -> Column:
    """Start of the UTC day that an epoch second lies in."""
    return F.date_from_unix_date((seconds / DAY_SECONDS).cast("int")).cast("timestamp_ntz")


def malformed() -> Column:
    """Why a candle (with its ``epoch``) cannot be decoded, or NULL."""
    start = F.col("start")
    numbers = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in CANDLE_NUMERIC]
    )
    unusable = F.filter(numbers, lambda n: ~is_finite_decimal(n["text"]))
    why = F.transform(
        unusable,
        lambda n: F.concat(
            n["field"],
            F.when(is_non_finite_decimal(n["text"]), "_not_finite").otherwise("_not_decimal"),
        ),
    )
    return (
        F.when(F.exists(F.array(*CANDLE_KEYS), lambda x: x.isNull()), "missing_or_not_text")
        .when(~start.rlike(r"\A[0-9]+\z"), "start_not_digits")
        .when(F.col("epoch").isNull(), "start_out_of_range")
        .when(F.col("epoch") % DAY_SECONDS != 0, "start_not_midnight")
        .otherwise(F.get(why, F.lit(0)))
    )


def decode_candles(raw: DataFrame) -> DataFrame:
    """Add ``ts`` and ``reject``: malformed, then outside, duplicate, incomplete.

    Duplicated buckets are found with a pre-aggregated count and only those few
    meet the rows again, so the rows themselves are not shuffled for it.
    """
    rows = raw.withColumn("epoch", epoch(F.col("start"))).withColumn("malformed", malformed())
    ts = F.when(F.col("malformed").isNull(), bucket(F.col("epoch")))
    # Rows without a bucket match nothing; they get keys of their own so that
    # many of them do not meet in one partition of the join.
    place = F.col("page_no").cast("bigint") * (1 << 32) + F.col("pos")
    apart = -1 - F.pmod(F.xxhash64("page_no", "pos"), F.lit(1 << 20))
    rows = rows.withColumn("ts", ts).withColumn(
        "slot", F.when(F.col("ts").isNotNull(), F.col("epoch")).otherwise(apart)
    )
    inside = F.col("ts").cast("date").between(F.col("first_day"), F.col("last_day"))
    repeated = (
        rows.where(inside)
        .groupBy("product", "slot")
        .agg(F.count("*").alias("copies"), F.min(place).alias("kept"))
        .where("copies > 1")
        .select("product", "slot", "kept")
    )
    incomplete = F.col("ts") + F.expr("INTERVAL 1 DAY") > F.col("now")
    return (
        rows.join(repeated, ["product", "slot"], "left")
        .withColumn(
            "reject",
            F.when(F.col("malformed").isNotNull(), F.concat(F.lit("malformed:"), "malformed"))
            .when(~inside, "outside_window")
            .when(F.col("kept").isNotNull() & (place != F.col("kept")), "duplicate_bucket")
            .when(incomplete, "incomplete_bucket"),
        )
        .drop("malformed", "epoch", "kept", "slot")
    )


def decode_rejects(decoded: DataFrame, products: DataFrame) -> DataFrame:
    """Every rejected candle, and products that returned no candle at all."""
    bad = decoded.where("reject is not null").select(
        "product", "page_no", "pos", "start", "reject"
    )
    silent = products.select("product").join(decoded.select("product").distinct(), "product", "left_anti")
    return bad.unionByName(
        silent.withColumn("reject", F.lit("empty_history")), allowMissingColumns=True
    )


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.where("reject is null")


def publishable(decoded: DataFrame, products: DataFrame) -> DataFrame:
    """All-or-nothing: products without a single reject."""
    bad = decode_rejects(decoded, products).select("product").distinct()
    return products.join(bad, "product", "left_anti")


def to_bars(decoded: DataFrame) -> DataFrame:
    """Canonical columns of accepted candles; :func:`sound_bars` are those that may be used."""
    return accepted(decoded).select(
        F.col("product").alias("symbol"),
        "ts",
        *[to_double(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")],
    )


def bar_violations(decoded: DataFrame) -> DataFrame:
    """What the accepted candles break as bars, once their exact decimals are doubles: ``symbol, rule, rows``.

    A decimal too large for a double is infinite then, one too small is zero.
    """
    return ohlcv_violations(to_bars(decoded))


def sound_bars(decoded: DataFrame) -> DataFrame:
    """Bars of the accepted candles of products whose bars break no rule (:func:`bar_violations`)."""
    bad = bar_violations(decoded).select("symbol").distinct()
    return to_bars(decoded).join(bad, "symbol", "left_anti")


def publish_sound(decoded: DataFrame, root: str) -> DataFrame:
    """Publish the bars of every product without a reject or a broken rule, each as one batch of a commit.

    A product with one of either is refused whole, and one that is in already is not written again: ``batch_id, rows,
    status`` as :func:`tapecheck.sources.publish.append_batches` returns them.
    """
    rejected = materialize(decoded.where("reject is not null").select(F.col("product").alias("symbol")).distinct())
    bars = to_bars(decoded).withColumn("batch_id", F.col("symbol"))

    def bad(rows: DataFrame) -> DataFrame:
        # Rules are only tried where no reject has decided already.
        broken = ohlcv_violations(rows.drop("batch_id").join(rejected, "symbol", "left_anti")).select("symbol")
        return broken.unionByName(rejected.join(rows.select("symbol").distinct(), "symbol")).distinct().withColumnRenamed("symbol", "batch_id")

    return append_batches(bars, root, bad)


def page_profile(pages: DataFrame, run_day: Column) -> DataFrame:
    """What a page shows: counts, order of its starts, days missing from its grid.

    ``pages`` has ``product, page_no, request_start, request_end`` and the array
    ``candles``. A page is one response and bounded by the request limit.
    """
    parsed = F.transform("candles", lambda c: epoch(c["start"]))
    pages = pages.withColumn("starts", parsed).withColumn("known", F.filter("starts", lambda x: x.isNotNull()))
    pairs = F.arrays_zip(
        F.slice("known", F.lit(1), F.greatest(F.size("known") - 1, F.lit(0))).alias("a"),
        F.slice("known", F.lit(2), F.greatest(F.size("known") - 1, F.lit(0))).alias("b"),
    )
    first = epoch(F.col("request_start")) - F.pmod(epoch(F.col("request_start")), F.lit(DAY_SECONDS))
    end = epoch(F.col("request_end")) - F.pmod(epoch(F.col("request_end")), F.lit(DAY_SECONDS))
    grid = F.when(
        first < end, F.sequence(first, end - DAY_SECONDS, F.lit(DAY_SECONDS).cast("bigint"))
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    newest = F.date_from_unix_date((F.array_max("known") / DAY_SECONDS).cast("int"))
    return pages.select(
        "product",
        "page_no",
        F.size("candles").cast("bigint").alias("returned"),
        F.size("known").cast("bigint").alias("parseable"),
        F.when(F.size("known") < 2, "single_or_empty")
        .when(F.forall(pairs, lambda p: p["a"] <= p["b"]), "ascending")
        .when(F.forall(pairs, lambda p: p["a"] >= p["b"]), "descending")
        .otherwise("mixed")
        .alias("ordering"),
        F.size(F.filter("known", lambda x: F.pmod(x, F.lit(DAY_SECONDS)) != 0))
        .cast("bigint")
        .alias("off_midnight"),
        F.size(grid).cast("bigint").alias("requested_days"),
        F.size(F.array_except(grid, F.col("known"))).cast("bigint").alias("missing_days"),
        (newest == run_day).alias("newest_is_run_day"),
    )
