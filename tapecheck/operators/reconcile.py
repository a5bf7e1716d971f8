"""Reconciliation of two independently computed sets of fills and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapecheck.constants import (
    EQUITY_RELATIVE_TOLERANCE,
    PRICE_RELATIVE_TOLERANCE,
    RETURN_ABSOLUTE_TOLERANCE,
)
from tapecheck.functions.numbers import is_close, relative_diff
from tapecheck.operators.blocks import materialize, running
from tapecheck.operators.ledger import RUN_KEYS, Run, book_rows, fills

LEDGER_KEYS = ("symbol", *RUN_KEYS)


def event_ledger(
    panel: DataFrame, book: Sequence[Run], keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """A second ledger from entry and exit events, compounding in logarithms.

    It shares the panel with :func:`tapecheck.operators.ledger.fill_ledger` but
    neither its state formula nor its order of arithmetic.
    """
    rows = panel.where("tgt != ptgt").select(
        *keys, "chunk", "blk", "ts", "open", "tgt", "ptgt", F.inline(book_rows(book))
    )
    now, before = (F.getbit(F.col(c), F.col("index")) for c in ("tgt", "ptgt"))
    entry, leave = (before == 0) & (now == 1), (before == 1) & (now == 0)
    slip = F.when(entry, F.col("slippage_rate")).otherwise(-F.col("slippage_rate"))
    rows = rows.where(entry | leave).withColumn("entry", entry).withColumn(
        "price", F.col("open") + F.col("open") * slip
    )
    step = F.when(F.col("entry"), -F.ln("price") - F.log1p("commission_rate")).otherwise(
        F.ln("price") + F.log1p(-F.col("commission_rate"))
    )
    return running(rows, [*keys, "run"], {"log_growth": step}, "sum").select(
        *keys,
        *RUN_KEYS,
        "chunk",
        "blk",
        "ts",
        F.when(F.col("entry"), "buy").otherwise("sell").alias("side"),
        "price",
        (F.col("start_cash") * F.exp("log_growth")).alias("amount_after"),
    )


def final_equity(
    panel: DataFrame, trades: DataFrame, book: Sequence[Run], amount: Column, keys: Sequence[str]
) -> DataFrame:
    """Equity at the last close, from the last fill's amount (units or cash)."""
    last_close = panel.groupBy(*keys).agg(F.max_by("close", "ts").alias("close"))
    last_fill = (
        trades.withColumn("amount", amount)
        .groupBy(*keys, *RUN_KEYS)
        .agg(F.max_by("amount", "ts").alias("amount"), F.max_by("side", "ts").alias("side"))
    )
    return (
        last_close.select("*", F.inline(book_rows(book)))
        .join(last_fill, [*keys, *RUN_KEYS], "left")
        .select(
            *keys,
            *RUN_KEYS,
            "start_cash",
            (
                F.coalesce("amount", "start_cash")
                * F.when(F.col("side") == "buy", F.col("close")).otherwise(1.0)
            ).alias("final_equity"),
        )
        .withColumn("total_return", F.col("final_equity") / F.col("start_cash") - 1)
        .drop("start_cash")
    )


def _numbered(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ordinal of each trade among those of its side."""
    buy = (F.col("side") == "buy").cast("bigint")
    rows = running(trades, list(keys), {"nb": buy, "ns": 1 - buy}, "sum")
    return rows.select(
        *keys, "side", F.when(F.col("side") == "buy", F.col("nb")).otherwise(F.col("ns")).alias("ordinal"),
        "ts", "price",
    )


def fill_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = LEDGER_KEYS
) -> DataFrame:
    """Both ledgers side by side: entry to entry and exit to exit, in order."""
    side = lambda df, p: _numbered(df, keys).withColumnsRenamed({"ts": f"{p}_ts", "price": f"{p}_price"})
    pairs = side(left, "left").join(side(right, "right"), [*keys, "side", "ordinal"], "full_outer")
    return pairs.withColumn("date_differs", ~F.col("left_ts").eqNullSafe(F.col("right_ts"))).withColumn(
        "price_differs",
        F.coalesce(
            relative_diff(F.col("left_price"), F.col("right_price")) > PRICE_RELATIVE_TOLERANCE,
            F.lit(False),
        ),
    )


def divergences(
    left: DataFrame,
    right: DataFrame,
    left_final: DataFrame,
    right_final: DataFrame,
    keys: Sequence[str] = LEDGER_KEYS,
) -> DataFrame:
    """One record per disagreement, with what each side says.

    Pairs and final results are read by several kinds of records and made once.
    """
    keys = list(keys)
    pairs = materialize(fill_pairs(left, right, keys))
    text = lambda c: F.col(c).cast("string")
    dates = pairs.where("date_differs").select(
        *keys,
        F.when(F.col("side") == "buy", "entry_dates").otherwise("exit_dates").alias("field"),
        "ordinal",
        text("left_ts").alias("left_value"),
        text("right_ts").alias("right_value"),
        F.lit("dates differ exactly").alias("explanation"),
    )
    prices = pairs.where("price_differs").select(
        *keys,
        F.lit("execution_price").alias("field"),
        "ordinal",
        text("left_price").alias("left_value"),
        text("right_price").alias("right_value"),
        F.lit("relative difference exceeds 1e-9").alias("explanation"),
    )
    counts = pairs.groupBy(*keys).agg(
        F.count_if((F.col("side") == "sell") & F.col("left_ts").isNotNull()).alias("ls"),
        F.count_if((F.col("side") == "sell") & F.col("right_ts").isNotNull()).alias("rs"),
        F.count("left_ts").alias("lt"),
        F.count("right_ts").alias("rt"),
    )
    count_row = lambda a, b, field, why: counts.where(F.col(a) != F.col(b)).select(
        *keys, F.lit(field).alias("field"), F.lit(None).cast("bigint").alias("ordinal"),
        text(a).alias("left_value"), text(b).alias("right_value"), F.lit(why).alias("explanation"),
    )
    ends = materialize(
        left_final.select(*keys, F.col("final_equity").alias("le"), F.col("total_return").alias("lr")).join(
            right_final.select(*keys, F.col("final_equity").alias("re"), F.col("total_return").alias("rr")), keys
        )
    )
    end_row = lambda test, a, b, field, why: ends.where(test).select(
        *keys, F.lit(field).alias("field"), F.lit(None).cast("bigint").alias("ordinal"),
        text(a).alias("left_value"), text(b).alias("right_value"), F.lit(why).alias("explanation"),
    )
    return (
        dates.unionByName(prices)
        .unionByName(count_row("ls", "rs", "num_trades", "completed trade counts differ exactly"))
        .unionByName(count_row("lt", "rt", "execution_price_count", "different number of trades"))
        .unionByName(
            end_row(
                relative_diff(F.col("le"), F.col("re")) > EQUITY_RELATIVE_TOLERANCE,
                "le", "re", "final_equity", "relative difference exceeds 1e-9",
            )
        )
        .unionByName(
            end_row(
                ~is_close(F.col("lr"), F.col("rr"), RETURN_ABSOLUTE_TOLERANCE),
                "lr", "rr", "total_return", "absolute difference exceeds 1e-9",
            )
        )
    )


def ledger_reconcile(
    left: DataFrame,
    right: DataFrame,
    left_final: DataFrame,
    right_final: DataFrame,
    keys: Sequence[str] = LEDGER_KEYS,
) -> DataFrame:
    """One row per run: trade counts, disagreements and both final results."""
    keys = list(keys)
    pairs = fill_pairs(left, right, keys).groupBy(*keys).agg(
        F.count_if((F.col("side") == "sell") & F.col("left_ts").isNotNull()).alias("left_trades"),
        F.count_if((F.col("side") == "sell") & F.col("right_ts").isNotNull()).alias("right_trades"),
        F.count_if("date_differs").alias("date_mismatches"),
        F.count_if("price_differs").alias("price_mismatches"),
    )
    rename = lambda df, p: df.withColumnsRenamed(
        {"final_equity": f"{p}_final_equity", "total_return": f"{p}_total_return"}
    )
    le, re_ = F.col("left_final_equity"), F.col("right_final_equity")
    lr, rr = F.col("left_total_return"), F.col("right_total_return")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        rename(left_final, "left")
        .join(rename(right_final, "right"), keys)
        .join(pairs, keys, "left")
        .select(
            *keys,
            zero("left_trades"), zero("right_trades"), zero("date_mismatches"), zero("price_mismatches"),
            "left_final_equity", "right_final_equity", "left_total_return", "right_total_return",
            (relative_diff(le, re_) <= EQUITY_RELATIVE_TOLERANCE).alias("equity_agrees"),
            is_close(lr, rr, RETURN_ABSOLUTE_TOLERANCE).alias("return_agrees"),
        )
    )
