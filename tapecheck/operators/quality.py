"""Rules that data must satisfy, reported as rows instead of exceptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapecheck.constants import (
    ACTION_RANGE,
    BAR_COLUMNS,
    DEPENDENCY_KEYS,
    NUMERIC_COLUMNS,
    PRICE_COLUMNS,
    PROVIDER_COLUMNS,
    REGISTRY_REQUIRED,
)
from tapecheck.functions.documents import whole_document
from tapecheck.functions.numbers import is_infinite, missing, nan_to_null
from tapecheck.operators.blocks import with_earlier
from tapecheck.operators.timeline import within

# Bars per slice when arrival order is checked.
ARRIVAL_SLICE = 100_000


class ViolationError(ValueError):
    """Raised by :func:`require_empty`."""


def require_empty(violations: DataFrame, what: str) -> None:
    """Fail, naming a few violations, unless there are none."""
    some = violations.limit(5).collect()
    if some:
        raise ViolationError(f"{what}: {[row.asDict() for row in some]}")


def canonical_bars(raw: DataFrame) -> DataFrame:
    """Rename the five provider columns, keep ``symbol`` and ``ts``, drop the rest."""
    absent = [c for c in ("symbol", "ts", *PROVIDER_COLUMNS) if c not in raw.columns]
    if absent:
        raise ValueError(f"missing provider columns: {absent}")
    return raw.select("symbol", "ts", *[F.col(a).alias(b) for a, b in PROVIDER_COLUMNS.items()])


def check_bar_types(bars: DataFrame) -> None:
    """Columns present and numeric; checked on the schema, before any row."""
    absent = [c for c in BAR_COLUMNS if c not in bars.columns]
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    for name in NUMERIC_COLUMNS:
        kind = bars.schema[name].dataType
        if isinstance(kind, T.BooleanType):
            raise ValueError(f"column '{name}' contains boolean values")
        if not isinstance(kind, T.NumericType):
            raise ValueError(f"column '{name}' is not numeric ({kind.simpleString()})")


def _bar_rules() -> dict[str, Column]:
    price = {c: nan_to_null(F.col(c).cast("double")) for c in NUMERIC_COLUMNS}
    any_of = lambda columns: F.exists(F.array(*columns), lambda x: F.coalesce(x, F.lit(False)))
    number = [F.col(c).cast("double") for c in NUMERIC_COLUMNS]
    return {
        "missing_value": F.col("ts").isNull() | any_of([missing(c) for c in number]),
        "infinite_value": any_of([is_infinite(c) for c in number]),
        "non_positive_price": any_of([price[c] <= 0 for c in PRICE_COLUMNS]),
        "negative_volume": price["volume"] < 0,
        "high_below_bar": price["high"] < F.greatest(price["open"], price["close"], price["low"]),
        "low_above_bar": price["low"] > F.least(price["open"], price["close"], price["high"]),
    }


def _rule_rows(counts: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in names])
    return counts.select(*keys, F.inline(items)).where("rows > 0")


def ohlcv_violations(
    bars: DataFrame, arrival: str | None = None, expected: DataFrame | None = None
) -> DataFrame:
    """``symbol, rule, rows`` for every broken rule.

    ``arrival`` names a column with the order rows came in; with it, series that
    are not ascending are reported too (ties are a separate rule). ``expected``
    lists symbols that must have at least one bar.
    """
    check_bar_types(bars)
    rules = _bar_rules()
    counts = (
        bars.groupBy("symbol", "ts")
        .agg(F.count("*").alias("copies"), *[F.count_if(c).alias(n) for n, c in rules.items()])
        .groupBy("symbol")
        .agg(
            F.sum(F.col("copies") - 1).alias("duplicate_ts"),
            *[F.sum(n).alias(n) for n in rules],
        )
    )
    out = _rule_rows(counts, ["symbol"], ["duplicate_ts", *rules])
    if arrival is not None:
        out = out.unionByName(_unordered_arrivals(bars, arrival))
    if expected is not None:
        empty = expected.select("symbol").join(bars.select("symbol").distinct(), "symbol", "left_anti")
        out = out.unionByName(empty.select("symbol", F.lit("empty").alias("rule"), F.lit(1).cast("bigint").alias("rows")))
    return out


def _unordered_arrivals(bars: DataFrame, arrival: str) -> DataFrame:
    """Rows older than one that arrived before them, slice by slice."""
    rows = bars.select("symbol", "ts", arrival).withColumn(
        "chunk", F.floor(F.col(arrival) / ARRIVAL_SLICE)
    )
    earlier = (
        Window.partitionBy("symbol", "chunk").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    )
    slices = (
        rows.withColumn("late", F.coalesce(F.col("ts") < F.max("ts").over(earlier), F.lit(False)))
        .groupBy("symbol", "chunk")
        .agg(F.max("ts").alias("newest"), F.min("ts").alias("oldest"), F.count_if("late").alias("late"))
    )
    slices = with_earlier(slices, ["symbol"], {"newest_before": ("max", F.col("newest"))})
    overlap = F.coalesce(F.col("oldest") < F.col("newest_before"), F.lit(False))
    return slices.groupBy("symbol").agg(
        F.max((F.col("late") > 0) | overlap).alias("bad")
    ).where("bad").select("symbol", F.lit("not_ascending").alias("rule"), F.lit(1).cast("bigint").alias("rows"))


def corporate_actions(
    actions: DataFrame, start: str = ACTION_RANGE[0], end: str = ACTION_RANGE[1]
) -> DataFrame:
    """Splits must be exactly zero in the range; dividends are only described.

    A missing split value is not zero and fails the guard.
    """
    if "stock_splits" not in actions.columns:
        raise ValueError("the raw table has no stock_splits column to check")
    nonzero = lambda c: ~F.col(c).eqNullSafe(F.lit(0.0))
    paid = nonzero("dividends") if "dividends" in actions.columns else F.lit(False)
    inside = within(F.col("ts"), start, end)
    return actions.groupBy("symbol").agg(
        F.count_if(inside & nonzero("stock_splits")).alias("split_events"),
        F.count_if(inside & paid).alias("dividend_events"),
        F.min(F.when(inside & paid, F.col("ts"))).alias("first_dividend"),
        F.max(F.when(inside & paid, F.col("ts"))).alias("last_dividend"),
    ).withColumn("status", F.when(F.col("split_events") == 0, "ok").otherwise("unsupported_split"))


def _named(rules: dict[str, Column]) -> Column:
    """Names of the rules that are true, as rows."""
    flagged = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]
    return F.explode(F.filter(F.array(*flagged), lambda r: r.isNotNull()))


def gap_metadata_violations(meta: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rules for the gap and volume-unit metadata of a provider snapshot.

    Without a provider none of the fields may be set; with one they must be
    complete, dates well-formed, unique and ascending, and the count right.
    """
    days, count = F.col("missing_days"), F.col("missing_day_count")
    units = ("volume_unit_status", "volume_unit_inference", "volume_unit_evidence")
    fields = [*units, "volume_unit", "missing_days", "missing_day_count"]
    has = F.col("provider").isNotNull()
    required = [*units, "missing_days", "missing_day_count"]
    any_null = F.exists(F.array(*[F.col(c).isNull() for c in required]), lambda x: x)
    any_set = F.exists(F.array(*[F.col(c).isNotNull() for c in fields]), lambda x: x)
    date_ok = lambda d: F.coalesce(
        d.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & d.try_cast("date").isNotNull(), F.lit(False)
    )
    rules = {
        "field_without_provider": ~has & any_set,
        "required_field_missing": has & any_null,
        "negative_count": has & (count < 0),
        "bad_date": has & F.exists(days, lambda d: ~date_ok(d)),
        "duplicate_date": has & (F.size(F.array_distinct(days)) != F.size(days)),
        "not_ascending": has & (F.array_sort(days) != days),
        "count_mismatch": has & (F.size(days) != count),
        "blank_unit_text": has
        & (
            F.exists(F.array(*[F.coalesce(F.col(c), F.lit("-")) == "" for c in units]), lambda x: x)
            | F.coalesce(F.col("volume_unit") == "", F.lit(False))
        ),
    }
    return meta.select(*keys, _named(rules).alias("rule"))


def registry_violations(records: DataFrame, keys: Sequence[str] = ("experiment_id",)) -> DataFrame:
    """Broken parts of the finalized/dev record contract, with the ``keys`` of the record."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    final = F.col("record_status") == "finalized"
    versions = F.col("dependency_versions_json")
    filled = ~blank("dependency_versions_json")
    parsed = whole_document(versions)
    names = F.when(parsed.isNotNull(), F.json_object_keys(versions))
    rules = {
        "unknown_status": ~F.coalesce(F.col("record_status").isin("finalized", "dev"), F.lit(False)),
        **{f"missing_{c}": final & blank(c) for c in REGISTRY_REQUIRED},
        "working_tree_not_clean": final & ~F.coalesce(F.col("working_tree_clean") == "true", F.lit(False)),
        "versions_not_json": final & filled & parsed.isNull(),
        "versions_not_object": final & filled & parsed.isNotNull() & names.isNull(),
        "versions_key_missing": final
        & names.isNotNull()
        & (F.size(F.array_intersect(names, F.array(*[F.lit(k) for k in DEPENDENCY_KEYS]))) < len(DEPENDENCY_KEYS)),
    }
    return records.select(*keys, _named(rules).alias("rule"))
