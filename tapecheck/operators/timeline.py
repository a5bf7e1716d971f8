"""Splits, evaluation windows, completed buckets, request plans and gaps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapecheck.constants import ALLOWED_SPLITS, DAY_SECONDS, HISTORY_FLOOR, MAX_REQUEST_DAYS, REQUEST_DAYS
from tapecheck.operators.blocks import epoch_seconds

Split = tuple[str, str, str]


def stamp(value) -> Column:
    """A literal zone-free timestamp."""
    return F.lit(str(value)).cast("timestamp_ntz")


def within(ts: Column, start, end) -> Column:
    """Half-open membership."""
    return (ts >= stamp(start)) & (ts < stamp(end))


# --- splits -----------------------------------------------------------------


def check_splits(splits: Sequence[Split]) -> None:
    """Fail with the first broken rule of a list of splits; the rules are those of :func:`split_violations`."""
    spans = [(datetime.fromisoformat(a), datetime.fromisoformat(b)) for _, a, b in splits]
    _refuse(
        ("empty", [] if spans else ["the list"]),
        ("start_not_before_end", [n for (n, *_), (a, b) in zip(splits, spans) if a >= b]),
        ("overlap_or_disorder", [s[0] for s, (_, end), (begin, _) in zip(splits[1:], spans, spans[1:]) if begin < end]),
        ("gap", [s[0] for s, (_, end), (begin, _) in zip(splits[1:], spans, spans[1:]) if begin > end]),
    )


def _refuse(*rules: tuple[str, list]) -> None:
    """Raise for the first rule that names an offender."""
    for rule, offenders in rules:
        if offenders:
            raise ValueError(f"{rule}: {offenders[0]}")


def split_violations(splits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same rules on a table ``keys, position, name, start, end_exclusive``."""
    order = Window.partitionBy(*keys).orderBy("position")
    rows = splits.withColumn("prev_end", F.lag("end_exclusive").over(order))
    rule = F.filter(
        F.array(
            F.when(~(F.col("start") < F.col("end_exclusive")), "start_not_before_end"),
            F.when(F.col("prev_end") > F.col("start"), "overlap_or_disorder"),
            F.when(F.col("prev_end") < F.col("start"), "gap"),
        ),
        lambda r: r.isNotNull(),
    )
    return rows.select(*keys, "position", "name", F.explode(rule).alias("rule"))


def split_name(splits: Sequence[Split], ts: str = "ts") -> Column:
    """Name of the split a timestamp falls in, NULL outside all of them."""
    check_splits(splits)
    cases = [F.when(within(F.col(ts), a, b), F.lit(n)) for n, a, b in splits]
    return F.coalesce(*cases)


def split_label(bars: DataFrame, splits: Sequence[Split]) -> DataFrame:
    return bars.withColumn("split", split_name(splits))


def split_rows(bars: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """Rows inside some split, labelled; rows outside all splits are dropped.

    Splits are contiguous, so their outer bounds say the same in a form that reaches the scan.
    """
    check_splits(splits)
    return split_label(bars.where(within(F.col("ts"), splits[0][1], splits[-1][2])), splits).where("split is not null")


def research_filter(
    bars: DataFrame, splits: Sequence[Split], allowed: Sequence[str] = ALLOWED_SPLITS
) -> DataFrame:
    """Only rows of the allowed splits.

    The bounds are literals, so the condition reaches the Parquet scan and
    sealed rows are not read at all.
    """
    check_splits(splits)
    keep = [within(F.col("ts"), a, b) for n, a, b in splits if n in allowed]
    if len(keep) != len(allowed):
        raise ValueError(f"splits do not define all of {tuple(allowed)}")
    return bars.where(reduce(lambda a, b: a | b, keep))


# --- evaluation windows -----------------------------------------------------


@dataclass(frozen=True)
class Period:
    """A half-open evaluation window; ``name`` is its calendar year."""

    name: int
    start: str
    end: str


def build_windows(burn_in_year: int, years: Sequence[int]) -> tuple[Period, list[Period]]:
    """Calendar years as windows: the one before the first, and ``years``, which must follow one another."""
    wanted = [*range(burn_in_year + 1, burn_in_year + 1 + len(years))]
    _refuse(
        ("no_years", [] if years else ["the list"]),
        ("year_not_after_the_one_before", [y for y, w in zip(years, wanted) if y != w]),
    )
    first, *rest = [Period(y, f"{y}-01-01", f"{y + 1}-01-01") for y in (burn_in_year, *wanted)]
    return first, rest


def windows_of_history(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per calendar year a series covers; its first year is burn-in."""
    span = bars.groupBy(*keys).agg(
        F.year(F.min("ts")).alias("first_year"), F.year(F.max("ts")).alias("last_year")
    )
    return span.select(
        *keys,
        F.explode(F.sequence("first_year", "last_year")).alias("window"),
        "first_year",
    ).select(
        *keys,
        "window",
        F.make_date("window", F.lit(1), F.lit(1)).cast("timestamp_ntz").alias("start"),
        F.make_date(F.col("window") + 1, F.lit(1), F.lit(1)).cast("timestamp_ntz").alias("end"),
        (F.col("window") == F.col("first_year")).alias("burn_in"),
    )


def window_name(windows: Sequence[Period], ts: str = "ts") -> Column:
    return F.coalesce(*[F.when(within(F.col(ts), w.start, w.end), F.lit(w.name)) for w in windows])


def window_rows(rows: DataFrame, windows: Sequence[Period]) -> DataFrame:
    """Rows that lie in some window, labelled with it."""
    rows = rows.where(within(F.col("ts"), min(w.start for w in windows), max(w.end for w in windows)))
    return rows.withColumn("window", window_name(windows)).where("window is not null")


def window_array(windows: Sequence[Period]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(w.name).alias("window"),
                stamp(w.start).alias("start"),
                stamp(w.end).alias("end"),
            )
            for w in windows
        ]
    )


def boundaries(windows: Sequence[Period]) -> list[str]:
    return sorted({w.start for w in windows} | {w.end for w in windows})


def segment(bounds: Sequence[str], ts: str = "ts") -> Column:
    """How many boundaries are at or before a timestamp."""
    return reduce(
        lambda a, b: a + b, [F.when(F.col(ts) >= stamp(b), 1).otherwise(0) for b in bounds]
    )


def as_of_boundaries(
    rows: DataFrame,
    bounds: Sequence[str],
    keys: Sequence[str],
    values: Sequence[str],
) -> DataFrame:
    """Latest values strictly before each boundary, for every key of ``rows``.

    A boundary without an earlier row has NULL ``ts`` and values. Rows are first reduced to
    one per key and segment, so only a handful of rows per key meet the boundaries.
    """
    bounds = sorted(bounds)
    latest = (
        rows.groupBy(*keys, segment(bounds).alias("seg"))
        .agg(F.max("ts").alias("ts"), *[F.max_by(v, "ts").alias(v) for v in values])
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("seg", "ts", *values)).alias("latest"))
        .select(*keys, "latest", F.posexplode(F.array(*[stamp(b) for b in bounds])).alias("b", "boundary"))
        .withColumn("at", F.array_max(F.filter("latest", lambda x: x["seg"] <= F.col("b"))))
    )
    return latest.select(*keys, "b", "boundary", "at.ts", *[f"at.{v}" for v in values])


def equity_before(
    curve: DataFrame, bounds: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Last equity strictly before each boundary, and a ``status`` where there is none."""
    status = F.when(F.col("ts").isNull(), "no_earlier_row").otherwise("ok")
    return as_of_boundaries(curve, bounds, keys, ["equity"]).drop("b").withColumn("status", status)


# --- buckets, plans, gaps ---------------------------------------------------


def completed_buckets(bars: DataFrame, now: Column) -> DataFrame:
    """Daily buckets that have ended by ``now``.

    Rows that do not start at midnight are no daily buckets; :func:`bucket_violations` lists them.
    """
    return bars.where((F.col("ts") <= now - F.expr("INTERVAL 1 DAY")) & _at_midnight())


def bucket_violations(bars: DataFrame) -> DataFrame:
    """Rows that cannot be daily buckets, with the ``rule`` they break."""
    rule = F.when(F.col("ts").isNull(), "missing_start").when(~_at_midnight(), "start_not_midnight")
    return bars.withColumn("rule", rule).where("rule is not null")


def _at_midnight() -> Column:
    return F.col("ts").cast("date").cast("timestamp_ntz") == F.col("ts")


def last_completed_bucket(now: Column) -> Column:
    return now.cast("date").cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY")


def plan_windows(
    requests: DataFrame,
    now: Column,
    keys: Sequence[str] = ("symbol",),
    floor: str = HISTORY_FLOOR,
    days: int = REQUEST_DAYS,
) -> DataFrame:
    """Contiguous inclusive request windows, oldest first, up to yesterday.

    A series whose ``now`` is too early for the floor gets one row without a window and the
    ``status`` ``too_early``. The limit on ``days`` is the provider's.
    """
    if not 1 <= days <= MAX_REQUEST_DAYS:
        raise ValueError(f"days must be between 1 and {MAX_REQUEST_DAYS} inclusive")
    first, last = F.lit(floor).cast("date"), last_completed_bucket(now).cast("date")
    step = F.expr(f"INTERVAL {days} DAYS")
    starts = F.when(last >= first, F.sequence(first, last, step))
    planned = requests.select(*keys, last.alias("last"), F.posexplode_outer(starts).alias("page_no", "first_day"))
    end = F.when(F.col("first_day").isNotNull(), F.least(F.date_add("first_day", days - 1), "last"))
    return planned.select(
        *keys,
        "page_no",
        "first_day",
        end.alias("last_day"),
        (F.datediff(end, "first_day") + 1).alias("day_count"),
        (F.unix_date("first_day").cast("bigint") * DAY_SECONDS).cast("string").alias("request_start"),
        (F.unix_date(end).cast("bigint") * DAY_SECONDS).cast("string").alias("request_end"),
        F.when(F.col("first_day").isNull(), "too_early").otherwise("ok").alias("status"),
    )


def calendar_gaps(
    buckets: DataFrame, planned_last: DataFrame, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Days from the earliest returned to the last planned bucket that are absent.

    ``buckets`` has ``keys, ts``; ``planned_last`` has ``keys, last_day``. Days
    before the first bucket are not gaps, and gaps are reported, never filled.
    """
    days = buckets.select(*keys, F.col("ts").cast("date").alias("day"))
    span = days.groupBy(*keys).agg(F.min("day").alias("first_day")).join(planned_last, list(keys))
    span = span.where("first_day <= last_day")
    calendar = span.select(*keys, F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return calendar.join(days, [*keys, "day"], "left_anti")


def history_summary(
    buckets: DataFrame, planned_last: DataFrame, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Earliest, latest, count, and the list and number of missing days."""
    keys = list(keys)
    facts = buckets.groupBy(*keys).agg(
        F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.count("*").alias("candle_count")
    )
    gaps = calendar_gaps(buckets, planned_last, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.col("day").cast("string"))).alias("missing_days"),
    )
    missing = F.coalesce("missing_days", F.expr("cast(array() as array<string>)"))
    return facts.join(gaps, keys, "left").select(
        *keys,
        "earliest",
        "latest",
        "candle_count",
        missing.alias("missing_days"),
        F.size(missing).cast("bigint").alias("missing_day_count"),
    )
