"""Exact medians of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapecheck.operators.blocks import numbered, running

#: Distinct values of a group that are added up in one place.
CHUNK_VALUES = 4096


def exact_median(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, count, median``; of an even number the mean of the two in the middle, as :func:`statistics.median` gives.

    Nothing of a group is buffered: equal values are counted first, distinct values are put in order by ranges
    (:func:`tapecheck.operators.blocks.numbered`), and running counts over chunks of them, which meet chunk by chunk,
    tell the one or two that lie in the middle. NULLs are left out; a group without a value has no row.
    """
    keys = list(keys)
    by = keys or ["__all"]
    given = rows if keys else rows.withColumn("__all", F.lit(0))
    counts = given.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    ordered = numbered(counts, by, ("__value",), "__place").withColumn("chunk", F.floor(F.col("__place") / CHUNK_VALUES))
    upto = running(ordered, by, {"__upto": F.col("__n")}, "sum", order=("__place",))
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("count"))
    low, high = F.floor((F.col("count") - 1) / 2), F.floor(F.col("count") / 2)
    at = lambda place: (F.col("__upto") > place) & (F.col("__upto") - F.col("__n") <= place)
    middle = upto.join(totals, by).where(at(low) | at(high))
    return middle.groupBy(*by, "count").agg(((F.min("__value") + F.max("__value")) / 2).alias("median")).select(*keys, "count", "median")
