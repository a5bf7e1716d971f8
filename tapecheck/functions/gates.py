"""Metrics that may be undefined, as columns instead of misleading numbers.

A gated metric is a value and a status: ``ok``, ``insufficient_sample`` (with
the required and the actual number of observations) or ``not_applicable``.
The value is NULL unless the status is ``ok``; it is never NaN or infinite.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OK = "ok"
INSUFFICIENT = "insufficient_sample"
NOT_APPLICABLE = "not_applicable"


def gate_status(actual: Column, required: int, undefined: Column | None = None) -> Column:
    """Sample size is checked before the value's own definedness."""
    status = F.when(actual < required, F.lit(INSUFFICIENT))
    if undefined is not None:
        status = status.when(undefined, F.lit(NOT_APPLICABLE))
    return status.otherwise(F.lit(OK))


def gated(
    name: str, value: Column, actual: Column, required: int, undefined: Column | None = None
) -> list[Column]:
    """``<name>``, ``<name>_status``, and where the sample is too small ``<name>_required`` and ``<name>_actual``.

    No observations at all (NULL) count as none.
    """
    actual = F.coalesce(actual, F.lit(0)).cast("bigint")
    status = gate_status(actual, required, undefined)
    short = status == INSUFFICIENT
    return [
        F.when(status == OK, value).alias(name),
        status.alias(f"{name}_status"),
        F.when(short, F.lit(required)).alias(f"{name}_required"),
        F.when(short, actual).alias(f"{name}_actual"),
    ]
