"""Scalar comparisons and checks on numeric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def is_infinite(value: Column) -> Column:
    return value.isin(_INF, -_INF)


def missing(value: Column) -> Column:
    """NULL or NaN."""
    return value.isNull() | F.isnan(value)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def relative_diff(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))


def is_close(a: Column, b: Column, abs_tol: float, rel_tol: float = 1e-9) -> Column:
    """True within either tolerance, whichever is wider."""
    widest = F.greatest(F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_tol))
    return F.abs(a - b) <= widest


def sign_positive(value: Column) -> Column:
    """Zero counts as positive."""
    return value >= 0
