"""Exact decimals carried as text.

Prices arrive as decimal strings of any width. A fixed-width decimal type would
round silently, so equality is decided on a normal form of the text (sign,
digits without leading or trailing zeros, power of ten), which has no limit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: what counts as a finite and as a non-finite decimal text.
FINITE = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
NON_FINITE = r"(?i)\A[+-]?(inf|infinity|s?nan[0-9]*)\z"


def decimal_text(raw: Column) -> Column:
    """Outer white space and digit-group underscores carry no value."""
    return F.regexp_replace(raw, r"\A\s+|\s+\z|_", "")


def is_finite_decimal(raw: Column) -> Column:
    return F.coalesce(decimal_text(raw).rlike(FINITE), F.lit(False))


def is_non_finite_decimal(raw: Column) -> Column:
    return F.coalesce(decimal_text(raw).rlike(NON_FINITE), F.lit(False))


def normal_form(raw: Column) -> Column:
    """``[-]<digits>E<power>``; equal exactly when the decimals are equal. NULL for other text."""
    text = decimal_text(raw)
    mantissa = F.regexp_extract(text, r"\A[+-]?([0-9.]+)", 1)
    power_text = F.regexp_extract(text, r"[eE]([+-]?[0-9]+)\z", 1)
    power = F.coalesce(power_text.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    fraction = F.regexp_extract(mantissa, r"\.([0-9]*)\z", 1)
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.", ""), r"\A0+", "")
    kept = F.regexp_replace(digits, r"0+\z", "")
    scale = power - F.length(fraction) + (F.length(digits) - F.length(kept))
    sign = F.when(text.startswith("-"), "-").otherwise("")
    form = F.when(kept == "", "0").otherwise(F.concat(sign, kept, F.lit("E"), scale.cast("string")))
    return F.when(is_finite_decimal(raw), form)


def to_double(raw: Column) -> Column:
    """Nearest double of the exact text."""
    return decimal_text(raw).cast("double")
