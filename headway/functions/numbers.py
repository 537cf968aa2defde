"""Number helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_to(value: Column, digits: int) -> Column:
    """Round half away from zero on the binary value, so 1.005 gives 1.0 and not 1.01."""
    scale = float(10 ** digits)
    return F.round(value * F.lit(scale), 0) / F.lit(scale)


def round_mean(value: Column, digits: int) -> Column:
    """``round_to`` for results of a floating sum.

    The last bits of such a sum depend on the order rows arrive in; they are cut off first, so a
    value on a rounding boundary comes out the same on every run.
    """
    return round_to(round_to(value, 9), digits)


def blank_to_null(value: Column) -> Column:
    """Protobuf leaves absent text as '', which means the same as null here; other text is unchanged."""
    return F.when(F.trim(value) != "", value)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def percent_of(condition: Column, digits: int = 1) -> Column:
    """Share of rows that meet a condition, in percent (an aggregate)."""
    hits = F.sum(F.when(condition, 1).otherwise(0))
    return round_to(F.lit(100.0) * hits / F.nullif(F.count(F.lit(1)), F.lit(0)), digits)
