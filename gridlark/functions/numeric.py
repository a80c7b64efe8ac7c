"""Number handling: finiteness, coercion, rounding, exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(18,4)"


def nan_to_null(value: Column) -> Column:
    """NaN means missing; Spark aggregates would otherwise return NaN."""
    return F.when(~F.isnan(value), value)


def is_finite(value: Column) -> Column:
    """Never NULL: false for NULL, NaN and both infinities."""
    number = value.cast("double")
    return F.coalesce(
        ~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), F.lit(False)
    )


def lenient_number(text: Column) -> Column:
    return nan_to_null(text.try_cast("double"))


def strict_number(text: Column) -> Column:
    return text.cast("double")


def is_whole(value: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(value - F.round(value)) <= F.lit(tolerance) + F.lit(1e-5) * F.abs(F.round(value))


def at_least_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def half_up(value: Column) -> Column:
    """floor(x + 0.5) on doubles."""
    return F.floor(value + F.lit(0.5)).cast("long")


def half_up_exact(value: Column) -> Column:
    """Half-up on the shortest decimal text of the double."""
    return F.round(value, 0).cast("long")


def clamp_unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def lift(base: Column, other: Column) -> Column:
    """Relative gain of ``other`` over ``base``; NULL unless base is positive."""
    return F.when(base > 0, (base - other) / base)


def lift_percent(base: Column, other: Column) -> Column:
    return lift(base, other) * 100
