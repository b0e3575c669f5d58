"""Numbers that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallytree.functions.text import _col


def to_double(column: Column | str) -> Column:
    """Text to DOUBLE; text that is no number becomes NULL, ``INF`` becomes infinity."""
    return _col(column).try_cast("double")


def scale_fact(fact: Column | str, decimals: Column | str) -> Column:
    """Reported value times ten to the power of its decimals; NULL if either is missing."""
    return to_double(fact) * F.pow(F.lit(10.0), to_double(decimals))


def is_finite_or_null(column: Column | str) -> Column:
    """False only for plus or minus infinity."""
    value = _col(column)
    return F.coalesce(F.abs(value) != F.lit(float("inf")), F.lit(True))


def sum_or_zero(column: Column | str) -> Column:
    """Sum of a group in which a group of missing values only sums to zero."""
    return F.coalesce(F.sum(_col(column)), F.lit(0.0))


#: Powers of ten in this range print no wider as digits than with an exponent.
FIXED_FORM = (-3, 4)


def units_label(decimals: Column | str) -> Column:
    """``-3`` prints ``1000's``, ``-6`` prints ``1e+06's``: the shorter form, digits if both are as wide.

    Other numbers print as they are, infinite decimals as ``0's``, a missing value as ``NA's``.
    """
    digits = to_double(decimals)
    unit = F.lit(1.0) / F.pow(F.lit(10.0), digits)
    power = (-digits).try_cast("int")
    size = F.abs(power).cast("string")
    low, high = FIXED_FORM
    # The digits are written out, for a computed 0.001 is not exactly that.
    fixed = F.when(power >= 0, F.rpad(F.lit("1"), power + 1, F.lit("0"))).otherwise(
        F.concat(F.lit("0."), F.lpad(F.lit("1"), -power, F.lit("0"))))
    exponent = F.concat(F.when(power < 0, "1e-").otherwise("1e+"), F.lpad(size, F.greatest(F.lit(2), F.length(size)), F.lit("0")))
    is_power = digits == -power.cast("double")
    whole = F.when(unit == F.floor(unit), unit.try_cast("bigint").cast("string"))
    other = F.coalesce(whole, unit.cast("string"), F.lit("NA"))
    text = F.when(is_power & power.between(low, high), fixed).when(is_power, exponent).otherwise(other)
    return F.concat(text, F.lit("'s"))
