"""Counting, ratio and rounding expressions.

Sums are 64-bit integers: counts, days, and money in cents, which aggregate and
shuffle at a fraction of the cost of wide decimals and stay exact. Ratios are
formed in decimal and rounded half away from zero; only the rounded value becomes
a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leaves the decimal division of two sums at least fourteen fractional digits.
_SUM = "decimal(20,0)"


def count_rows() -> Column:
    return F.count(F.lit(1))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def count_where(condition: Column) -> Column:
    """Rows that meet the condition; NULL, not 0, when there is no row at all."""
    return F.sum(flag(condition))


def total(column: Column | str) -> Column:
    """Sum that is 0 on empty input, for adding up counts."""
    return F.coalesce(F.sum(column), F.lit(0))


def cents(amount: Column | str) -> Column:
    """A decimal amount of two places as a whole number of cents."""
    return (_col(amount) * 100).cast("bigint")


def money(cent_sum: Column | str) -> Column:
    """Cents as a double with two places."""
    return (_col(cent_sum).cast(_SUM) / 100).cast("double")


def mean(part: Column | str, count: Column | str, places: int) -> Column:
    """Rounded sum per count; NULL when the count is 0."""
    return _rounded(_col(part).cast(_SUM), _col(count).cast(_SUM), places)


def mean_money(cent_sum: Column | str, count: Column | str) -> Column:
    """Rounded amount per count; NULL when the count is 0."""
    return _rounded(_col(cent_sum).cast(_SUM), _col(count).cast(_SUM) * 100, 2)


def percent(part: Column | str, whole: Column | str) -> Column:
    """Rounded percentage of two sums; NULL when the whole is 0."""
    return _rounded(_col(part).cast(_SUM) * 100, _col(whole).cast(_SUM), 2)


def _rounded(numerator: Column, denominator: Column, places: int) -> Column:
    return F.round(F.try_divide(numerator, denominator), places).cast("double")


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
