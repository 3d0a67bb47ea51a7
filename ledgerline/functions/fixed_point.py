"""Exact sums of amounts that are stored as doubles with two decimals.

Adding doubles gives a result that depends on the order of the rows, so on the
file layout and on which tasks were retried. Adding whole units does not. All
expressions here are built-in functions and stay inside generated code; a cast
of each double to a decimal would give the same sums several times slower.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits in the low part of a wide sum. The low part overflows past 2^43 rows in a
# group, the high part past 2^83 units in total.
LOW_BITS = 20
# Single amounts and products stay below 2^62 units.
MOST_UNITS = 2.0**62


def hundredths(amount: Column) -> Column:
    """``amount`` as a whole number of hundredths (bigint).

    NULL stays NULL. A value that is not a whole number of hundredths, or is past
    2^62 of them, raises an error with and without ANSI mode, as rounding or wrapping
    it would change the totals without notice.
    """
    units = F.rint(amount * 100).cast("bigint")
    return F.when(
        (F.abs(amount * 100) >= MOST_UNITS) | (units / 100 != amount),
        F.raise_error(
            F.concat(F.lit("not a whole number of hundredths: "), amount.cast("string"))
        ).cast("bigint"),
    ).otherwise(units)


def product(one: Column, other: Column) -> Column:
    """The product of two bigint columns; one past 2^62 raises an error in any mode."""
    about = one.cast("double") * other.cast("double")
    return F.when(
        F.abs(about) >= MOST_UNITS,
        F.raise_error(F.concat(F.lit("product out of range: "), about.cast("string"))).cast("bigint"),
    ).otherwise(one * other)


def wide_sum(units: Column) -> Column:
    """Sum of a bigint column as ``decimal(29,0)``, past the range of a bigint.

    Two bigint sums, of the high bits and of the low bits, are cheaper per row
    than one decimal sum. They are put together once per group. A part that overflows
    raises an error with and without ANSI mode.
    """

    def part(bits: Column) -> Column:
        total = F.try_sum(bits)
        return F.when(
            total.isNull() & (F.count(units) > 0), F.raise_error(F.lit("sum out of range")).cast("bigint")
        ).otherwise(total).cast("decimal(20,0)")

    high = part(F.shiftright(units, LOW_BITS))
    low = part(units.bitwiseAND(F.lit(2**LOW_BITS - 1)))
    return high * F.lit(2**LOW_BITS) + low


def from_hundredths(total: Column) -> Column:
    """A ``wide_sum`` of hundredths as a double, rounded once."""
    return (total * F.lit("0.01").cast("decimal(2,2)")).cast("double")


def from_ten_thousandths(total: Column) -> Column:
    """A ``wide_sum`` of ten-thousandths as a double, rounded once."""
    return (total * F.lit("0.0001").cast("decimal(4,4)")).cast("double")
