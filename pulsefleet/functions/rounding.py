"""Half-even rounding of doubles at the output edge, as the double itself says.

A double is rounded by its exact binary value: 2.675 lies just below its decimal form, so it rounds
to 2.67. The product with a power of ten is taken without error, as the nearest double and what it is
off by, so that ties are ties and near ties are not. Means are sums over ``decimal(38,6)`` divided
once, so they do not depend on the order in which tasks add up.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


#: Splits a double into halves of 26 bits, whose products with powers of ten up to 1000 are exact.
SPLIT = 134217729.0
#: From here on a double scaled has no digits behind the point; rounding leaves it as it is.
WHOLE = 2.0**53


def exactly_scaled(value: Column, power: float) -> Column:
    """The nearest whole number to value * power, ties to even, for products under WHOLE."""
    near = value * power
    high = value * SPLIT - (value * SPLIT - value)
    off = (high * power - near) + (value - high) * power
    # value * power = near + off exactly; take a whole number off that is not above it.
    below = F.floor(near) - F.when((near == F.floor(near)) & (off < 0), 1).otherwise(0)
    over_half = ((near - below) - 0.5) + off
    up = (over_half > 0) | ((over_half == 0) & (F.pmod(below, F.lit(2)) == 1))
    return (below + F.when(up, 1).otherwise(0)).cast("double")


def half_even(value: Column | str, digits: int = 2) -> Column:
    """Double rounded to 0 to 3 digits; null stays null, what no double can hold is null too."""
    col = column(value).try_cast("double")
    if digits == 0:
        return F.rint(col)
    power = 10.0**digits
    scaled = col * power
    # Only near ties need the exact product; NaN and infinities stay what they are.
    tie = F.abs(F.abs(scaled - F.rint(scaled)) - 0.5) <= F.abs(scaled) * 1e-12 + 1e-9
    large = (F.abs(scaled) >= WHOLE) | F.isnan(scaled)
    return F.when(large, col).when(tie, exactly_scaled(col, power) / power).otherwise(F.rint(scaled) / power)


def whole(value: Column | str) -> Column:
    """Nearest int, ties to even; null stays null, and what no int can hold is null."""
    return half_even(value, 0).try_cast("int")


def minutes(seconds: Column | str) -> Column:
    return whole(column(seconds).try_cast("double") / 60)


def mean(value: Column | str, over: WindowSpec | None = None) -> Column:
    """Mean over the group or the window, summed exactly to six decimals."""
    col = column(value)
    total, n = F.try_sum(col.try_cast("decimal(38,6)")), F.count(col)
    if over is not None:
        total, n = total.over(over), n.over(over)
    return F.try_divide(total.cast("double"), n)
