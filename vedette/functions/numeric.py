"""Rounding and exact aggregates.

Float sums depend on row order, so money and averages are summed as decimals:
the same rows give the same answer whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

US = 1_000_000
MINUTE_US = 60 * US
HOUR_US = 3600 * US
DAY_US = 24 * HOUR_US


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(c: str | Column, digits: int) -> Column:
    """Half-up rounding by plain double arithmetic (identical on every engine)."""
    p = float(10**digits)
    return F.floor(as_col(c) * F.lit(p) + F.lit(0.5)).cast("double") / F.lit(p)


def clamp(c: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), as_col(c)))


def exact_sum(c: str | Column, scale: int = 2) -> Column:
    return F.sum(as_col(c).cast(f"decimal({20 + scale},{scale})")).cast("double")


def exact_avg(c: str | Column, scale: int = 6) -> Column:
    c = as_col(c)
    n = F.nullif(F.count(c), F.lit(0)).cast("double")
    return F.sum(c.cast(f"decimal({20 + scale},{scale})")).cast("double") / n


def div_us(c: str | Column, width: int) -> Column:
    """Floor division of a microsecond column."""
    c = as_col(c)
    return F.call_function("div", c - F.pmod(c, F.lit(width)), F.lit(width)).cast("bigint")


def floor_us(c: str | Column, width: int) -> Column:
    c = as_col(c)
    return c - F.pmod(c, F.lit(width))
