"""Quote-level scalar features."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strike(strike_x1000="strike_price") -> Column:
    """Strike quoted x1000 -> currency units (double division)."""
    return col(strike_x1000) / 1000.0


def mid_price(bid="best_bid", offer="best_offer") -> Column:
    """(bid + offer) / 2."""
    return (col(bid) + col(offer)) / 2


def per_strike(price, k) -> Column:
    """Value in strike units; NULL (not an error) when K = 0."""
    return F.try_divide(col(price), col(k))


def moneyness(spot, k) -> Column:
    """S / K, NULL when K = 0 or spot is missing."""
    return F.try_divide(col(spot), col(k))


def days_between(later, earlier) -> Column:
    """P5: calendar days later - earlier."""
    return F.datediff(col(later), col(earlier))


def year_fraction(days, basis: float = 365.0) -> Column:
    """Days / basis (365 calendar days in the real-data path)."""
    return col(days) / basis


def row_key(*cols) -> Column:
    """Surrogate row id built from natural key columns (stable under
    re-partitioning, unlike ``monotonically_increasing_id``)."""
    return F.concat_ws(":", *[col(c).cast("string") for c in cols])


def call_flag(cp="cp_flag") -> Column:
    """P10: 'C' -> true, anything else including NULL -> false."""
    return F.coalesce(col(cp) == "C", F.lit(False))


def fill_open_end(end, as_of: _dt.date) -> Column:
    """Open-ended validity date -> caller's as-of date (not the clock)."""
    return F.coalesce(col(end), F.lit(as_of))


def to_percent(x) -> Column:
    """Unit change to percent."""
    return 100 * col(x)
