"""Losses and conformity scores (P23, P24, A18 row term)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverlake.functions.quote import col


def pinball(y, f, alpha: float) -> Column:
    """alpha*(y-f) if y >= f else (1-alpha)*(f-y)."""
    y, f = col(y), col(f)
    return F.when(y >= f, alpha * (y - f)).otherwise((1 - alpha) * (f - y))


def cqr_score(y, q_lo, q_hi) -> Column:
    """Conformity score max(q_lo - y, y - q_hi); NULL when any of the
    three is missing (``greatest`` alone would give a one-sided score)."""
    below, above = col(q_lo) - col(y), col(y) - col(q_hi)
    return F.when(below.isNotNull() & above.isNotNull(), F.greatest(below, above))


def abs_error(y, f) -> Column:
    return F.abs(col(y) - col(f))
