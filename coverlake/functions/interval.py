"""Prediction-interval flags and widths.

NaN is treated like pandas does: any comparison with NaN is false.  Spark
orders NaN above every number, so bounds are passed through ``nanvl`` to
NULL and predicates are closed with ``coalesce(pred, false)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverlake.functions.quote import col


def _num(c) -> Column:
    c = col(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def _flag(pred: Column) -> Column:
    return F.coalesce(pred, F.lit(False))


def covered(y="y_true", lb="lb", ub="ub") -> Column:
    """Lb <= y <= ub."""
    return _flag((_num(lb) <= _num(y)) & (_num(y) <= _num(ub)))


def ordered(lb="lb", ub="ub") -> Column:
    """valid = lb <= ub (equality is valid)."""
    return _flag(_num(lb) <= _num(ub))


def point_ordered(lb="lb", pp="pp", ub="ub") -> Column:
    """pp_valid = lb <= pp <= ub."""
    return _flag((_num(lb) <= _num(pp)) & (_num(pp) <= _num(ub)))


def ill(lb="lb", ub="ub") -> Column:
    """Ub <= lb (equality is ill here, unlike P14)."""
    return _flag(_num(ub) <= _num(lb))


def abs_width(lb="lb", ub="ub") -> Column:
    """P17; NULL when a bound is missing (NULL or NaN)."""
    return _num(ub) - _num(lb)


def rel_width(y="y_true", lb="lb", ub="ub") -> Column:
    """100 * (ub - lb) / y.  y = 0 gives +-inf as in pandas (0/0 and a missing y -> NULL)."""
    w = 100 * (_num(ub) - _num(lb))
    y = _num(y)
    return (F.when(y != 0, w / y)
             .when((y == 0) & (w > 0), F.lit(float("inf")))
             .when((y == 0) & (w < 0), F.lit(float("-inf"))))


def winsorize(x, cap: float = 100.0) -> Column:
    """Values above ``cap`` become ``cap``; a missing value (NULL, NaN) stays missing."""
    x = _num(x)
    return F.when(x > cap, F.lit(cap)).otherwise(x)


def to_money(bound, k) -> Column:
    """P20: bound in strike units -> currency (K * bound)."""
    return col(k) * col(bound)
