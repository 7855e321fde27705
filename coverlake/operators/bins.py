"""Binning with pandas / numpy edge rules (B1-B4) and per-bin aggregates
(A8-A14, A22).

Edges are computed once by a small aggregate (min/max or exact quantiles)
and held by the driver as a short list of doubles; the bin index is then a
native expression (a sum of edge comparisons), so rows never leave codegen
and no join is needed.  Per-bin results are left-joined onto a bin spine so
empty bins stay visible.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlake.operators.quantiles import exact_quantiles, value_histogram


def _minmax(df: DataFrame, col: str) -> tuple[float, float]:
    return minmax_count(df, col)[:2]


def minmax_count(df: DataFrame, col: str) -> tuple[float, float, int]:
    """min, max and non-NULL count of a column in one aggregate."""
    v = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    r = df.agg(F.min(v), F.max(v), F.count(v)).first()
    return r[0], r[1], r[2]


def equal_width_edges(df: DataFrame, col: str, k: int = 10) -> list[float]:
    """B1 (``pd.cut(x, bins=k)``): k equal bins over [min, max]; the lowest
    edge is lowered by 0.1 % of the range so the minimum falls inside."""
    mn, mx = _minmax(df, col)
    if mn is None:
        return []
    if mn == mx:
        mn = mn - (0.001 * abs(mn) if mn != 0 else 0.001)
        mx = mx + (0.001 * abs(mx) if mx != 0 else 0.001)
        return [float(e) for e in np.linspace(mn, mx, k + 1)]
    step = (mx - mn) / k
    edges = [mn + i * step for i in range(k)] + [mx]
    edges[0] = mn - (mx - mn) * 0.001
    return edges


def log_edges(df: DataFrame, col: str, n_edges: int = 11, first: float | None = None,
              stats: tuple | None = None) -> list[float]:
    """B2: ``logspace(log10(first or min), log10(max), n_edges)`` with the end
    edges pinned to exactly ``first or min`` and ``max`` (unpinned, rounding can
    put the first edge above the minimum and drop that row).  ``stats`` =
    (min, max, ...) when already computed."""
    mn, mx = (stats or _minmax(df, col))[:2]
    if mn is None:
        return []
    lo = mn if first is None else first
    a, b = math.log10(lo), math.log10(mx)
    step = (b - a) / (n_edges - 1)
    edges = [10 ** (a + i * step) for i in range(n_edges)]
    edges[0], edges[-1] = lo, mx
    return edges


def linspace_edges(lo: float, hi: float, n_edges: int) -> list[float]:
    """B4 edges, ``np.linspace(lo, hi, n_edges)``."""
    return [float(e) for e in np.linspace(lo, hi, n_edges)]


def right_closed_bin(x, edges) -> Column:
    """Bin of ``pd.cut(..., right=True, include_lowest=True)``: bin i holds
    (e_i, e_i+1], bin 0 also holds e_0; NULL outside [e_0, e_last]."""
    x = F.col(x) if isinstance(x, str) else x
    idx = sum(((x > F.lit(e)).cast("int") for e in edges[1:-1]), F.lit(0))
    inside = (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1]))
    return F.when(inside, idx)


def with_right_closed_bin(df: DataFrame, x: str, edges: dict, by: str, bin_col: str = "bin") -> DataFrame:
    """``right_closed_bin`` with each group's own edges (ascending, one list per
    value of ``by``); rows outside them are dropped.  The few bins are joined: the
    comparisons of all groups in one expression make a generated method of more
    than 8,000 bytes, which the JVM interprets instead of compiling it."""
    bins = [(g, i, float(lo), float(hi)) for g, e in edges.items()
            for i, (lo, hi) in enumerate(zip(e, e[1:] or e))]        # a single edge is a bin of its own
    kind = df.schema[by].dataType.simpleString()
    bins = df.sparkSession.createDataFrame(bins, f"__by {kind}, {bin_col} int, __lower double, __upper double")
    above = (F.col(x) > F.col("__lower")) | ((F.col(bin_col) == 0) & (F.col(x) == F.col("__lower")))
    inside = (F.col(by) == F.col("__by")) & above & (F.col(x) <= F.col("__upper"))
    return df.join(F.broadcast(bins), inside).drop("__by", "__lower", "__upper")


def left_closed_bin(x, edges) -> Column:
    """Bin of ``np.histogram``: [e_i, e_i+1), the last bin closed; NULL outside."""
    x = F.col(x) if isinstance(x, str) else x
    idx = sum(((x >= F.lit(e)).cast("int") for e in edges[1:-1]), F.lit(0))
    inside = (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1]))
    return F.when(inside, idx)


def bin_spine(spark: SparkSession, edges, extra: dict | None = None) -> DataFrame:
    """One row per bin (bin, lower edge, upper edge); size = len(edges) - 1."""
    rows = [(i, float(edges[i]), float(edges[i + 1])) for i in range(len(edges) - 1)]
    spine = spark.createDataFrame(rows, "bin int, lower double, upper double")
    for k, v in (extra or {}).items():
        spine = spine.withColumn(k, F.lit(v))
    return spine


def decile_edges(df: DataFrame, col: str, q: int = 10, by=(), duplicates: str = "raise") -> DataFrame:
    """B3 (``pd.qcut(x, q)``): linear-interpolated exact quantile edges per
    group, as a small DataFrame ``by + [edges array<double>]``.  Duplicate
    edges raise like pandas unless ``duplicates='drop'``."""
    probs = [i / q for i in range(q + 1)]
    qs = exact_quantiles(df, col, probs, by, prefix="e")
    names = [c for c in qs.columns if c not in by]
    edges = F.array(*[F.col(n) for n in names])
    out = qs.select(*by, edges.alias("edges"))
    if duplicates == "drop":
        return out.withColumn("edges", F.array_sort(F.array_distinct("edges")))
    dup = out.filter(F.size(F.array_distinct("edges")) < F.size("edges")).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate quantile edges for {col}: {dup[0]['edges']}")
    return out


def bin_stats(df: DataFrame, bin_col: str, feature: str, measure: str, probs=(0.05, 0.5, 0.95), by=(),
              method: str = "search") -> DataFrame:
    """A8-A11 per bin: count, centre (max+min)/2 of the binned feature, and
    exact percentiles of ``measure`` (median, 5th, 95th by default).  One scan
    gives counts, centres and the histogram that brackets the percentiles, a
    second one the rows of the bracketing buckets."""
    keys = list(by) + [bin_col]
    base = df.filter(F.col(bin_col).isNotNull())
    hist = value_histogram(base, measure, keys, __all=F.count(F.lit(1)), __least=F.min(feature), __most=F.max(feature))
    counts = hist.groupBy(*keys).agg(F.sum("__all").alias("n"), ((F.max("__most") + F.min("__least")) / 2).alias("center"))
    qs = exact_quantiles(base, measure, probs, keys, prefix="p", method=method, hist=hist)
    return counts.join(qs, keys, "left")


def rate_by_bin(df: DataFrame, bin_col: str, flags: dict[str, Column], by=()) -> DataFrame:
    """Per bin, share of rows with each flag; 0 for an empty bin is
    applied after the spine join (``fill_empty``)."""
    keys = list(by) + [bin_col]
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.avg(c.cast("double")).alias(name) for name, c in flags.items()]
    return df.filter(F.col(bin_col).isNotNull()).groupBy(*keys).agg(*aggs)
