"""Interval evaluation: flags, alignment, coverage and crossing aggregates
(J13, J14, P13-P19, A1-A7, A27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlake.functions import interval as iv


def add_interval_flags(df: DataFrame, y="y_true", lb="lb", ub="ub", pp: str | None = "pp") -> DataFrame:
    """P13-P19 as columns: covered, valid, pp_valid, ill, abs_width,
    rel_width, rel_width_w (winsorised at 100)."""
    cols = {"covered": iv.covered(y, lb, ub), "valid": iv.ordered(lb, ub), "ill": iv.ill(lb, ub),
            "abs_width": iv.abs_width(lb, ub), "rel_width": iv.rel_width(y, lb, ub)}
    if pp:
        cols["pp_valid"] = iv.point_ordered(lb, pp, ub)
    return df.withColumns(cols).withColumn("rel_width_w", iv.winsorize("rel_width"))


def add_suffix(df: DataFrame, suffix: str, cols=None) -> DataFrame:
    """Rename columns with a suffix (``DataFrame.add_suffix``)."""
    cols = list(cols) if cols is not None else df.columns
    return df.withColumnsRenamed({c: c + suffix for c in cols})


def join_by_key(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """The reference concatenates frames by row position; here rows are
    aligned by an explicit key (1:1 equi-join, no order dependence)."""
    return left.join(right, list(keys), "inner")


def share_outside(value: str = "S", limit: float = 1.5) -> Column:
    """A5: percent of all rows whose moneyness is above the limit."""
    return _pct(_number(value) > limit)


def aligned_years(left: DataFrame, *others: DataFrame, year_col: str = "year", strict_keys=None) -> DataFrame:
    """Per-year row counts of all inputs (predictions, features, date
    keys, ...); keep ``left`` rows only in years whose counts are all equal.
    With ``strict_keys`` a year is kept only if, in addition, no key is on one
    side without the other (two anti-joins).  The per-year tables are tiny
    (one row per calendar year)."""
    lc = left.groupBy(year_col).agg(F.count(F.lit(1)).alias("__n"))
    ok_years = lc
    for other in others:
        ok_years = ok_years.join(other.groupBy(year_col).agg(F.count(F.lit(1)).alias("__n")), [year_col, "__n"], "left_semi")
    ok_years = ok_years.select(year_col)
    for other in others if strict_keys else ():
        keys = [year_col] + list(strict_keys)
        lk, rk = left.select(*keys), other.select(*keys)
        bad = (lk.join(rk, keys, "left_anti").select(year_col)
                 .union(rk.join(lk, keys, "left_anti").select(year_col)).distinct())
        ok_years = ok_years.join(bad, year_col, "left_anti")
    return left.join(F.broadcast(ok_years), year_col, "left_semi")   # one row per calendar year


def _share(flag: Column) -> Column:
    """Share of all rows: a missing value does not meet the condition."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double"))


def _pct(flag: Column) -> Column:
    return 100 * _share(flag)


def _number(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def coverage_aggs(y="y_true", lb="lb", ub="ub") -> list[Column]:
    """A1 (valid-only and all-rows), A2, A3, A4, A6 as aggregate columns over
    a frame that already carries ``add_interval_flags`` columns."""
    valid = F.col("valid")
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(valid, F.col("covered").cast("double"))).alias("coverage_valid"),
        F.avg(F.col("covered").cast("double")).alias("coverage_all"),
        (100 * (1 - F.avg(valid.cast("double")))).alias("invalid_pct"),
        (100 * (1 - F.avg(F.col("pp_valid").cast("double")))).alias("pp_invalid_pct"),
        _pct(F.col("ill")).alias("ill_pct"),
        _pct(_number(lb) < 0).alias("neg_lb_pct"),
        _pct(_number(ub) < 0).alias("neg_ub_pct"),
        F.avg(F.when(~F.col("ill"), F.coalesce(_number("rel_width") < 100, F.lit(False)).cast("double"))).alias("rel_width_lt100_share"),
        F.count_if(F.col("covered")).alias("covered_n"),
        F.count_if(~F.col("covered")).alias("missed_n"),
    ]


def coverage_report(df: DataFrame, by=("seed_id",)) -> DataFrame:
    """Coverage and crossing report per group, one pass, partial
    aggregation before the shuffle."""
    return df.groupBy(*by).agg(*coverage_aggs())


def daily_coverage(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Mean covered flag per trading day (crossed intervals count as
    misses), sorted by date (W2)."""
    return (df.groupBy(date_col).agg(F.avg(F.col("covered").cast("double")).alias("average_coverage"),
                                     F.count(F.lit(1)).alias("n"))
              .orderBy(date_col))


def pivot_report(df: DataFrame, rows=("method", "n_label"), pivot_col: str = "kappa",
                 values=(1, 4, 20), metric: Column | None = None) -> DataFrame:
    """Wide table method x n by kappa (explicit pivot values: no extra
    distinct job).  ``metric`` may be a dict name -> aggregate: one wide
    column per value and name (``{value}_{name}``)."""
    metric = metric if metric is not None else F.avg(F.col("covered").cast("double"))
    pivoted = df.groupBy(*rows).pivot(pivot_col, list(values))
    if isinstance(metric, dict):
        return pivoted.agg(*[m.alias(name) for name, m in metric.items()])
    return pivoted.agg(metric)


def crossing_metrics() -> dict[str, Column]:
    """Coverage, percent of crossed intervals (A2) and percent of intervals
    that leave the point prediction outside (A3's point half)."""
    return {"coverage": F.avg(F.col("covered").cast("double")),
            "crossed_pct": 100 * (1 - F.avg(F.col("valid").cast("double"))),
            "point_out_pct": 100 * (1 - F.avg(F.col("pp_valid").cast("double")))}
