"""Interval evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlake.functions import interval as iv
from coverlake.operators import intervals as ops
from coverlake.operators import quotes as qops
from coverlake.queries._sql import FLAGGED, KEYS, KEY_JOIN
from coverlake.registry import register
from coverlake.sources import fixtures as fx
from coverlake.sources.fixtures import KEY_COLS


def r9(c):
    return F.round(c, 9)


def flagged(spark, sf_dir):
    return ops.add_interval_flags(fx.predictions(spark, sf_dir))


@register("interval_flags", f"""
WITH {FLAGGED}
SELECT {KEYS}, covered, valid, pp_valid, ill, round(abs_width, 9) AS abs_width,
       round(rel_width, 9) AS rel_width,
       round(CASE WHEN rel_width > 100 THEN 100.0 ELSE rel_width END, 9) AS rel_width_w
FROM flagged""")
def q_interval_flags(spark, sf_dir):
    """Covered / valid / pp_valid / ill flags, widths, winsorised width."""
    df = flagged(spark, sf_dir)
    return df.select(*KEY_COLS, "covered", "valid", "pp_valid", "ill",
                     r9(F.col("abs_width")).alias("abs_width"), r9(F.col("rel_width")).alias("rel_width"),
                     r9(F.col("rel_width_w")).alias("rel_width_w"))


COVERAGE_SELECT = """count(*) AS n,
       round(avg(CASE WHEN valid THEN CAST(covered AS DOUBLE) END), 9) AS coverage_valid,
       round(avg(CAST(covered AS DOUBLE)), 9) AS coverage_all,
       round(100*(1 - avg(CAST(valid AS DOUBLE))), 9) AS invalid_pct,
       round(100*(1 - avg(CAST(pp_valid AS DOUBLE))), 9) AS pp_invalid_pct,
       round(100*avg(CAST(ill AS DOUBLE)), 9) AS ill_pct,
       round(100.0*count(*) FILTER (WHERE lb < 0)/count(*), 9) AS neg_lb_pct,
       round(100.0*count(*) FILTER (WHERE ub < 0)/count(*), 9) AS neg_ub_pct,
       round(CAST(count(*) FILTER (WHERE NOT ill AND rel_width < 100) AS DOUBLE)/count(*) FILTER (WHERE NOT ill), 9) AS rel_width_lt100_share,
       count(*) FILTER (WHERE covered) AS covered_n,
       count(*) FILTER (WHERE NOT covered) AS missed_n"""


def _rounded_report(df, by):
    rep = ops.coverage_report(df, by)
    return rep.select(*[r9(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rep.dtypes])


@register("coverage_report", f"""
WITH {FLAGGED}
SELECT seed_id, {COVERAGE_SELECT} FROM flagged GROUP BY seed_id""")
def q_coverage_report(spark, sf_dir):
    """E4 / A1 (both crossing modes) / A2 / A3 / A4 / A6 per seed."""
    return _rounded_report(flagged(spark, sf_dir), ["seed_id"])


@register("coverage_overall", f"""
WITH {FLAGGED}
SELECT {COVERAGE_SELECT} FROM flagged""")
def q_coverage_overall(spark, sf_dir):
    """A1-A6 over the whole table (global aggregate)."""
    return _rounded_report(flagged(spark, sf_dir), [])


@register("daily_coverage", f"""
WITH {FLAGGED}
SELECT date, round(avg(CAST(covered AS DOUBLE)), 9) AS average_coverage, count(*) AS n
FROM flagged GROUP BY date ORDER BY date""")
def q_daily_coverage(spark, sf_dir):
    """A7 + W2: coverage by trading day, sorted."""
    d = ops.daily_coverage(flagged(spark, sf_dir))
    return d.select("date", r9(F.col("average_coverage")).alias("average_coverage"), "n")


def _method_dims(df):
    return df.withColumns({
        "method": F.when(F.col("seed_id") % 2 == 0, "CQR").otherwise("NQR"),
        "n_label": (5000 * (1 + F.col("l_partkey") % 4)).cast("int"),
        "kappa": F.element_at(F.array(F.lit(1), F.lit(4), F.lit(20)),
                              (F.col("l_orderkey") % 3 + 1).cast("int"))})


@register("coverage_pivot", f"""
WITH {FLAGGED},
dims AS (SELECT *, CASE WHEN seed_id % 2 = 0 THEN 'CQR' ELSE 'NQR' END AS method,
                CAST(5000*(1 + l_partkey % 4) AS INTEGER) AS n_label,
                ([1, 4, 20])[CAST(l_orderkey % 3 + 1 AS INTEGER)] AS kappa FROM flagged)
SELECT method, n_label,
       round(avg(CASE WHEN kappa = 1 THEN CAST(covered AS DOUBLE) END), 9) AS kappa_1,
       round(avg(CASE WHEN kappa = 4 THEN CAST(covered AS DOUBLE) END), 9) AS kappa_4,
       round(avg(CASE WHEN kappa = 20 THEN CAST(covered AS DOUBLE) END), 9) AS kappa_20
FROM dims GROUP BY method, n_label""")
def q_coverage_pivot(spark, sf_dir):
    """Coverage by method x n (rows) and kappa (columns)."""
    wide = ops.pivot_report(_method_dims(flagged(spark, sf_dir)))
    return wide.select("method", "n_label", *[r9(F.col(str(k))).alias(f"kappa_{k}") for k in (1, 4, 20)])


def _crossing_sql():
    cells = ", ".join(f"""round(avg(CAST(covered AS DOUBLE)) FILTER (WHERE kappa = {k}), 9) AS coverage_{k},
       round(100*(1 - avg(CAST(valid AS DOUBLE)) FILTER (WHERE kappa = {k})), 9) AS crossed_pct_{k},
       round(100*(1 - avg(CAST(pp_valid AS DOUBLE)) FILTER (WHERE kappa = {k})), 9) AS point_out_pct_{k}""" for k in (1, 4, 20))
    return f"""
WITH {FLAGGED},
dims AS (SELECT *, CASE WHEN seed_id % 2 = 0 THEN 'CQR' ELSE 'NQR' END AS method,
                CAST(5000*(1 + l_partkey % 4) AS INTEGER) AS n_label,
                ([1, 4, 20])[CAST(l_orderkey % 3 + 1 AS INTEGER)] AS kappa FROM flagged)
SELECT method, n_label, {cells} FROM dims GROUP BY method, n_label"""


@register("crossing_pivot", _crossing_sql())
def q_crossing_pivot(spark, sf_dir):
    """A27 in full: coverage, crossed % and point-outside % by method x n
    (rows) and kappa (columns)."""
    wide = ops.pivot_report(_method_dims(flagged(spark, sf_dir)), metric=ops.crossing_metrics())
    return wide.select("method", "n_label", *[r9(F.col(f"{k}_{m}")).alias(f"{m}_{k}")
                                              for k in (1, 4, 20) for m in ("coverage", "crossed_pct", "point_out_pct")])


@register("moneyness_outside", """
SELECT cp_flag, count(*) AS n, round(100.0*count(*) FILTER (WHERE c.close/(strike_price/1000) > 1.5)/count(*), 9) AS outside_pct
FROM quotes q LEFT JOIN (SELECT secid, date, max(close) AS close FROM prices GROUP BY secid, date) c
     ON c.secid = q.secid AND c.date = q.date
GROUP BY cp_flag""")
def q_moneyness_outside(spark, sf_dir):
    """A5: percent of quotes with moneyness above 1.5 before the band filter."""
    q = qops.attach_spot(fx.quotes(spark, sf_dir), fx.prices(spark, sf_dir))
    q = qops.add_quote_features(q)
    return q.groupBy("cp_flag").agg(F.count(F.lit(1)).alias("n"), r9(ops.share_outside("moneyness", 1.5)).alias("outside_pct"))


@register("interval_money_bounds", f"""
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.date,
       round(b.strike_price/1000*a.lb, 9) AS lb_money, round(b.strike_price/1000*a.ub, 9) AS ub_money,
       coalesce(a.lb <= a.y_true AND a.y_true <= a.ub, false) AS covered
FROM predictions a JOIN quotes b ON {KEY_JOIN}""")
def q_interval_money_bounds(spark, sf_dir):
    """J13 (key join instead of positional concat) + P20 bounds in money."""
    pred = fx.predictions(spark, sf_dir)
    strikes = fx.quotes(spark, sf_dir).select(*KEY_COLS, (F.col("strike_price") / 1000).alias("K"))
    j = ops.join_by_key(pred, strikes, KEY_COLS)
    return j.select(*KEY_COLS, r9(iv.to_money("lb", "K")).alias("lb_money"),
                    r9(iv.to_money("ub", "K")).alias("ub_money"), iv.covered().alias("covered"))


@register("aligned_years", f"""
WITH l AS (SELECT *, year(date) AS year FROM predictions),
r AS (SELECT year(date) AS year FROM quotes WHERE date < DATE '2001-09-01'),
d AS (SELECT year(date) AS year FROM quotes WHERE NOT (year(date) = 1995 AND date > DATE '1995-06-30')),
sizes AS (SELECT 1 AS input, year, count(*) AS n FROM l GROUP BY year UNION ALL
          SELECT 2, year, count(*) FROM r GROUP BY year UNION ALL SELECT 3, year, count(*) FROM d GROUP BY year)
SELECT {KEYS}, year FROM l
WHERE year IN (SELECT year FROM sizes GROUP BY year HAVING count(*) = 3 AND min(n) = max(n))""")
def q_aligned_years(spark, sf_dir):
    """Keep prediction rows only in years in which predictions, features
    and date keys have equally many rows.  The three inputs differ: features
    end with the curve (the last year falls out), date keys lack half of 1995
    (that year falls out, too)."""
    left = fx.predictions(spark, sf_dir).withColumn("year", F.year("date"))
    right = (fx.quotes(spark, sf_dir).filter(F.col("date") < F.lit(fx.CURVE_CUTOFF))
               .select(F.year("date").alias("year")))
    dates = (fx.quotes(spark, sf_dir).filter(~((F.year("date") == 1995) & (F.col("date") > F.lit("1995-06-30").cast("date"))))
               .select(F.year("date").alias("year")))
    return ops.aligned_years(left, right, dates).select(*KEY_COLS, "year")
