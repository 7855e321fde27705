"""Quote cleaning queries (E1 and its parts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlake.functions import quote as qf
from coverlake.operators import curve as cv
from coverlake.operators import quotes as qops
from coverlake.operators import splits as sp
from coverlake.plans.clean import clean_features
from coverlake.queries._sql import KEYS
from coverlake.registry import register
from coverlake.sources import fixtures as fx
from coverlake.sources.fixtures import KEY_COLS

SCREEN_SQL = """secid IS NOT NULL AND date IS NOT NULL AND exdate IS NOT NULL AND last_date IS NOT NULL
  AND best_bid IS NOT NULL AND best_offer IS NOT NULL AND volume IS NOT NULL AND open_interest IS NOT NULL
  AND cp_flag IS NOT NULL AND impl_volatility IS NOT NULL AND strike_price IS NOT NULL
  AND volume > 0 AND open_interest > 0 AND best_bid > 0
  AND datediff('day', date, exdate) > 9 AND datediff('day', date, exdate) < 730
  AND datediff('day', last_date, date) < 5"""

# Reference form: correlated MAX/MIN neighbour tenors.
# The zero curve as a function of (date, days): on a tenor its own rate, between
# two tenors the line through them.
RATE_SQL = """
tenors AS (SELECT date, days, rate, lag(days) OVER w AS below_days, lag(rate) OVER w AS below_rate,
                  lead(days) OVER w AS above_days, lead(rate) OVER w AS above_rate
           FROM zero_curve WINDOW w AS (PARTITION BY date ORDER BY days)),
asked AS (SELECT DISTINCT date, date_diff('day', date, exdate) AS days FROM quotes),
on_tenor AS (SELECT a.date, a.days, t.rate AS exact_rate, t.below_days AS t1, t.below_rate AS ir1, t.above_days AS t2, t.above_rate AS ir2
             FROM asked a JOIN tenors t ON t.date = a.date AND t.days = a.days),
off_tenor AS (SELECT a.date, a.days, CAST(NULL AS DOUBLE) AS exact_rate, t.days AS t1, t.rate AS ir1, t.above_days AS t2, t.above_rate AS ir2
              FROM asked a ASOF JOIN tenors t ON t.date = a.date AND a.days >= t.days
              WHERE t.days < a.days),
ahead AS (SELECT a.date, a.days, CAST(NULL AS DOUBLE) AS exact_rate, NULL AS t1, NULL AS ir1, f.days AS t2, f.rate AS ir2
          FROM asked a JOIN tenors f ON f.date = a.date AND f.below_days IS NULL AND a.days < f.days),
looked_up AS (SELECT * FROM on_tenor UNION ALL SELECT * FROM off_tenor UNION ALL SELECT * FROM ahead),
curve AS (SELECT *, CASE WHEN t1 IS NOT NULL AND t2 IS NOT NULL THEN ir1 + (ir2 - ir1)/(t2 - t1)*(days - t1) END AS interp_rate
          FROM looked_up)"""


def clean_sql(keys: str = "") -> str:
    """The clean feature table as one statement, with more columns in front."""
    needed = ("secid", "date", "S", "sigma", "tau", "r", "cp_flag", "V")
    return f"""
WITH {RATE_SQL},
valued AS (SELECT q.*, p.close/(q.strike_price/1000) AS S, q.impl_volatility AS sigma, date_diff('day', q.date, q.exdate) AS days,
                  ((q.best_bid + q.best_offer)/2)/(q.strike_price/1000) AS V
           FROM (SELECT * FROM quotes WHERE {SCREEN_SQL}) q LEFT JOIN prices p USING (secid, date)),
features AS (SELECT v.*, v.days/365 AS tau, coalesce(c.exact_rate, c.interp_rate) AS r
             FROM valued v LEFT JOIN curve c ON c.date = v.date AND c.days = v.days
             WHERE v.S BETWEEN 0.5 AND 1.5)
SELECT {keys}{', ' if keys else ''}{', '.join(needed)} FROM features
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in needed)}
"""


CLEAN_SQL = clean_sql()
CLEAN_KEYED_SQL = clean_sql("l_orderkey, l_linenumber, l_partkey, l_suppkey")


@register("clean_features", CLEAN_SQL)
def q_clean_features(spark, sf_dir):
    """Clean feature table from raw quotes."""
    return clean_features(fx.quotes(spark, sf_dir), fx.prices(spark, sf_dir),
                          fx.zero_curve(spark, sf_dir))


# --- parts of E1, registered one by one ----------------------------------------


QUOTE_COLS = ", ".join(qops.QUOTE_COLUMNS[2:])


def _screened(spark, sf_dir):
    return qops.screen_quotes(fx.quotes(spark, sf_dir))


@register("quote_screen", f"SELECT {KEYS}, secid, {QUOTE_COLS} FROM quotes WHERE {SCREEN_SQL}")
def q_quote_screen(spark, sf_dir):
    """11 NOT NULLs, positive volume / open interest / bid, 9 < days to
    expiry < 730, staleness < 5 days."""
    return _screened(spark, sf_dir).select(*KEY_COLS, "secid", *qops.QUOTE_COLUMNS[2:])


@register("spot_lookup", f"""
SELECT {', '.join('s.' + c for c in KEY_COLS)}, s.secid, round(p.close, 9) AS spot_price
FROM (SELECT * FROM quotes WHERE {SCREEN_SQL}) s LEFT JOIN prices p ON p.secid = s.secid AND p.date = s.date""")
def q_spot_lookup(spark, sf_dir):
    """Spot close per (secid, date), left join (NULL where missing)."""
    j = qops.attach_spot(_screened(spark, sf_dir), fx.prices(spark, sf_dir))
    return j.select(*KEY_COLS, "secid", F.round("spot_price", 9).alias("spot_price"))


@register("quote_features", f"""
SELECT {KEYS}, round(strike_price/1000, 9) AS K, round((best_bid + best_offer)/2, 9) AS option_price,
       round(((best_bid + best_offer)/2)/(strike_price/1000), 9) AS V,
       round(spot_price/(strike_price/1000), 9) AS moneyness,
       CAST(datediff('day', date, exdate) AS INTEGER) AS days,
       round(datediff('day', date, exdate)/365, 9) AS tau,
       concat_ws(':', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                 CAST(l_suppkey AS VARCHAR), CAST(date AS VARCHAR)) AS row_id
FROM (SELECT s.*, p.close AS spot_price FROM (SELECT * FROM quotes WHERE {SCREEN_SQL}) s
      LEFT JOIN prices p ON p.secid = s.secid AND p.date = s.date) t""")
def q_quote_features(spark, sf_dir):
    """Strike rescale, mid price, V = price/K, moneyness, days, tau,
    surrogate row id from natural keys."""
    df = qops.add_quote_features(qops.attach_spot(_screened(spark, sf_dir), fx.prices(spark, sf_dir)))
    return df.select(*KEY_COLS, *[F.round(c, 9).alias(c) for c in ("K", "option_price", "V", "moneyness")],
                     F.col("days").cast("int").alias("days"), F.round("tau", 9).alias("tau"),
                     qf.row_key(*KEY_COLS).alias("row_id"))


@register("moneyness_band", f"""
SELECT {KEYS}, round(spot_price/(strike_price/1000), 9) AS moneyness
FROM (SELECT s.*, p.close AS spot_price FROM (SELECT * FROM quotes WHERE {SCREEN_SQL}) s
      LEFT JOIN prices p ON p.secid = s.secid AND p.date = s.date) t
WHERE spot_price/(strike_price/1000) IS NULL OR NOT (spot_price/(strike_price/1000) < 0.5
                                                    OR spot_price/(strike_price/1000) > 1.5)""")
def q_moneyness_band(spark, sf_dir):
    """F2: drop moneyness < 0.5 or > 1.5 (NULL moneyness survives the DELETE)."""
    df = qops.add_quote_features(qops.attach_spot(_screened(spark, sf_dir), fx.prices(spark, sf_dir)))
    return qops.moneyness_band(df).select(*KEY_COLS, F.round("moneyness", 9).alias("moneyness"))


@register("curve_rates", f"""
WITH {RATE_SQL}
SELECT {', '.join('q.' + k for k in KEY_COLS)}, CAST(date_diff('day', q.date, q.exdate) AS INTEGER) AS days,
       round(c.exact_rate, 9) AS exact_rate, c.t1, round(c.ir1, 9) AS ir1, c.t2, round(c.ir2, 9) AS ir2,
       round(c.interp_rate, 9) AS interp_rate, round(coalesce(c.exact_rate, c.interp_rate), 9) AS rf
FROM quotes q LEFT JOIN curve c ON c.date = q.date AND c.days = date_diff('day', q.date, q.exdate)""")
def q_curve_rates(spark, sf_dir):
    """J2-J4 (+ D5 interpolated_data columns) on every quote: exact tenor
    rate, neighbouring tenors and rates, interpolated rate, filled rate."""
    q = fx.quotes(spark, sf_dir).withColumn("days", F.datediff("exdate", "date"))
    df = cv.attach_rate(q, fx.zero_curve(spark, sf_dir), keep_parts=True)
    return df.select(*KEY_COLS, F.col("days").cast("int").alias("days"),
                     F.round("exact_rate", 9).alias("exact_rate"), "t1", F.round("ir1", 9).alias("ir1"), "t2",
                     F.round("ir2", 9).alias("ir2"), F.round("interp_rate", 9).alias("interp_rate"),
                     F.round("rf", 9).alias("rf"))


@register("export_features", f"""
SELECT secid, date, year(date) AS year, round(S, 9) AS S, round(sigma, 9) AS sigma, round(tau, 9) AS tau,
       round(r, 9) AS r, coalesce(cp_flag = 'C', false) AS is_call, round(V, 9) AS V
FROM ({CLEAN_SQL}) c""")
def q_export_features(spark, sf_dir):
    """Export layout of the clean table: features, call flag as
    boolean (NULL -> false), keys kept, year column for partitioning."""
    c = q_clean_features(spark, sf_dir)
    return c.select("secid", "date", F.year("date").alias("year"),
                    *[F.round(x, 9).alias(x) for x in ("S", "sigma", "tau", "r")],
                    qf.call_flag("cp_flag").alias("is_call"), F.round("V", 9).alias("V"))


@register("calls_in_window", f"""
SELECT secid, date, round(S, 9) AS S, round(V, 9) AS V FROM ({CLEAN_SQL}) c
WHERE cp_flag = 'C' AND date > DATE '1996-01-01' AND date < DATE '2000-12-31'""")
def q_calls_in_window(spark, sf_dir):
    """F4 + F5: calls only, inside an open date range (both ends excluded)."""
    c = q_clean_features(spark, sf_dir)
    return (c.filter((F.col("cp_flag") == "C") & (F.col("date") > F.lit("1996-01-01").cast("date"))
                     & (F.col("date") < F.lit("2000-12-31").cast("date")))
             .select("secid", "date", F.round("S", 9).alias("S"), F.round("V", 9).alias("V")))


@register("systematic_sample", f"""
SELECT {KEYS}, row_no FROM (SELECT {KEYS}, row_number() OVER (ORDER BY {KEYS}) - 1 AS row_no FROM predictions) t
WHERE row_no % 100 = 0""")
def q_systematic_sample(spark, sf_dir):
    """every 100th row in key order (a sampling operator: the modulo is
    the feature), on distributed row numbers."""
    df = fx.predictions(spark, sf_dir).select(*KEY_COLS)
    return sp.global_row_number(df, list(KEY_COLS)).filter(F.col("row_no") % 100 == 0)
