"""Bulk valuation queries (E10: P21, P25, A17, A24, F9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlake.functions.hashing import hash_normal_sql
from coverlake.functions.normal import bs_call_sql, bs_put_sql
from coverlake.operators import valuation as V
from coverlake.plans.clean import clean_features
from coverlake.queries._sql import KEYS
from coverlake.queries.cleaning import CLEAN_KEYED_SQL, CLEAN_SQL
from coverlake.registry import register
from coverlake.sources import fixtures as fx
from coverlake.sources.fixtures import KEY_COLS

# Strikes per base row (the reference's middle setting), the
# ladder seed, the surface grid size and the F9 box of the reference.
KAPPA = 4
LADDER_SEED = 7
GRID = 30
BOX = {"r": (0.03, 0.04), "sigma": (0.4, 0.6)}

_KEY_J_SQL = ("concat_ws(':', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
              "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(date AS VARCHAR), CAST(j AS VARCHAR))")

LADDER_SQL = f"""
ladder AS (SELECT {KEYS}, j, S, sigma, tau, r,
                  S/(1.0 + 0.1*{hash_normal_sql(LADDER_SEED, _KEY_J_SQL)}) AS K
           FROM (SELECT p.*, CAST(unnest(generate_series(1, {KAPPA})) AS INTEGER) AS j FROM predictions p) x),
valued AS (SELECT *, {bs_call_sql('S', 'K', 'r', 'sigma', 'tau')} AS C FROM ladder)"""


def _ladder(spark, sf_dir):
    base = fx.predictions(spark, sf_dir).select(*KEY_COLS, "S", "sigma", "tau", "r")
    return V.strike_ladder(base, KEY_COLS, KAPPA, seed=LADDER_SEED)


@register("strike_ladder", f"""
WITH {LADDER_SQL}
SELECT {KEYS}, j, round(K, 9) AS K FROM ladder""")
def q_strike_ladder(spark, sf_dir):
    """P25: kappa = 4 strikes per base row, K = S / z, z ~ N(1, 0.1)."""
    return _ladder(spark, sf_dir).select(*KEY_COLS, F.col("j").cast("int").alias("j"),
                                         F.round("K", 9).alias("K"))


# Valuation on the quoted strikes: S and K in money, rate in percent.
_QUOTED_SQL = f"""
quoted AS (SELECT {', '.join('q.' + k for k in KEY_COLS)}, p.close AS S, q.strike_price/1000 AS K, c.sigma, c.tau, c.r/100.0 AS r
           FROM ({CLEAN_KEYED_SQL}) c
           JOIN quotes q ON q.l_orderkey = c.l_orderkey AND q.l_linenumber = c.l_linenumber AND q.l_partkey = c.l_partkey
                AND q.l_suppkey = c.l_suppkey AND q.date = c.date
           JOIN prices p ON p.secid = q.secid AND p.date = q.date),
valued AS (SELECT *, {bs_call_sql('S', 'K', 'r', 'sigma', 'tau')} AS C FROM quoted)"""


def _quoted(spark, sf_dir):
    """Clean quotes with spot and strike in money and the call's model value."""
    clean = clean_features(fx.quotes(spark, sf_dir), fx.prices(spark, sf_dir), fx.zero_curve(spark, sf_dir), keep_keys=(*KEY_COLS[:4], "K"))
    rows = clean.select(*KEY_COLS, (F.col("S") * F.col("K")).alias("S"), "K", "sigma", "tau", (F.col("r") / 100.0).alias("r"))
    return V.value_calls(rows)


@register("ladder_values", f"""
WITH {_QUOTED_SQL}
SELECT {KEYS}, round(S/K, 9) AS moneyness, round(C/K, 9) AS V FROM valued""")
def q_ladder_values(spark, sf_dir):
    """Black-Scholes call value of every clean quote at its own strike,
    normalised by K."""
    v = _quoted(spark, sf_dir)
    return v.select(*KEY_COLS, F.round(F.col("S") / F.col("K"), 9).alias("moneyness"), F.round(F.col("C") / F.col("K"), 9).alias("V"))


@register("valuation_checks", f"""
WITH {_QUOTED_SQL}
SELECT count(*) FILTER (WHERE C > S) AS n_price_above_spot, count(*) FILTER (WHERE C IS NULL) AS n_null_price,
       count(*) AS n FROM valued""")
def q_valuation_checks(spark, sf_dir):
    """Price above spot and NULL price counters."""
    return V.quality_counters(_quoted(spark, sf_dir))


def _surface_sql():
    box = " AND ".join(f"{c} >= {lo} AND {c} <= {hi}" for c, (lo, hi) in BOX.items())
    return f"""
WITH {_QUOTED_SQL},
d AS (SELECT S/K AS x, tau AS y, C/K AS z, r, sigma FROM valued),
mm AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM d WHERE {box}),
st AS (SELECT x0, y0, (x1 - x0)/{GRID - 1} AS dx, (y1 - y0)/{GRID - 1} AS dy FROM mm),
cells AS (SELECT CAST(floor((y - (y0 - dy/2))/dy) AS INTEGER) AS i, CAST(floor((x - (x0 - dx/2))/dx) AS INTEGER) AS j, z
          FROM d, st),
agg AS (SELECT i, j, avg(z) AS mean_z, count(*) AS n FROM cells
        WHERE i BETWEEN 0 AND {GRID - 1} AND j BETWEEN 0 AND {GRID - 1} GROUP BY i, j),
spine AS (SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, y0 + a.i*dy AS y_center, x0 + b.j*dx AS x_center
          FROM st, range({GRID}) a(i), range({GRID}) b(j))
SELECT s.i, s.j, round(s.y_center, 9) AS y_center, round(s.x_center, 9) AS x_center,
       round(a.mean_z, 9) AS mean_z, coalesce(a.n, 0) AS n
FROM spine s LEFT JOIN agg a ON a.i = s.i AND a.j = s.j"""


@register("value_surface", _surface_sql())
def q_value_surface(spark, sf_dir):
    """A17 + F9: 30 x 30 mean-value surface over (S/K, tau) of the clean
    quotes; grid fixed on the r / sigma box, means over all rows, empty
    cells NULL."""
    v = _quoted(spark, sf_dir).withColumns({"x": F.col("S") / F.col("K"), "z": F.col("C") / F.col("K")})
    box = F.lit(True)
    for c, (lo, hi) in BOX.items():
        box = box & F.col(c).between(lo, hi)
    s = V.binned_surface(spark, v, "x", "tau", "z", v.filter(box), GRID)
    return s.select("i", "j", F.round("y_center", 9).alias("y_center"), F.round("x_center", 9).alias("x_center"),
                    F.round("mean_z", 9).alias("mean_z"), "n")


_M_BINS = 10


@register("market_model_gap", f"""
WITH clean AS ({CLEAN_SQL}),
g AS (SELECT year(date) AS year, S, V - CASE WHEN cp_flag = 'C' THEN {bs_call_sql('S', '1.0', 'r/100.0', 'sigma', 'tau')}
                                             WHEN cp_flag = 'P' THEN {bs_put_sql('S', '1.0', 'r/100.0', 'sigma', 'tau')} END AS gap
      FROM clean),
b AS (SELECT year, CAST(least(floor((S - 0.5)*10), {_M_BINS - 1}) AS INTEGER) AS m_bin, gap FROM g)
SELECT year, m_bin, count(*) AS n, round(avg(gap), 9) AS mean_gap, round(avg(abs(gap)), 9) AS mean_abs_gap
FROM b GROUP BY year, m_bin""")
def q_market_model_gap(spark, sf_dir):
    """P21 re-aimed: value every clean quote (rate in percent), summarise
    market minus model per year and moneyness bin (width 0.1 on [0.5, 1.5])."""
    clean = clean_features(fx.quotes(spark, sf_dir), fx.prices(spark, sf_dir), fx.zero_curve(spark, sf_dir))
    g = V.market_model_gap(clean)
    b = g.select(F.year("date").alias("year"),
                 F.least(F.floor((F.col("S") - 0.5) * 10), F.lit(_M_BINS - 1)).cast("int").alias("m_bin"), "gap")
    return b.groupBy("year", "m_bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap"), 9).alias("mean_gap"),
                                          F.round(F.avg(F.abs("gap")), 9).alias("mean_abs_gap"))


@register("market_model_gap_daily", f"""
WITH clean AS ({CLEAN_SQL}),
g AS (SELECT date, S, V - CASE WHEN cp_flag = 'C' THEN {bs_call_sql('S', '1.0', 'r/100.0', 'sigma', 'tau')}
                                WHEN cp_flag = 'P' THEN {bs_put_sql('S', '1.0', 'r/100.0', 'sigma', 'tau')} END AS gap
      FROM clean),
b AS (SELECT date, CAST(least(floor((S - 0.5)*10), {_M_BINS - 1}) AS INTEGER) AS m_bin, gap FROM g)
SELECT date, m_bin, count(*) AS n, round(avg(gap), 9) AS mean_gap FROM b GROUP BY date, m_bin""")
def q_market_model_gap_daily(spark, sf_dir):
    """P21 re-aimed, daily: market minus model per trading date and
    moneyness bin."""
    clean = clean_features(fx.quotes(spark, sf_dir), fx.prices(spark, sf_dir), fx.zero_curve(spark, sf_dir))
    g = V.market_model_gap(clean)
    b = g.select("date", F.least(F.floor((F.col("S") - 0.5) * 10), F.lit(_M_BINS - 1)).cast("int").alias("m_bin"),
                 "gap")
    return b.groupBy("date", "m_bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap"), 9).alias("mean_gap"))
