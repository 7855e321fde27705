"""Width profiles and conditional rates by bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlake.functions.quote import to_percent
from coverlake.operators import bins as B
from coverlake.operators import intervals as iops
from coverlake.operators import stats as S
from coverlake.queries._sql import FLAGGED
from coverlake.registry import register
from coverlake.sources import fixtures as fx

# Fixed-edge plots use 10 edges (= 9 bins) per feature.
FIXED_EDGES = {
    "S": (0.4, 1.5, 10),
    "sigma": (0.0, 1.0, 10),
    "tau": (0.0, 2.0, 10),
    "r": (0.0, 0.05, 10),
}
FEATURES = ("S", "sigma", "tau", "r")


def r9(c):
    return F.round(c, 9)


def _flagged(spark, sf_dir):
    return iops.add_interval_flags(fx.predictions(spark, sf_dir))


def _res(spark, sf_dir):
    """Evaluation frame without ill intervals."""
    return _flagged(spark, sf_dir).filter(~F.col("ill"))


def _sql_bin_sum(x: str, inner_edges: list[str], op: str = ">") -> str:
    return "(" + " + ".join(f"CAST({x} {op} {e} AS INTEGER)" for e in inner_edges) + ")" if inner_edges else "0"


# --- B1 + A11 -------------------------------------------------------------

_EW_STEP = "((mx - mn)/10)"
_EW_EDGE = {i: f"(mn + {i}*{_EW_STEP})" for i in range(1, 10)}
_EW_BIN = _sql_bin_sum("y_true", [_EW_EDGE[i] for i in range(1, 10)])


@register("width_bins_equal", f"""
WITH {FLAGGED},
res AS (SELECT * FROM flagged WHERE NOT ill),
mm AS (SELECT min(y_true) AS mn, max(y_true) AS mx FROM res),
binned AS (SELECT {_EW_BIN} AS bin FROM res, mm),
spine AS (SELECT CAST(i AS INTEGER) AS bin,
                 CASE WHEN i = 0 THEN mn - (mx - mn)*CAST(0.001 AS DOUBLE) ELSE mn + i*{_EW_STEP} END AS lower,
                 CASE WHEN i = 9 THEN mx ELSE mn + (i + 1)*{_EW_STEP} END AS upper
          FROM mm, range(10) t(i)),
cnt AS (SELECT bin, count(*) AS n FROM binned GROUP BY bin)
SELECT s.bin, round(s.lower, 9) AS lower, round(s.upper, 9) AS upper, coalesce(c.n, 0) AS n,
       round(100.0*coalesce(c.n, 0)/(SELECT count(*) FROM res), 9) AS pct
FROM spine s LEFT JOIN cnt c ON c.bin = s.bin""")
def q_width_bins_equal(spark, sf_dir):
    """B1 + A11: 10 equal-width bins of the true value, counts and percent,
    empty bins kept."""
    res = _res(spark, sf_dir)
    edges = B.equal_width_edges(res, "y_true", 10)
    binned = res.select(B.right_closed_bin("y_true", edges).alias("bin"))
    return S.counts_on_spine(spark, binned, edges)


# --- B2 + A8-A11 ------------------------------------------------------------

def _log_sql(first_sql: str) -> str:
    a = f"log10({first_sql})"
    step = f"((log10(mx) - {a})/10)"
    edges = {i: f"pow(10, {a} + {i}*{step})" for i in range(1, 10)}
    binv = _sql_bin_sum("y_true", [edges[i] for i in range(1, 10)])
    return f"""
WITH {FLAGGED},
res AS (SELECT * FROM flagged WHERE NOT ill),
mm AS (SELECT min(y_true) AS mn, max(y_true) AS mx FROM res),
binned AS (SELECT CASE WHEN y_true >= {first_sql} AND y_true <= mx THEN {binv} END AS bin, y_true, rel_width
           FROM res, mm),
spine AS (SELECT CAST(i AS INTEGER) AS bin,
                 CASE WHEN i = 0 THEN {first_sql} ELSE pow(10, {a} + i*{step}) END AS lower,
                 CASE WHEN i = 9 THEN mx ELSE pow(10, {a} + (i + 1)*{step}) END AS upper
          FROM mm, range(10) t(i)),
agg AS (SELECT bin, count(*) AS n, (max(y_true) + min(y_true))/2 AS center,
               quantile_cont(rel_width, [0.05, 0.5, 0.95]) AS q
        FROM binned WHERE bin IS NOT NULL GROUP BY bin)
SELECT s.bin, round(s.lower, 9) AS lower, round(s.upper, 9) AS upper, coalesce(a.n, 0) AS n,
       round(100.0*coalesce(a.n, 0)/(SELECT count(*) FROM binned WHERE bin IS NOT NULL), 9) AS pct,
       round(a.center, 9) AS center, round(a.q[1], 9) AS p_5, round(a.q[2], 9) AS p_50,
       round(a.q[3], 9) AS p_95
FROM spine s LEFT JOIN agg a ON a.bin = s.bin"""


def _log_bins(spark, sf_dir, first=None):
    res = _res(spark, sf_dir)
    stats = B.minmax_count(res, "y_true")
    edges = B.log_edges(res, "y_true", 11, first=first, stats=stats)
    binned = res.select(B.right_closed_bin("y_true", edges).alias("bin"), "y_true", "rel_width")
    out = S.on_spine(spark, B.bin_stats(binned, "bin", "y_true", "rel_width"), edges)
    return out.select("bin", "lower", "upper", "n", "pct", *[r9(F.col(c)).alias(c)
                                                            for c in ("center", "p_5", "p_50", "p_95")])


@register("width_bins_log", _log_sql("mn"))
def q_width_bins_log(spark, sf_dir):
    """B2 + A8-A11: log-spaced bins of the true value (edges pinned to min and
    max); per bin median and 5/95 % relative width, centre, count, percent."""
    return _log_bins(spark, sf_dir)


@register("width_bins_log_floor", _log_sql("CAST(0.00022 AS DOUBLE)"))
def q_width_bins_log_floor(spark, sf_dir):
    """B2 with a caller-given first edge (0.00022); values below it get no bin."""
    return _log_bins(spark, sf_dir, first=0.00022)


# --- B3 + A8-A10 --------------------------------------------------------------

_DECILE_PROBS = "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"


@register("width_by_feature_decile", f"""
WITH {FLAGGED},
res AS (SELECT * FROM flagged WHERE NOT ill),
longf AS (SELECT 'S' AS feature, S AS x, rel_width FROM res UNION ALL
          SELECT 'sigma', sigma, rel_width FROM res UNION ALL
          SELECT 'tau', tau, rel_width FROM res UNION ALL
          SELECT 'r', 100*r, rel_width FROM res),
e AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, {_DECILE_PROBS}))) AS edges
      FROM longf GROUP BY feature),
binned AS (SELECT l.feature, l.x, l.rel_width,
                  CASE WHEN l.x >= e.edges[1] AND l.x <= e.edges[len(e.edges)]
                       THEN CAST(len(list_filter(e.edges[2:len(e.edges)-1], lambda v: l.x > v)) AS INTEGER) END AS bin
           FROM longf l JOIN e ON e.feature = l.feature)
SELECT feature, bin, count(*) AS n, round((max(x) + min(x))/2, 9) AS center,
       round(quantile_cont(rel_width, 0.05), 9) AS p_5, round(quantile_cont(rel_width, 0.5), 9) AS p_50,
       round(quantile_cont(rel_width, 0.95), 9) AS p_95
FROM binned WHERE bin IS NOT NULL GROUP BY feature, bin""")
def q_width_by_feature_decile(spark, sf_dir):
    """B3 + A8-A10 + P12: decile bins per feature (r in percent), median and
    5/95 % relative width and bin centre.  Tied features drop duplicate edges
    (``pd.qcut(duplicates='drop')``)."""
    res = _res(spark, sf_dir).withColumn("r", to_percent("r"))
    longf = (res.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"))
                                           for f in FEATURES])).alias("fx"), "rel_width")
                .select("fx.feature", "fx.x", "rel_width"))
    edges = B.decile_edges(longf, "x", 10, by=["feature"], duplicates="drop").collect()     # a row per feature
    binned = B.with_right_closed_bin(longf, "x", {row["feature"]: row["edges"] for row in edges}, "feature")
    st = B.bin_stats(binned, "bin", "x", "rel_width", by=["feature"])
    return st.select("feature", "bin", "n", *[r9(F.col(c)).alias(c) for c in ("center", "p_5", "p_50", "p_95")])


# --- B4 + A12-A14 -------------------------------------------------------------

def _fixed_edges():
    return {f: B.linspace_edges(*spec) for f, spec in FIXED_EDGES.items()}


def _fixed_rates_sql():
    parts, spines = [], []
    for f, edges in _fixed_edges().items():
        binv = _sql_bin_sum(f, [repr(e) for e in edges[1:-1]], ">=")
        parts.append(f"""SELECT '{f}' AS feature,
               CASE WHEN {f} >= {edges[0]!r} AND {f} <= {edges[-1]!r} THEN {binv} END AS bin,
               covered, valid, pp_valid FROM flagged""")
        for i in range(len(edges) - 1):
            spines.append(f"('{f}', {i}, {edges[i]!r}, {edges[i + 1]!r})")
    return f"""
WITH {FLAGGED},
binned AS ({' UNION ALL '.join(parts)}),
spine AS (SELECT feature, CAST(bin AS INTEGER) AS bin, CAST(lower AS DOUBLE) AS lower, CAST(upper AS DOUBLE) AS upper
          FROM (VALUES {', '.join(spines)}) v(feature, bin, lower, upper)),
agg AS (SELECT feature, bin, count(*) AS total,
               avg(CAST(NOT covered AS DOUBLE)) AS missed_rate,
               avg(CAST(NOT valid AS DOUBLE)) AS invalid_rate,
               avg(CAST(NOT pp_valid AS DOUBLE)) AS pp_invalid_rate
        FROM binned WHERE bin IS NOT NULL GROUP BY feature, bin)
SELECT s.feature, s.bin, round(s.lower, 9) AS lower, round(s.upper, 9) AS upper, coalesce(a.total, 0) AS total,
       round(coalesce(a.missed_rate, 0), 9) AS missed_rate, round(coalesce(a.invalid_rate, 0), 9) AS invalid_rate,
       round(coalesce(a.pp_invalid_rate, 0), 9) AS pp_invalid_rate
FROM spine s LEFT JOIN agg a ON a.feature = s.feature AND a.bin = s.bin"""


@register("fixed_bin_rates", _fixed_rates_sql())
def q_fixed_bin_rates(spark, sf_dir):
    """E6 / B4 + A12-A14: missed, invalid-interval and invalid-point rates per
    fixed feature bin (np.histogram edges), 0 for empty bins."""
    df = _flagged(spark, sf_dir)
    edges = _fixed_edges()
    longf = df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), B.left_closed_bin(f, e).alias("bin")) for f, e in edges.items()
    ])).alias("fb"), "covered", "valid", "pp_valid").select("fb.feature", "fb.bin", "covered", "valid", "pp_valid")
    rates = B.rate_by_bin(longf, "bin", {"missed_rate": ~F.col("covered"), "invalid_rate": ~F.col("valid"),
                                         "pp_invalid_rate": ~F.col("pp_valid")}, by=["feature"])
    spine = None
    for f, e in edges.items():
        sp = B.bin_spine(spark, e, {"feature": f})
        spine = sp if spine is None else spine.unionByName(sp)
    out = spine.join(F.broadcast(rates), ["feature", "bin"], "left")
    return out.select("feature", "bin", r9(F.col("lower")).alias("lower"), r9(F.col("upper")).alias("upper"),
                      F.coalesce("total", F.lit(0)).cast("long").alias("total"),
                      *[r9(F.coalesce(c, F.lit(0.0))).alias(c)
                        for c in ("missed_rate", "invalid_rate", "pp_invalid_rate")])


# --- A16, A22, A15, A21 -------------------------------------------------------

@register("feature_ranges", """
SELECT 'S' AS feature, min(S) AS min, max(S) AS max FROM predictions UNION ALL
SELECT 'sigma', min(sigma), max(sigma) FROM predictions UNION ALL
SELECT 'tau', min(tau), max(tau) FROM predictions UNION ALL
SELECT 'r', min(r), max(r) FROM predictions""")
def q_feature_ranges(spark, sf_dir):
    """Min and max per feature, one row per feature."""
    return S.feature_ranges(fx.predictions(spark, sf_dir), FEATURES)


def _hist_sql(flag: str = "valid", k: int = 10):
    parts = []
    for f in FEATURES:
        step = f"((mx - mn)/{k})"
        binv = _sql_bin_sum(f, [f"(mn + {i}*{step})" for i in range(1, k)], ">=")
        parts.append(f"""
  SELECT '{f}' AS feature, s.bin, s.lower, s.upper, coalesce(c.n, 0) AS n FROM
   (SELECT CAST(i AS INTEGER) AS bin, mn + i*{step} AS lower,
           CASE WHEN i = {k - 1} THEN mx ELSE mn + (i + 1)*{step} END AS upper
    FROM (SELECT min({f}) AS mn, max({f}) AS mx FROM bad) m, range({k}) t(i)) s
   LEFT JOIN (SELECT {binv} AS bin, count(*) AS n FROM bad,
              (SELECT min({f}) AS mn, max({f}) AS mx FROM bad) m GROUP BY 1) c ON c.bin = s.bin""")
    return f"""
WITH {FLAGGED},
bad AS (SELECT * FROM flagged WHERE NOT {flag}),
h AS ({' UNION ALL '.join(parts)})
SELECT feature, bin, round(lower, 9) AS lower, round(upper, 9) AS upper, n FROM h"""


@register("feature_histogram", _hist_sql())
def q_feature_histogram(spark, sf_dir):
    """10-bin equal-width histogram of each feature over the crossed
    (valid = false) intervals, np.histogram rules."""
    bad = _flagged(spark, sf_dir).filter(~F.col("valid"))
    return S.histograms(spark, bad, FEATURES, 10)


@register("feature_histogram_pp", _hist_sql("pp_valid", 50))
def q_feature_histogram_pp(spark, sf_dir):
    """50-bin histogram of each feature over the point-invalid
    (pp_valid = false) predictions."""
    bad = _flagged(spark, sf_dir).filter(~F.col("pp_valid"))
    return S.histograms(spark, bad, FEATURES, 50)


_SUMMARY_COLS = ("y_true", "lb", "ub", "S", "sigma", "tau", "r")


def _summary_sql():
    parts = [f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 9) AS mean,
       round(stddev_samp({c}), 9) AS std, round(min({c}), 9) AS min,
       round(quantile_cont({c}, 0.25), 9) AS q25, round(quantile_cont({c}, 0.5), 9) AS q50,
       round(quantile_cont({c}, 0.75), 9) AS q75, round(max({c}), 9) AS max FROM predictions"""
             for c in _SUMMARY_COLS]
    return " UNION ALL ".join(parts)


@register("numeric_summary", _summary_sql())
def q_numeric_summary(spark, sf_dir):
    """Count, mean, sample std, min, exact quartiles, max per column."""
    return S.numeric_summary(fx.predictions(spark, sf_dir), _SUMMARY_COLS)


_RANK_COLS = ("S", "sigma", "tau", "r", "y_true", "valid", "pp_valid")


def spearman_sql(ctes: str, source: str, columns) -> str:
    """DuckDB Spearman: average rank = rank() + (ties - 1) / 2, then corr."""
    ranks = ",\n  ".join(
        f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0) AS rk_{c}"
        for c in columns)
    pairs = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            pairs.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(rk_{a}, rk_{b}), 9) AS rho FROM rk")
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return f"""
WITH {ctes},
v AS (SELECT {cols} FROM {source}),
rk AS (SELECT {ranks} FROM v)
{' UNION ALL '.join(pairs)}"""


def _spearman_sql():
    return spearman_sql(FLAGGED, "flagged", _RANK_COLS)


@register("spearman_matrix", _spearman_sql())
def q_spearman_matrix(spark, sf_dir):
    """Spearman rank correlation (average ranks for ties, booleans as
    0/1) between features, truth and validity flags; upper triangle."""
    df = _flagged(spark, sf_dir)
    return S.spearman_long(df, _RANK_COLS)
