"""Conformal calibration queries."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from coverlake.functions import interval as iv
from coverlake.functions.hashing import hash_uniform_sql
from coverlake.functions.losses import abs_error, pinball
from coverlake.operators import conformal as C
from coverlake.operators import splits as sp
from coverlake.queries._sql import KEYS
from coverlake.queries.splits import KEY_SQL, SPLIT_SEED, _role_sql
from coverlake.registry import register
from coverlake.sources import fixtures as fx
from coverlake.sources.fixtures import KEY_COLS

ALPHA = 0.1

SCORED_SQL = f"""
scored AS (SELECT *, greatest(lb - y_true, y_true - ub) AS score,
                  {_role_sql(hash_uniform_sql(SPLIT_SEED, KEY_SQL))} AS role FROM predictions),
cal AS (SELECT * FROM scored WHERE role = 'calibration'),
sizes AS (SELECT seed_id, count(*) AS n, CAST(ceil(0.9*(count(*) + 1)) AS BIGINT) AS k FROM cal GROUP BY seed_id),
ranked AS (SELECT seed_id, score, row_number() OVER (PARTITION BY seed_id ORDER BY score) AS rn FROM cal),
qhat AS (SELECT z.seed_id, z.n, z.k, CASE WHEN z.k > z.n THEN CAST('inf' AS DOUBLE) ELSE r.score END AS q_hat
         FROM sizes z LEFT JOIN ranked r ON r.seed_id = z.seed_id AND r.rn = z.k)"""


def _scored(spark, sf_dir):
    df = sp.hash_split(fx.predictions(spark, sf_dir), KEY_COLS, SPLIT_SEED)
    return C.add_scores(df)


def _qhat(spark, sf_dir, scored=None):
    scored = scored if scored is not None else _scored(spark, sf_dir)
    cal = scored.filter(F.col("role") == "calibration")
    return C.conformal_constant(cal, Decimal(str(ALPHA)), ["seed_id"])


@register("cqr_scores", f"""
SELECT {KEYS}, round(greatest(lb - y_true, y_true - ub), 9) AS score FROM predictions""")
def q_cqr_scores(spark, sf_dir):
    """CQR conformity score per row."""
    return C.add_scores(fx.predictions(spark, sf_dir)).select(*KEY_COLS, F.round("score", 9).alias("score"))


@register("pinball_loss", """
SELECT seed_id,
       round(avg(CASE WHEN y_true >= lb THEN 0.05*(y_true - lb) ELSE 0.95*(lb - y_true) END), 9) AS pinball_lo,
       round(avg(CASE WHEN y_true >= pp THEN 0.5*(y_true - pp) ELSE 0.5*(pp - y_true) END), 9) AS pinball_med,
       round(avg(CASE WHEN y_true >= ub THEN 0.95*(y_true - ub) ELSE 0.05*(ub - y_true) END), 9) AS pinball_hi,
       round(avg(abs(y_true - pp)), 9) AS mae
FROM predictions GROUP BY seed_id""")
def q_pinball_loss(spark, sf_dir):
    """P23 + A18: mean pinball loss of the three quantile predictions and the
    median's MAE per seed (MAE = 2 x pinball at 0.5)."""
    df = fx.predictions(spark, sf_dir)
    return df.groupBy("seed_id").agg(
        F.round(F.avg(pinball("y_true", "lb", 0.05)), 9).alias("pinball_lo"),
        F.round(F.avg(pinball("y_true", "pp", 0.5)), 9).alias("pinball_med"),
        F.round(F.avg(pinball("y_true", "ub", 0.95)), 9).alias("pinball_hi"),
        F.round(F.avg(abs_error("y_true", "pp")), 9).alias("mae"))


@register("conformal_constant", f"""
WITH {SCORED_SQL}
SELECT seed_id, n, k, round(q_hat, 9) AS q_hat FROM qhat""")
def q_conformal_constant(spark, sf_dir):
    """M2: per seed, n calibration scores, k = ceil(0.9 (n + 1)), Q = k-th
    smallest score (exact, distributed order statistic)."""
    q = _qhat(spark, sf_dir)
    return q.select("seed_id", "n", "k", F.round("q_hat", 9).alias("q_hat"))


@register("cqr_intervals", f"""
WITH {SCORED_SQL}
SELECT {', '.join('s.' + c for c in KEY_COLS)}, round(s.lb - q.q_hat, 9) AS lb_cqr, round(s.ub + q.q_hat, 9) AS ub_cqr,
       coalesce(s.lb - q.q_hat <= s.y_true AND s.y_true <= s.ub + q.q_hat, false) AS covered_cqr
FROM scored s JOIN qhat q ON q.seed_id = s.seed_id WHERE s.role = 'validation'""")
def q_cqr_intervals(spark, sf_dir):
    """M3: conformalised intervals [q_lo - Q, q_hi + Q] on the validation rows."""
    scored = _scored(spark, sf_dir)
    test = scored.filter(F.col("role") == "validation")
    out = C.cqr_intervals(test, _qhat(spark, sf_dir, scored), ["seed_id"])
    return out.select(*KEY_COLS, F.round("lb_cqr", 9).alias("lb_cqr"), F.round("ub_cqr", 9).alias("ub_cqr"),
                      iv.covered("y_true", "lb_cqr", "ub_cqr").alias("covered_cqr"))


@register("cqr_vs_raw_coverage", f"""
WITH {SCORED_SQL},
t AS (SELECT s.seed_id, s.y_true, s.lb, s.ub, s.lb - q.q_hat AS lb_c, s.ub + q.q_hat AS ub_c
      FROM scored s JOIN qhat q ON q.seed_id = s.seed_id WHERE s.role = 'validation')
SELECT seed_id, count(*) AS n_test,
       round(avg(CAST(coalesce(lb <= y_true AND y_true <= ub, false) AS DOUBLE)), 9) AS coverage_raw,
       round(avg(CAST(coalesce(lb_c <= y_true AND y_true <= ub_c, false) AS DOUBLE)), 9) AS coverage_cqr,
       round(100*avg(CAST(ub < lb AS DOUBLE)), 9) AS crossed_pct_raw,
       round(100*avg(CAST(ub_c < lb_c AS DOUBLE)), 9) AS crossed_pct_cqr
FROM t GROUP BY seed_id""")
def q_cqr_vs_raw_coverage(spark, sf_dir):
    """M3 vs M4 (CQR vs plain quantile intervals): coverage and crossing per seed."""
    scored = _scored(spark, sf_dir)
    test = scored.filter(F.col("role") == "validation")
    out = C.cqr_intervals(test, _qhat(spark, sf_dir, scored), ["seed_id"])
    return out.groupBy("seed_id").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.round(F.avg(iv.covered("y_true", "lb", "ub").cast("double")), 9).alias("coverage_raw"),
        F.round(F.avg(iv.covered("y_true", "lb_cqr", "ub_cqr").cast("double")), 9).alias("coverage_cqr"),
        F.round(100 * F.avg((F.col("ub") < F.col("lb")).cast("double")), 9).alias("crossed_pct_raw"),
        F.round(100 * F.avg((F.col("ub_cqr") < F.col("lb_cqr")).cast("double")), 9).alias("crossed_pct_cqr"))


_SUFFIXED = ("valid_cp", "pp_valid_cp", "valid_noncp", "pp_valid_noncp")


def _suffixed_sql():
    from coverlake.queries.binning import spearman_sql
    ctes = f"""{SCORED_SQL.strip()},
t AS (SELECT coalesce(s.lb - q.q_hat <= s.ub + q.q_hat, false) AS valid_cp,
             coalesce(s.lb - q.q_hat <= s.pp AND s.pp <= s.ub + q.q_hat, false) AS pp_valid_cp,
             coalesce(s.lb <= s.ub, false) AS valid_noncp,
             coalesce(s.lb <= s.pp AND s.pp <= s.ub, false) AS pp_valid_noncp
      FROM scored s JOIN qhat q ON q.seed_id = s.seed_id WHERE s.role = 'validation')"""
    return spearman_sql(ctes, "t", _SUFFIXED)


@register("flag_spearman_cp_vs_noncp", _suffixed_sql())
def q_flag_spearman_cp_vs_noncp(spark, sf_dir):
    """P8 (suffixes) + A21: rank correlation between the validity flags of
    the conformalised (``_cp``) and the raw quantile (``_noncp``) intervals
    on the validation rows."""
    from coverlake.operators import intervals as I
    from coverlake.operators import stats as S
    scored = _scored(spark, sf_dir)
    test = scored.filter(F.col("role") == "validation")
    out = C.cqr_intervals(test, _qhat(spark, sf_dir, scored), ["seed_id"])
    cp = I.add_suffix(out.select(*KEY_COLS, iv.ordered("lb_cqr", "ub_cqr").alias("valid"),
                                 iv.point_ordered("lb_cqr", "pp", "ub_cqr").alias("pp_valid")),
                      "_cp", ["valid", "pp_valid"])
    noncp = I.add_suffix(out.select(*KEY_COLS, iv.ordered("lb", "ub").alias("valid"),
                                    iv.point_ordered("lb", "pp", "ub").alias("pp_valid")),
                         "_noncp", ["valid", "pp_valid"])
    flags = I.join_by_key(cp, noncp, KEY_COLS)      # the reference concatenates the two frames by position
    return S.spearman_long(flags, _SUFFIXED)
