"""Split-conformal calibration for quantile regression.

CQR: score_i = max(q_lo(x_i) - y_i, y_i - q_hi(x_i)) on the calibration
rows; with n scores and level alpha, k = ceil((1 - alpha)(n + 1)) and
Q = k-th smallest score (k > n gives Q = +inf); test interval
[q_lo - Q, q_hi + Q].  Q is found per group (fold, seed, sample) by the
distributed order-statistic search, so a group of any size is never
gathered into one task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlake.functions.losses import cqr_score
from coverlake.operators.quantiles import group_stats, kth_smallest, value_histogram


def add_scores(df: DataFrame, y="y_true", q_lo="lb", q_hi="ub", col: str = "score") -> DataFrame:
    """P24 as a column."""
    return df.withColumn(col, cqr_score(y, q_lo, q_hi))


def conformal_constant(scores: DataFrame, alpha: float = 0.1, by=(), score: str = "score") -> DataFrame:
    """M2: per group n, k and Q (``+inf`` when k > n)."""
    by = list(by)
    hist = value_histogram(scores, score, by)              # one scan for n and the brackets of the ranks
    stats = group_stats(hist, by)
    level = F.lit(Decimal(1) - Decimal(str(alpha)))        # exact decimal: no float rounding in k
    sizes = stats.select(*by, F.col("__n").alias("n")).withColumn("k", F.ceil(level * (F.col("n") + 1)).cast("long"))
    targets = sizes.select(*by, F.lit(0).alias("__tid"), F.col("k").alias("__k"))
    kth = kth_smallest(scores, score, targets, by, hist=hist).select(*by, F.col("__value").alias("__q"))
    if by:
        out = sizes.join(kth, by, "left")
    else:
        q = kth.first()
        out = sizes.withColumn("__q", F.lit(q["__q"] if q else None).cast("double"))
    return out.select(*by, "n", "k", F.when(F.col("k") > F.col("n"), F.lit(float("inf")))
                      .otherwise(F.col("__q")).alias("q_hat"))


def cqr_intervals(test: DataFrame, constants: DataFrame, by=(), q_lo="lb", q_hi="ub") -> DataFrame:
    """M3: widen raw quantile bounds by the group's Q (constants table has
    one row per group)."""
    by = list(by)
    c = constants.select(*by, "q_hat")
    if by:
        df = test.join(c, by, "inner")
    else:
        q = c.first()["q_hat"]
        df = test.withColumn("q_hat", F.lit(q))
    return df.withColumns({"lb_cqr": F.col(q_lo) - F.col("q_hat"), "ub_cqr": F.col(q_hi) + F.col("q_hat")})
