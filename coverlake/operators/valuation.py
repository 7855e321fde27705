"""Bulk valuation.

Black-Scholes values are native Column expressions (normal CDF by
polynomial), so valuing a quote table is one codegen'd projection.  The
strike ladder draws its normals from md5(seed:key:j), so the expansion is
repeatable under any partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlake.functions.hashing import hash_normal
from coverlake.functions.normal import with_bs_values


def strike_ladder(base: DataFrame, key_cols, kappa: int, spot: str = "S", seed: int = 7,
                  z_mean: float = 1.0, z_std: float = 0.1) -> DataFrame:
    """P25: kappa strikes per base row, K = S / z with z ~ N(z_mean, z_std)."""
    out = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(kappa))).alias("j"))
    z = z_mean + z_std * hash_normal(seed, *key_cols, "j")
    return out.withColumn("K", F.col(spot) / z)


def value_calls(df: DataFrame, S="S", K="K", r="r", sigma="sigma", tau="tau", out: str = "C") -> DataFrame:
    """P21 (call), staged so d1/d2 are computed once per row."""
    return with_bs_values(df, S, K, r, sigma, tau, None, out)


def market_model_gap(clean: DataFrame, rate_in_percent: bool = True) -> DataFrame:
    """P21 re-aimed: model value per unit strike for every clean quote
    (S = moneyness, K = 1, rate unit explicit), gap = market V - model V."""
    r = F.col("r") / 100.0 if rate_in_percent else F.col("r")
    valued = with_bs_values(clean, F.col("S"), F.lit(1.0), r, F.col("sigma"), F.col("tau"), "cp_flag", "V_model")
    return valued.withColumn("gap", F.col("V") - F.col("V_model"))


def quality_counters(df: DataFrame, price: str = "C", spot: str = "S") -> DataFrame:
    """Prices above spot and NULL prices."""
    return df.agg(F.count_if(F.col(price) > F.col(spot)).alias("n_price_above_spot"),
                  F.count_if(F.col(price).isNull()).alias("n_null_price"),
                  F.count(F.lit(1)).alias("n"))


def binned_surface(spark: SparkSession, df: DataFrame, x: str, y: str, z: str, grid_from: DataFrame,
                   n: int = 30) -> DataFrame:
    """Mean of ``z`` on an n x n grid of cells centred on linspace grid
    points; the grid spans ``grid_from`` (a subset), the means use all of
    ``df``; empty cells stay as NULL.  One hash aggregate replaces the
    reference's n*n boolean-mask scans."""
    mm = grid_from.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"),
                       F.max(y).alias("y1")).first()
    if mm["x0"] is None or mm["y0"] is None:          # no row in the box: no grid
        return spark.createDataFrame([], "i int, j int, y_center double, x_center double, mean_z double, n long")
    dx = (mm["x1"] - mm["x0"]) / (n - 1)
    dy = (mm["y1"] - mm["y0"]) / (n - 1)

    def cell(c: str, first: float, step: float):
        if step == 0:                                  # one value: all of it in the first cell
            return F.when(F.col(c) == first, F.lit(0))
        return F.floor((F.col(c) - (first - step / 2)) / step).cast("int")

    j, i = cell(x, mm["x0"], dx), cell(y, mm["y0"], dy)
    cells = (df.select(i.alias("i"), j.alias("j"), F.col(z).alias("z"))
               .filter(F.col("i").between(0, n - 1) & F.col("j").between(0, n - 1))
               .groupBy("i", "j").agg(F.avg("z").alias("mean_z"), F.count(F.lit(1)).alias("n")))
    spine = (spark.range(n * n).select((F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
                  .withColumns({"y_center": F.lit(mm["y0"]) + F.col("i") * dy,
                                "x_center": F.lit(mm["x0"]) + F.col("j") * dx}))
    out = spine.join(F.broadcast(cells), ["i", "j"], "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
