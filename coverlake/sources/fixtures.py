"""Fixture views derived by fixed formulas from the driver tables.

They imitate the reference's inputs (raw option quotes, daily closes, zero
curve, index membership, identifier links, interval predictions, grid
search errors).  Each view is a lazy projection over a whole driver table, so
Catalyst prunes columns and pushes filters into the Parquet scan.  The same
formulas are written as DuckDB SQL in ``coverlake.oracles`` for the oracle.

Fixed values (formula constants shared with the DuckDB twin):
  d0 = 1995-01-01; zero-curve tenors 10, 30, 60, 91, 152, 182, 273, 365, 547;
  curve cut-off 2001-09-01.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlake.sources.tables import read_table

# Fixed values --------------------------------------------------------------
D0 = _dt.date(1995, 1, 1)
CURVE_TENORS = (10, 30, 60, 91, 152, 182, 273, 365, 547)
CURVE_CUTOFF = _dt.date(2001, 9, 1)
AS_OF_DATE = _dt.date(2002, 1, 1)       # stands in for "today" in P11
LINK_TYPES = ("LC", "LU", "LS", "NR", "NU")
LINK_PRIMS = ("P", "C", "J")
# ---------------------------------------------------------------------------

KEY_COLS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "date")


def _d0() -> Column:
    return F.lit(D0)


def _days_since_d0(c: Column) -> Column:
    return F.datediff(c, _d0())


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw option quotes, one per lineitem row (strike still x1000)."""
    li = read_table(spark, sf_dir, "lineitem")
    ok, pk, sk, ln = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    d = F.to_date("l_shipdate")
    base = F.col("l_discount") * 100 + ln
    return li.select(
        ok, ln, pk, sk,
        (pk % 50).cast("int").alias("secid"),
        d.alias("date"),
        F.date_add(d, ((ok * 37 + pk * 11 + ln * 101) % 800).cast("int")).alias("exdate"),
        F.date_sub(d, ((ok + ln) % 6).cast("int")).alias("last_date"),
        F.when(sk % 40 == 0, F.lit(0.0)).otherwise(base).alias("best_bid"),
        (base + 0.05 + F.col("l_tax")).alias("best_offer"),
        (F.col("l_quantity") - 2).cast("double").alias("volume"),
        ((ok + sk) % 25).cast("double").alias("open_interest"),
        F.when(F.col("l_returnflag") == "N", "P").otherwise("C").alias("cp_flag"),
        F.when(pk % 97 == 0, F.lit(None).cast("double"))
         .otherwise(0.1 + 0.018 * F.col("l_quantity")).alias("impl_volatility"),
        (1000.0 * (40 + (pk * 7 + sk * 13 + ln * 29) % 120)).cast("double").alias("strike_price"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily close per (secid, date); some quotes find no spot on purpose."""
    li = read_table(spark, sf_dir, "lineitem")
    keys = (li.filter(F.col("l_partkey") % 31 != 0)
              .select((F.col("l_partkey") % 50).cast("int").alias("secid"),
                      F.to_date("l_shipdate").alias("date"))
              .distinct())
    return keys.withColumn(
        "close", 60.0 + F.col("secid") + 10 * F.sin(_days_since_d0(F.col("date")) / 90.0))


def zero_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, days, rate) on every distinct ship date before the cut-off."""
    li = read_table(spark, sf_dir, "lineitem")
    dates = (li.select(F.to_date("l_shipdate").alias("date"))
               .filter(F.col("date") < F.lit(CURVE_CUTOFF))
               .distinct())
    tenors = F.explode(F.array(*[F.lit(t) for t in CURVE_TENORS])).alias("days")
    grid = dates.select("date", tenors)
    n = _days_since_d0(F.col("date"))
    rate = (F.when((n + F.col("days")) % 41 == 0, F.lit(None).cast("double"))
             .otherwise(1.0 + F.col("days") / 400.0 + (n % 13) / 10.0))
    return grid.select("date", F.col("days").cast("int").alias("days"), rate.alias("rate"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index membership intervals [start, ending) per permno (whole part table)."""
    p = read_table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    start = F.date_add(_d0(), ((pk * 37) % 1800).cast("int"))
    return p.select((pk % 40).cast("int").alias("permno"),
                    start.alias("start"),
                    F.date_add(start, (200 + (pk * 53) % 900).cast("int")).alias("ending"))


def id_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """secid <-> permno links valid on [sdate, edate)."""
    p = read_table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    return p.select((pk % 50).cast("int").alias("secid"),
                    (pk % 40).cast("int").alias("permno"),
                    F.date_add(_d0(), ((pk * 17) % 700).cast("int")).alias("sdate"),
                    F.date_add(_d0(), (1500 + (pk * 41) % 1100).cast("int")).alias("edate"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval predictions with truth and features, one per lineitem row."""
    li = read_table(spark, sf_dir, "lineitem")
    ok, pk, sk, ln = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    y = F.round(F.col("l_extendedprice") / 100000.0, 9)
    step = F.lit(0.0012)
    return li.select(
        ok, ln, pk, sk, F.to_date("l_shipdate").alias("date"),
        ln.cast("int").alias("seed_id"),
        y.alias("y_true"),
        (0.5 + 0.02 * F.col("l_quantity")).alias("S"),
        (0.1 + 0.009 * (pk % 100)).alias("sigma"),
        ((14 + (ok * 37 + pk * 11) % 490) / 252.0).alias("tau"),
        (0.001 + 0.6 * F.col("l_tax")).alias("r"),
        F.round(y + step * ((sk * 7 + ok * 3) % 21 - 15), 9).alias("lb"),
        F.round(y + step * ((pk * 5 + ok) % 13 - 6), 9).alias("pp"),
        F.round(y + step * ((pk * 3 + ok * 5) % 25 - 6), 9).alias("ub"),
    )


def grid_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation errors of grid-search models: each lineitem row is one
    validation residual of one (sample_id, set_type, grid_no) model.  The
    grid-results table (A6) is then *computed* from it by ``mae_by_model``.
    """
    li = read_table(spark, sf_dir, "lineitem")
    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    cell = (ok * 7919 + pk * 104729 + sk * 31) % 4800
    y = F.round(F.col("l_extendedprice") / 100000.0, 9)
    return li.select(
        (cell / 800).cast("int").alias("sample_id"),
        F.when(((cell / 400).cast("int") % 2) == 0, "proper_train").otherwise("train").alias("set_type"),
        (cell % 400).cast("int").alias("grid_no"),
        y.alias("y_true"),
        F.round(y + 0.0001 * ((ok + pk * 3) % 41 - 20), 9).alias("y_pred"),
    )


# --- identifier master inputs (E3); permno space grows with the part table ---

def index_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    start = F.date_add(_d0(), ((pk * 37) % 1800).cast("int"))
    return p.select(pk.cast("int").alias("permno"), start.alias("start"),
                    F.date_add(start, (200 + (pk * 53) % 900).cast("int")).alias("ending"))


def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_partkey").cast("int").alias("permno"),
                       F.last_day(F.to_date("l_shipdate")).alias("date"))
              .agg(F.round(F.avg("l_discount"), 9).alias("ret")))


def stock_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    namedt = F.date_add(_d0(), ((pk * 29) % 1500).cast("int"))
    return p.select(
        pk.cast("int").alias("permno"),
        F.col("p_name").alias("comnam"),
        F.when(pk % 17 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("N"), ((pk * 7919) % 100000000).cast("string"))).alias("ncusip"),
        (10 + pk % 2).cast("int").alias("shrcd"),
        (1 + pk % 3).cast("int").alias("exchcd"),
        (F.col("p_size") * 100).cast("int").alias("hsiccd"),
        F.when(pk % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("ticker"),
        namedt.alias("namedt"),
        F.when(pk % 5 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add(namedt, (300 + (pk * 31) % 1200).cast("int"))).alias("nameendt"),
    )


def ccm_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two link records per permno (j = 0, 1)."""
    p = read_table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    j = F.col("j")
    linkdt = F.date_add(_d0(), ((pk * 13 + j * 900) % 2000).cast("int"))
    types = F.array(*[F.lit(t) for t in LINK_TYPES])
    prims = F.array(*[F.lit(t) for t in LINK_PRIMS])
    return (p.select(pk, F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
             .select(
                 F.lpad((pk % 997).cast("string"), 6, "0").alias("gvkey"),
                 F.concat(F.lit("0"), (j + 1).cast("string")).alias("iid"),
                 pk.cast("int").alias("permno"),
                 F.element_at(types, ((pk + j) % 5 + 1).cast("int")).alias("linktype"),
                 F.element_at(prims, ((pk * 3 + j) % 3 + 1).cast("int")).alias("linkprim"),
                 linkdt.alias("linkdt"),
                 F.when((pk + j) % 4 == 0, F.lit(None).cast("date"))
                  .otherwise(F.date_add(linkdt, (400 + (pk * 19) % 1000).cast("int"))).alias("linkenddt")))


def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    gv = F.lpad((F.col("p_partkey") % 997).cast("string"), 6, "0")
    return (p.groupBy(gv.alias("gvkey"))
             .agg(F.min("p_brand").alias("conm"), F.min("p_type").alias("tic"),
                  F.lpad(F.max("p_partkey").cast("string"), 9, "0").alias("cusip"),
                  F.lpad(F.min("p_partkey").cast("string"), 10, "0").alias("cik"),
                  (F.max("p_size") * 10).cast("int").alias("sic"),
                  (F.max("p_size") * 1000 + F.min("p_size")).cast("int").alias("naics"),
                  (10000000 + F.max("p_size") * 100).cast("string").alias("gsubind"),
                  (100000 + F.max("p_size")).cast("string").alias("gind")))
