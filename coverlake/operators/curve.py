"""Zero-curve lookup: exact tenor and two-sided linear interpolation.

The reference finds, per quote, the largest tenor below and the smallest
tenor above its days-to-expiry on the same date with correlated MAX/MIN
sub-queries.  Here the curve of each date becomes its segments between
neighbouring tenors (a window over the curve table only), each with the tenors
and rates on both sides; a quote lies in exactly one segment of its date.  Quotes
meet the segments in one broadcast hash join on ``date`` (a calendar of dates with a
handful of tenors each) with the segment as residual, all within whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST, LAST = -(1 << 31), (1 << 31) - 1


def curve_segments(curve: DataFrame) -> DataFrame:
    """date, [``__from``, ``__to``) and its ends: per tenor ``__d`` the rate to
    take when it is hit (``__hit``, NULL if missing), when it is the lower
    neighbour (``__low``) and when it is the upper one (``__high``); ``__p_*`` are the
    tenor before, ``__n_*`` the one after.  A date's first segment ends at its first
    tenor.  Of several rates of a tenor the lowest counts, as lower neighbour the
    highest; a missing one beside others is missing as upper neighbour."""
    d = F.col("days").cast("int")
    tenors = curve.filter(d.isNotNull()).groupBy("date", d.alias("__d")).agg(
        F.min("rate").alias("__hit"), F.max("rate").alias("__low"),
        F.when(F.count("rate") == F.count(F.lit(1)), F.min("rate")).alias("__high"))
    w = Window.partitionBy("date").orderBy("__d")             # the tenors of one date
    own = tenors.select(
        "date", F.col("__d").alias("__from"), F.coalesce(F.lead("__d").over(w), F.lit(LAST)).alias("__to"), "__d", "__hit", "__low",
        F.lag("__d").over(w).alias("__p_d"), F.lag("__low").over(w).alias("__p_low"),
        F.lead("__d").over(w).alias("__n_d"), F.lead("__high").over(w).alias("__n_high"))
    none = F.lit(None)
    before = tenors.groupBy("date").agg(F.min_by(F.struct("__d", "__high"), "__d").alias("f")).select(
        "date", F.lit(FIRST).alias("__from"), F.col("f.__d").alias("__to"), none.cast("int").alias("__d"), none.cast("double").alias("__hit"),
        none.cast("double").alias("__low"), none.cast("int").alias("__p_d"), none.cast("double").alias("__p_low"),
        F.col("f.__d").alias("__n_d"), F.col("f.__high").alias("__n_high"))
    return own.unionByName(before)


def attach_rate(quotes: DataFrame, curve: DataFrame, days_col: str = "days",
                out_col: str = "rf", keep_parts: bool = False) -> DataFrame:
    """J2 exact tenor with non-NULL rate, else J3 interpolation between the
    neighbouring tenors (NULL neighbour rate -> NULL; no extrapolation);
    J4 = coalesce(exact, interpolated)."""
    seg = curve_segments(curve.select("date", "days", F.col("rate").cast("double").alias("rate")))
    seg = F.broadcast(seg.withColumnRenamed("date", "__date"))          # bounded by the calendar
    t = F.col(days_col)
    df = quotes.join(seg, (quotes["date"] == F.col("__date")) & (t >= F.col("__from")) & (t < F.col("__to")), "left")
    on = F.col("__d") == t
    t1, r1 = F.when(on, F.col("__p_d")).otherwise(F.col("__d")), F.when(on, F.col("__p_low")).otherwise(F.col("__low"))
    t2, r2 = F.col("__n_d"), F.col("__n_high")
    exact = F.when(on, F.col("__hit"))
    interp = F.when(t1.isNotNull() & t2.isNotNull(), r1 + F.try_divide(r2 - r1, (t2 - t1).cast("double")) * (t - t1))
    columns = {out_col: F.coalesce(exact, interp)}
    if keep_parts:
        columns |= {"exact_rate": exact, "interp_rate": interp, "t1": t1, "ir1": r1, "t2": t2, "ir2": r2}
    return df.withColumns(columns).drop("__date", "__from", "__to", "__d", "__hit", "__low", "__p_d", "__p_low", "__n_d", "__n_high")
