"""Point-in-time index universe and identifier links.

Membership and link tables are interval tables.  Membership is evaluated at
change dates only (as in the reference: link changes between change dates
are not seen).  Validity periods meet dates in dyadic range joins (equi-joins on
key and block, no pair outside its period); the per-date tables that meet the big quote
table (change-date segments, date -> change date map) have one row per
calendar date at most; only those are hinted for broadcast.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverlake.functions.quote import fill_open_end
from coverlake.operators.joins import asof_merge, covered_points, day_coverage, dyadic_range_join
from coverlake.session import cut_lineage


def change_dates(membership: DataFrame, cutoff: _dt.date | None = None,
                 start_col: str = "start", end_col: str = "ending") -> DataFrame:
    """distinct(start U ending) >= cutoff, without the last one (the
    reference evaluates membership at every change date but the last)."""
    d = (membership.select(F.col(start_col).alias("change_date"))
                   .union(membership.select(F.col(end_col).alias("change_date"))))
    if cutoff is not None:
        d = d.filter(F.col("change_date") >= F.lit(cutoff))
    d = d.filter(F.col("change_date").isNotNull()).distinct()
    last = d.agg(F.max("change_date")).scalar()        # scalar sub-query, evaluated once
    # one row per calendar date at most; materialised once, read by every later step
    return cut_lineage(d.filter(F.col("change_date") < last))


def members_at_change(dates: DataFrame, membership: DataFrame, links: DataFrame) -> DataFrame:
    """At each change date d the permnos with start <= d < ending, then the
    secids linked to them with sdate <= d < edate; distinct (change_date, secid).

    Both interval tables are reduced to day-coverage bitmaps per key and
    32-day bucket first (any number of overlapping intervals per permno or
    per (permno, secid) collapses to one row per bucket), so no step pairs
    every interval of a key with every date."""
    mem_cov = day_coverage(membership, ["permno"], "start", "ending")
    active = covered_points(dates, mem_cov, "change_date").select("change_date", "permno")
    link_cov = day_coverage(links, ["permno", "secid"], "sdate", "edate")
    linked = covered_points(active, link_cov, "change_date", join_keys=["permno"])
    return linked.select("change_date", "secid").distinct()


def change_segments(dates: DataFrame) -> DataFrame:
    """Change dates as [change_date, next_change_date) segments.  The window
    runs over the change-date table only (one row per calendar date at most)."""
    w = Window.orderBy("change_date")
    return dates.select("change_date", F.lead("change_date").over(w).alias("next_change"))


def asof_change_date(trading_dates: DataFrame, dates: DataFrame, date_col: str = "date") -> DataFrame:
    """For each trading date the last change date <= it (dates before the
    first change date drop out), by one ordered merge of both."""
    td = trading_dates.select(date_col).distinct()
    return asof_merge(td, dates.select("change_date"), date_col, "change_date", how="inner")


def restrict_to_universe(quotes: DataFrame, dates: DataFrame, members: DataFrame,
                         date_col: str = "date", id_col: str = "secid") -> DataFrame:
    """Keep rows whose id is in the as-of member list of their date
    (``secid IN (list)`` as a left-semi join on (change_date, secid))."""
    # bounded by the calendar: one row per trading date
    amap = F.broadcast(asof_change_date(quotes.select(date_col), dates, date_col))
    tagged = quotes.join(amap, date_col, "inner")
    mem = members.withColumnRenamed("secid", id_col)      # any size: the planner and AQE choose the join
    return tagged.join(mem, ["change_date", id_col], "left_semi").drop("change_date")


def member_counts(dates: DataFrame, members: DataFrame) -> DataFrame:
    """Constituents per change date (0 kept)."""
    c = members.groupBy("change_date").agg(F.count(F.lit(1)).alias("n_constituents"))
    return dates.join(c, "change_date", "left").select(
        "change_date", F.coalesce("n_constituents", F.lit(0)).cast("long").alias("n_constituents"))


def member_lists(dates: DataFrame, members: DataFrame) -> DataFrame:
    """Comma-joined ascending secid list per change date ('' if none).
    The list length is bounded by the index size."""
    lists = members.groupBy("change_date").agg(
        F.concat_ws(",", F.sort_array(F.collect_set("secid")).cast("array<string>")).alias("secid_list"))
    return dates.join(lists, "change_date", "left").select(
        "change_date", F.coalesce("secid_list", F.lit("")).alias("secid_list"))


# --- identifier master (E3) -------------------------------------------------

def members_with_returns(index_list: DataFrame, returns: DataFrame) -> DataFrame:
    """Membership x monthly returns on permno with start <= date <= ending
    (closed)."""
    return dyadic_range_join(returns, index_list, "date", "start", "ending", keys=("permno",), closed_end=True)


def names_in_force(df: DataFrame, names: DataFrame, as_of: _dt.date) -> DataFrame:
    """P11 + J9: open name end -> as-of date, then namedt <= date <= nameendt
    (a left merge followed by the range filter, i.e. an inner join)."""
    n = names.withColumn("nameendt", fill_open_end("nameendt", as_of))
    return dyadic_range_join(df, n, "date", "namedt", "nameendt", keys=("permno",), closed_end=True)


def usable_links(links: DataFrame, as_of: _dt.date) -> DataFrame:
    """P22 + P11: link types starting with 'L', primary links 'C' or 'P',
    open end -> as-of date."""
    return (links.filter((F.substring("linktype", 1, 1) == "L") & F.col("linkprim").isin("C", "P"))
                 .withColumn("linkenddt", fill_open_end("linkenddt", as_of)))


def links_in_force(df: DataFrame, links: DataFrame) -> DataFrame:
    """Linkdt <= date <= linkenddt."""
    return dyadic_range_join(df, links, "date", "linkdt", "linkenddt", keys=("permno",), closed_end=True)
