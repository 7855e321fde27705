"""Quote screens, spot lookup and quote features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlake.functions import quote as q

QUOTE_COLUMNS = ("secid", "date", "exdate", "last_date", "best_bid", "best_offer", "volume",
                 "open_interest", "cp_flag", "impl_volatility", "strike_price")


def screen_condition(min_days: int = 9, max_days: int = 730, max_stale: int = 5):
    """F1 predicate: 11 NOT NULLs; volume, open interest, bid > 0;
    min_days < expiry days < max_days; date - last_date < max_stale."""
    not_null = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in QUOTE_COLUMNS])
    expiry = F.datediff("exdate", "date")
    stale = F.datediff("date", "last_date")
    return (not_null & (F.col("volume") > 0) & (F.col("open_interest") > 0) & (F.col("best_bid") > 0)
            & (expiry > min_days) & (expiry < max_days) & (stale < max_stale))


def screen_quotes(quotes: DataFrame, **kw) -> DataFrame:
    """F1 quote screen (a filter, pushed toward the scan by Catalyst)."""
    return quotes.filter(screen_condition(**kw))


def attach_spot(quotes: DataFrame, prices: DataFrame, spot_col: str = "spot_price",
                on_duplicate: str = "max") -> DataFrame:
    """Left lookup of the close on (secid, date).

    The right side is reduced to one row per key first (``max`` makes the
    pick deterministic where the source keeps an arbitrary match); that
    aggregate hash-partitions prices on (secid, date), which the join reuses.
    ``on_duplicate='error'`` instead checks that the key is unique (one
    extra aggregate job) and raises if it is not.
    """
    spot = prices.groupBy("secid", "date").agg(F.max("close").alias(spot_col), F.count(F.lit(1)).alias("__n"))
    if on_duplicate == "error":
        dup = spot.filter(F.col("__n") > 1).limit(1).collect()
        if dup:
            raise ValueError(f"prices not unique on (secid, date): {dup[0]['secid']}, {dup[0]['date']}")
    return quotes.join(spot.drop("__n"), ["secid", "date"], "left")


def add_quote_features(df: DataFrame) -> DataFrame:
    """Strike, mid price, V = price/K, moneyness, days, tau."""
    df = df.withColumns({"K": q.strike("strike_price"),
                         "option_price": q.mid_price("best_bid", "best_offer")})
    df = df.withColumns({"V": q.per_strike("option_price", "K"),
                         "moneyness": q.moneyness("spot_price", "K"),
                         "days": q.days_between("exdate", "date")})
    return df.withColumn("tau", q.year_fraction("days"))


def moneyness_band(df: DataFrame, lo: float = 0.5, hi: float = 1.5, col: str = "moneyness") -> DataFrame:
    """DELETE WHERE m < lo OR m > hi -- rows with NULL moneyness survive."""
    m = F.col(col)
    return df.filter(m.isNull() | ~((m < lo) | (m > hi)))


def drop_incomplete(df: DataFrame, cols=None) -> DataFrame:
    """drop rows with a NULL in any of ``cols``."""
    return df.na.drop("any", subset=list(cols) if cols else None)
