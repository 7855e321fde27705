"""Raw quotes -> clean feature table (secid, date, S, sigma, tau, r, cp_flag, V)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlake.operators import curve, quotes as qops

CLEAN_COLUMNS = ("secid", "date", "S", "sigma", "tau", "r", "cp_flag", "V")


def clean_features(quotes: DataFrame, prices: DataFrame, zero_curve: DataFrame,
                   keep_keys: tuple[str, ...] = ()) -> DataFrame:
    """One lazy plan: screen (F1) -> spot join (J1) -> features (P1-P6) ->
    moneyness band (F2) -> rate lookup (J2-J4) -> projection (P8) -> NULL
    drop (F3)."""
    df = qops.screen_quotes(quotes)
    df = qops.attach_spot(df, prices)
    df = qops.add_quote_features(df)
    df = qops.moneyness_band(df)
    df = curve.attach_rate(df, zero_curve, days_col="days", out_col="rf")
    out = df.select(*keep_keys, "secid", "date",
                    F.col("moneyness").alias("S"), F.col("impl_volatility").alias("sigma"),
                    "tau", F.col("rf").alias("r"), "cp_flag", "V")
    return qops.drop_incomplete(out, CLEAN_COLUMNS)
