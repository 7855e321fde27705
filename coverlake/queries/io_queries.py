"""Source / sink round trips (IO1-IO8).  Each writes under the shared
checkpoint folder and re-reads, so the check covers the write path too."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlake.operators.quotes import attach_spot, screen_quotes
from coverlake.queries._sql import KEYS
from coverlake.queries.cleaning import CLEAN_SQL, SCREEN_SQL, q_clean_features
from coverlake.registry import register
from coverlake.session import cut_lineage, shuffle_partitions
from coverlake.sources import fixtures as fx
from coverlake.sources import io
from coverlake.sources.fixtures import KEY_COLS
from coverlake.streaming import incremental

CLEAN_SCHEMA = "secid int, date date, S double, sigma double, tau double, r double, cp_flag string, V double"
SLICE_YEAR = 1997
ROWS_PER_FILE = 500_000
"""Rows of a file of the positional sets, about; more rows make more files, not larger ones."""


@register("csv_roundtrip", f"SELECT * FROM ({CLEAN_SQL}) c")
def q_csv_roundtrip(spark, sf_dir):
    """IO2 + IO1: clean table written as headed CSV, read back with a schema."""
    path = io.scratch_path(spark, "csv")
    io.write_csv(q_clean_features(spark, sf_dir), path)
    return io.read_csv(spark, path, CLEAN_SCHEMA)


def _exported(spark, sf_dir):
    path = io.scratch_path(spark, "by-year")
    io.export_by_year(q_clean_features(spark, sf_dir), path)
    return path


@register("yearly_export_counts", f"""
SELECT year(date) AS year, count(*) AS n, round(sum(V), 6) AS sum_v FROM ({CLEAN_SQL}) c GROUP BY 1""")
def q_yearly_export_counts(spark, sf_dir):
    """IO5 + IO6: Parquet export partitioned by year, re-read, rows per year."""
    df = spark.read.parquet(_exported(spark, sf_dir))
    return df.groupBy(F.col("year").cast("int").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("V"), 6).alias("sum_v"))


@register("year_slice", f"""
SELECT secid, date, S, sigma, tau, r, cp_flag, V FROM ({CLEAN_SQL}) c
WHERE date >= DATE '{SLICE_YEAR}-01-01' AND date < DATE '{SLICE_YEAR + 1}-01-01'""")
def q_year_slice(spark, sf_dir):
    """IO7: one year read back through partition pruning."""
    return io.read_year(spark, _exported(spark, sf_dir), SLICE_YEAR).drop("year")


@register("table_write_modes", f"""
SELECT cp_flag, count(*) AS n FROM (SELECT * FROM ({CLEAN_SQL}) a UNION ALL
                                    SELECT * FROM ({CLEAN_SQL}) b WHERE cp_flag = 'C') u GROUP BY cp_flag""")
def q_table_write_modes(spark, sf_dir):
    """IO4: catalog table replaced with the clean table, then the calls
    appended once more; counts per flag show replace + append semantics."""
    clean = q_clean_features(spark, sf_dir)
    path = io.scratch_path(spark, "table")
    name = "coverlake_clean_" + path.rsplit("-", 1)[-1]
    io.write_table(clean, name, mode="overwrite", path=path)
    io.write_table(clean.filter(F.col("cp_flag") == "C"), name, mode="append", path=path)
    counts = cut_lineage(spark.table(name).groupBy("cp_flag").agg(F.count(F.lit(1)).alias("n")))
    spark.sql(f"DROP TABLE {name}")                 # the files stay in the scratch folder, the name goes
    return counts


@register("incremental_load", f"SELECT {KEYS}, secid, best_bid FROM quotes WHERE {SCREEN_SQL}")
def q_incremental_load(spark, sf_dir):
    """IO8: daily drops ingested by two runs of an availableNow stream.  The
    days on the first of a month come in two parts, the second part with the
    second run; that run also replays the days on the 15th of a month."""
    quotes = fx.quotes(spark, sf_dir)
    late = (F.dayofmonth("date") == 1) & (F.col("l_orderkey") % 2 == 0)
    landing = io.scratch_path(spark, "landing")
    target = io.scratch_path(spark, "quotes-table")
    ckpt = io.scratch_path(spark, "stream-ckpt")
    run = {"key_cols": list(KEY_COLS), "files_per_day": 1}
    incremental.land_files(quotes.filter(~late), landing)
    incremental.ingest_available(spark, landing, target, ckpt, quotes.schema, **run)
    incremental.land_files(quotes.filter(late | (F.dayofmonth("date") == 15)), landing, mode="append")
    out = incremental.ingest_available(spark, landing, target, ckpt, quotes.schema, **run)
    return out.select(*KEY_COLS, "secid", "best_bid")


@register("positional_concat", f"SELECT {KEYS}, y_true, lb, pp, ub FROM predictions")
def q_positional_concat(spark, sf_dir):
    """J13 by position: features with their keys in one Parquet set, predictions
    without any key in another of the same row order and other file sizes, put
    side by side by storage position."""
    pred = fx.predictions(spark, sf_dir)
    one, two = io.scratch_path(spark, "features"), io.scratch_path(spark, "intervals")
    keyed = pred.select(*KEY_COLS, "y_true", "lb", "pp", "ub")
    more = keyed.count() // ROWS_PER_FILE        # from the file footers
    keyed.repartitionByRange(5 + more, *KEY_COLS).sortWithinPartitions(*KEY_COLS).select(*KEY_COLS, "y_true").write.parquet(one)
    keyed.repartitionByRange(7 + 2 * more, *KEY_COLS).sortWithinPartitions(*KEY_COLS).select("lb", "pp", "ub").write.parquet(two)
    return io.zip_by_position(spark.read.parquet(one), spark.read.parquet(two))


@register("spot_lookup_bucketed", f"""
SELECT {', '.join('s.' + c for c in KEY_COLS)}, s.secid, round(p.close, 9) AS spot_price
FROM (SELECT * FROM quotes WHERE {SCREEN_SQL}) s LEFT JOIN prices p ON p.secid = s.secid AND p.date = s.date""")
def q_spot_lookup_bucketed(spark, sf_dir):
    """J1 on co-partitioned tables: screened quotes and closes stored by
    (secid, date), looked up without a shuffle of either side."""
    names, buckets = [], shuffle_partitions(spark)
    for kind, df in (("quotes", screen_quotes(fx.quotes(spark, sf_dir)).select(*KEY_COLS, "secid")), ("prices", fx.prices(spark, sf_dir))):
        path = io.scratch_path(spark, f"bucketed-{kind}")
        names.append(f"coverlake_{kind}_" + path.rsplit("-", 1)[-1])
        io.write_bucketed(df, names[-1], ["secid", "date"], buckets, path)
    quotes, prices = (spark.table(n) for n in names)
    out = attach_spot(quotes.hint("merge"), prices).select(*KEY_COLS, "secid", F.round("spot_price", 9).alias("spot_price"))
    for n in names:
        spark.sql(f"DROP TABLE {n}")             # the names go, the files stay in the scratch folder
    return out
