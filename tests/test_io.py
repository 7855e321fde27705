"""Sources and sinks: CSV, catalog table modes, yearly export, streaming ingest."""

import os

from pyspark.sql import functions as F

from coverlake.operators.quotes import screen_quotes
from coverlake.sources import fixtures as fx
from coverlake.sources import io
from coverlake.streaming import incremental

from tests.conftest import SF_SMALL


def _month(spark):
    q = fx.quotes(spark, SF_SMALL)
    return q.filter((F.col("date") >= F.lit("1996-03-01").cast("date")) & (F.col("date") < F.lit("1996-04-01").cast("date")))


def test_csv_roundtrip_is_exact(spark):
    df = fx.predictions(spark, SF_SMALL).select("seed_id", "date", "y_true", "lb", "ub")
    path = io.scratch_path(spark, "t-csv")
    io.write_csv(df, path)
    back = io.read_csv(spark, path, "seed_id int, date date, y_true double, lb double, ub double")
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_table_overwrite_then_append(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    path = io.scratch_path(spark, "t-table")
    name = "t_" + os.path.basename(path).replace("-", "_")
    df.write.mode("overwrite").option("path", path).saveAsTable(name)
    df.write.mode("overwrite").option("path", path).saveAsTable(name)      # replace, not add
    assert spark.table(name).count() == 2
    df.write.mode("append").option("path", path).saveAsTable(name)
    assert spark.table(name).count() == 4


def test_export_by_year_and_slice(spark):
    df = fx.predictions(spark, SF_SMALL).select("seed_id", "date", "y_true")
    path = io.scratch_path(spark, "t-years")
    io.export_by_year(df, path)
    got = io.read_year(spark, path, 1997).count()
    assert got == df.filter(F.year("date") == 1997).count() and got > 0


def test_streaming_ingest_is_idempotent_on_replay(spark):
    q = _month(spark)
    landing = io.scratch_path(spark, "t-landing")
    target = io.scratch_path(spark, "t-target")
    ckpt = io.scratch_path(spark, "t-ckpt")
    incremental.land_files(q, landing)
    first = incremental.ingest_available(spark, landing, target, ckpt, q.schema)
    expected = screen_quotes(q)
    assert first.count() == expected.count()
    # a replayed drop of one whole day (same rows, new file) arrives later
    day = q.select(F.min("date")).first()[0]
    replay = q.filter(F.col("date") == F.lit(day)).withColumn("drop_day", F.col("date"))
    replay.write.mode("append").partitionBy("drop_day").parquet(landing)
    again = incremental.ingest_available(spark, landing, target, ckpt, q.schema)
    assert again.count() == expected.count()                  # no duplicates
    cols = expected.columns
    assert again.select(*cols).exceptAll(expected.select(*cols)).count() == 0
