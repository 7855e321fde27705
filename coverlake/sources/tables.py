"""Readers for the driver tables (one Parquet dataset per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan; projections and filters applied later are pushed
    into the scan by Catalyst (ReadSchema / PushedFilters).  Parallelism comes
    from the files' row groups.

    ``coverlake.scan.partitions`` (unset by default; the bench sets it) deals
    the rows out to that many partitions by their first column: a row group
    is never split, so a table in one row group is otherwise one task."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get("coverlake.scan.partitions", None)
    return df.repartition(int(parts), df.columns[0]) if parts else df
