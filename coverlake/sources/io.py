"""File and table sources / sinks (IO1-IO7).

Scratch output always goes under the session's shared checkpoint folder
(``spark.checkpoint.dir``), never a machine-local temp folder, so a job
that writes and re-reads survives executor loss on a cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coverlake.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/coverlake-io/{name}-{uuid.uuid4().hex[:12]}"


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """IO1: headed CSV with an explicit schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO2: headed CSV."""
    df.write.mode(mode).option("header", True).csv(path)


def read_jdbc(spark: SparkSession, url: str, *, table: str | None = None, query: str | None = None,
              properties: dict | None = None, partition_column: str | None = None,
              lower_bound=None, upper_bound=None, num_partitions: int | None = None) -> DataFrame:
    """IO3: a table or query from a relational database.  Pass a numeric or
    date ``partition_column`` with bounds so the read is split across
    executors instead of one connection; filters and projections applied
    afterwards are pushed into the database SQL."""
    reader = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    reader = reader.option("dbtable", table) if table else reader.option("query", query)
    if partition_column:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", str(lower_bound))
                        .option("upperBound", str(upper_bound)).option("numPartitions", str(num_partitions or 8)))
    return reader.load()


def write_table(df: DataFrame, name: str, mode: str = "append", partition_by=(), path: str | None = None) -> None:
    """IO4: write a catalog table, ``append`` or ``overwrite`` (replace);
    ``path`` makes it an external table in that folder."""
    w = df.write.mode(mode)
    if path:
        w = w.option("path", path)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=()) -> None:
    """IO5 write (IO6 with ``partition_by=("year",)``).  Dynamic partition
    overwrite replaces only the partitions present in ``df``."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def export_by_year(df: DataFrame, path: str, date_col: str = "date") -> None:
    """IO6: one dataset partitioned by calendar year (keys kept).  Rows are
    clustered by month, so a year gets twelve files at most, not one per task."""
    yearly = df.withColumn("year", F.year(date_col))
    write_parquet(yearly.repartition("year", F.month(date_col)), path, partition_by=("year",))


def read_year(spark: SparkSession, path: str, year: int) -> DataFrame:
    """IO7: one year's slice; the filter on the partition column prunes
    directories (PartitionFilters in the scan), i.e. date >= y-01-01 and
    date < (y+1)-01-01 without touching other years."""
    return spark.read.parquet(path).filter(F.col("year") == year)


# --- alignment by storage position (J13, P7, W1) ------------------------------

def with_position(files: DataFrame, col: str = "position") -> DataFrame:
    """0-based position of each row of a Parquet scan in storage order: files by
    path, rows as they stand.  A row's place in its file comes with the scan; the
    files' offsets are a running sum over one row per file.  Only a scan (and
    projections of it) has positions; they do not depend on how it is split."""
    placed = files.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    sizes = files.select(F.col("_metadata.file_path").alias("__file")).groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)       # a row per file
    offsets = sizes.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return placed.join(F.broadcast(offsets), "__file").withColumn(col, F.col("__off") + F.col("__at")).drop("__file", "__at", "__off")


def zip_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two Parquet scans side by side, row by row, without a key (the
    reference's column-wise concatenation).  Unequal lengths raise: a shorter
    side would leave rows without a partner."""
    a, b = left.count(), right.count()           # from the file footers
    if a != b:
        raise ValueError(f"{a} rows on the left, {b} on the right")
    return with_position(left, "__pos").join(with_position(right, "__pos"), "__pos").drop("__pos")


# --- co-partitioned storage (J1, J13) ----------------------------------------------

def write_bucketed(df: DataFrame, name: str, keys, buckets: int, path: str | None = None) -> None:
    """A table hashed and sorted by ``keys`` into ``buckets`` files: tables written
    with the same keys and number join and aggregate on them without a shuffle."""
    w = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (w.option("path", path) if path else w).saveAsTable(name)
