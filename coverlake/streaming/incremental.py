"""IO8: incremental, lossless and idempotent load of quote drops.

A landing folder of files is a streaming source.  Each micro-batch is screened
(F1) and written to a folder of its own, clustered by day; then a new version of
the table's manifest (the list of its drops with their rows and days) is
committed.  A version is one small file that appears by a rename, so a reader
always sees a whole version: ``read_table`` takes the latest one and reads the
folders that it lists, never a folder that is being written.  A batch that is run
again after a failure writes its folder anew and lists it once.

Rows whose key the table already holds are left out.  A Bloom filter per drop (a
bit array of a fixed size, counted together by a bitmap aggregate) tells which of a
batch's keys may be there already; only those are looked up, in the days that they
belong to.  A batch of new keys rereads nothing.  A false positive costs a lookup,
never a row.  The checkpoint lives under the shared ``spark.checkpoint.dir``;
``availableNow`` processes everything present and stops (a batch backfill), a
processing-time trigger keeps it running.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coverlake.operators.quotes import screen_quotes
from coverlake.session import cut_lineage, shuffle_partitions

BLOOM_BITS = 25
"""log2 of the bits of a drop's filter: 4 MB, in pieces of 4 kB."""
PROBES = 3


def cluster_by_day(df: DataFrame, day_col: str, files_per_day: int) -> DataFrame:
    """Route each day to ``files_per_day`` tasks (hash salt) before a
    partitioned write: without it every task writes a file into every day
    folder; with one task per day a huge day would land in one task."""
    if files_per_day <= 1:
        return df.repartition(F.col(day_col))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_day))
    return df.repartition(F.col(day_col), salt)


# --- manifest -------------------------------------------------------------------

def manifest(spark: SparkSession, target: str) -> dict:
    """The latest version: ``{"version": n, "schema": ..., "drops": {name: {"rows", "first", "last"}}}``."""
    try:
        rows = spark.read.option("recursiveFileLookup", True).text(f"{target}/manifest").collect()     # one short row per version
    except AnalysisException:           # nothing committed yet
        rows = []
    versions = [json.loads(r[0]) for r in rows]
    return max(versions, key=lambda v: v["version"], default={"version": 0, "schema": None, "drops": {}})


def _commit(spark: SparkSession, target: str, version: dict) -> None:
    """One row in one file, put in place by the job commit's rename; a version
    number that is taken already is refused."""
    row = spark.createDataFrame([(json.dumps(version, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("error").text(f"{target}/manifest/v{version['version']:09d}")


def read_table(spark: SparkSession, target: str, version: dict | None = None, days: list | None = None) -> DataFrame | None:
    """The rows of a version (the latest one by default), of the drops that can
    hold one of ``days``; None before the first commit."""
    v = version or manifest(spark, target)
    if v["schema"] is None:
        return None
    drops = [n for n, d in v["drops"].items() if d["rows"] and (days is None or any(d["first"] <= str(x) <= d["last"] for x in days))]
    reader = spark.read.schema(StructType.fromJson(v["schema"]))
    if not drops:
        return spark.createDataFrame([], StructType.fromJson(v["schema"]))
    table = reader.parquet(*[f"{target}/data/{n}" for n in drops])
    return table if days is None else table.filter(F.col("date").isin(days))


# --- Bloom filters ----------------------------------------------------------------

def _probes(keys, bits: int) -> Column:
    """The positions (1-based) of a key in a filter of 2 ** ``bits`` bits."""
    at = [F.call_function("shiftrightunsigned", F.xxhash64(F.lit(k), *keys), F.lit(64 - bits)) + 1 for k in range(PROBES)]
    return F.array(*at)


def bloom_filter(rows: DataFrame, keys, bits: int = BLOOM_BITS) -> DataFrame:
    """(bucket, bitmap): the filter's pieces that have a bit set."""
    at = rows.select(F.explode(_probes(keys, bits)).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))


def maybe_held(rows: DataFrame, keys, filters: DataFrame, bits: int = BLOOM_BITS) -> DataFrame:
    """The rows all of whose bits are set in the union of ``filters``.  What is
    sent to every task is that union, 2 ** (bits - 3) bytes at most."""
    union = F.broadcast(filters.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")))
    out = rows
    for k in range(PROBES):
        at = _probes(keys, bits)[k]
        out = out.withColumns({"__bucket": F.bitmap_bucket_number(at), "__bit": F.bitmap_bit_position(at)})
        hexes = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.call_function("shiftright", hexes, (F.col("__bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
        out = out.join(union, F.col("__bucket") == F.col("bucket")).filter(hit).drop("__bucket", "__bit", "bucket", "bitmap")
    return out


# --- batches ------------------------------------------------------------------------

def _write_batch(target: str, run: str, transform, key_cols, files_per_day: int, bits: int):
    def write(batch: DataFrame, epoch_id: int) -> None:
        drop, spark = f"{run}-{epoch_id}", batch.sparkSession
        new = transform(batch)
        keys = list(key_cols or new.columns)
        new = cut_lineage(new.dropDuplicates(keys))
        version = manifest(spark, target)
        others = {n: d for n, d in version["drops"].items() if n != drop}         # a batch that is run again
        filled = [n for n, d in others.items() if d["rows"]]
        if filled:
            filters = spark.read.schema("bucket long, bitmap binary").parquet(*[f"{target}/filters/{n}" for n in filled])
            suspects = cut_lineage(maybe_held(new, keys, filters, bits).select("date", *[k for k in keys if k != "date"]))
            days = [r[0] for r in suspects.select("date").distinct().collect()]  # trading days of the suspects
            if days:
                old = read_table(spark, target, {**version, "drops": others}, days).select(*keys)
                same = [suspects[k].eqNullSafe(old[k]) for k in keys]
                held = suspects.join(old, same, "left_semi").select(*keys)
                new = cut_lineage(new.join(held, [new[k].eqNullSafe(held[k]) for k in keys], "left_anti"))
        parts = max(shuffle_partitions(spark), files_per_day)
        new.repartitionByRange(parts, "date").sortWithinPartitions("date").write.mode("overwrite").parquet(f"{target}/data/{drop}")
        bloom_filter(new, keys, bits).coalesce(1).write.mode("overwrite").parquet(f"{target}/filters/{drop}")
        size = new.agg(F.count(F.lit(1)), F.min("date").cast("string"), F.max("date").cast("string")).first()
        _commit(spark, target, {"version": version["version"] + 1, "schema": json.loads(new.schema.json()),
                                "drops": {**others, drop: {"rows": size[0], "first": size[1], "last": size[2]}}})
    return write


def start_quote_ingest(spark: SparkSession, landing: str, target: str, checkpoint: str,
                       schema: StructType, *, available_now: bool = True,
                       max_files_per_trigger: int | None = None, transform=screen_quotes,
                       key_cols=None, files_per_day: int = 1, bloom_bits: int = BLOOM_BITS):
    """Start the stream; returns the ``StreamingQuery``.  ``key_cols``
    identify a row (all columns if None); ``files_per_day`` is the least number
    of files of a drop."""
    # many small drop folders are listed in a few tasks per core, not in one task each
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism)
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(landing)
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:8]       # a new checkpoint numbers its batches from 0 again
    writer = (stream.select(*schema.names).writeStream
                    .foreachBatch(_write_batch(target, run, transform, key_cols, files_per_day, bloom_bits))
                    .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def ingest_available(spark: SparkSession, landing: str, target: str, checkpoint: str, schema: StructType,
                     **options) -> DataFrame:
    """Run the ingest over everything in ``landing`` and return the table;
    ``options`` as for ``start_quote_ingest``."""
    q = start_quote_ingest(spark, landing, target, checkpoint, schema, available_now=True, **options)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return read_table(spark, target)


def land_files(quotes: DataFrame, landing: str, files_per_day: int = 1, mode: str = "overwrite") -> None:
    """Stage raw quotes as drops, one folder per trading day."""
    staged = cluster_by_day(quotes.withColumn("drop_day", F.col("date")), "drop_day", files_per_day)
    staged.write.mode(mode).partitionBy("drop_day").parquet(landing)
