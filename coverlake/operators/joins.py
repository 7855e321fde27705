"""Join helpers: bucketed and dyadic range joins, as-of merge, day-coverage bitmaps.

Spark has no native range or as-of join.  A range condition alone plans as a
nested-loop join; these helpers always give Spark an equi-key (an exact key
or a date bucket) so the join stays a hash or sort-merge join.  No side is
hinted for broadcast: the planner and AQE decide on measured bytes, but for the
dyadic join, whose exploded sides the planner takes for much smaller than they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlake.session import cut_lineage, importable, shuffle_partitions

def bucketed_range_join(points: DataFrame, intervals: DataFrame, point_col: str,
                        start_col: str, end_col: str, *, keys: tuple[str, ...] = (),
                        closed_end: bool = False, bucket_days: int = 32, how: str = "inner") -> DataFrame:
    """Join each point date to every interval that contains it.

    Intervals are ``[start, end)`` (``closed_end=False``) or ``[start, end]``.
    Each interval is exploded into the date buckets it touches (bucket width
    ``bucket_days``), points get their own bucket, and the join is an
    equi-join on ``keys + bucket`` with the exact range test as residual.
    The explosion factor is interval length / bucket width, independent of
    the number of points.
    """
    b = "__bucket"
    epoch = F.lit("1970-01-01").cast("date")
    pbucket = F.floor(F.datediff(F.col(point_col), epoch) / bucket_days).cast("long")
    sb = F.floor(F.datediff(F.col(start_col), epoch) / bucket_days).cast("long")
    eb = F.floor(F.datediff(F.col(end_col), epoch) / bucket_days).cast("long")
    iv = intervals.withColumn(b, F.explode(F.sequence(sb, F.greatest(sb, eb))))
    pts = points.withColumn(b, pbucket)
    cond = [pts[k] == iv[k] for k in keys] + [pts[b] == iv[b], pts[point_col] >= iv[start_col]]
    cond.append(pts[point_col] <= iv[end_col] if closed_end else pts[point_col] < iv[end_col])
    joined = pts.join(iv, cond, how)
    drop_keys = [iv[k] for k in keys]
    return joined.drop(pts[b]).drop(iv[b]).drop(*drop_keys) if keys else joined.drop(pts[b]).drop(iv[b])


# --- dyadic range join ----------------------------------------------------------
#
# A key with m intervals and n points costs m x n rows when the join is on the key
# alone.  Here the time line is cut into blocks of 1, 8, 64, ... days (for timestamps
# of 1, 64, 4096, ... microseconds).  An interval is the disjoint union of at most
# two runs of blocks per size, a point lies in one block of each size, and the two
# meet in an equi-join on (key, size, block).  A match is a point inside the interval,
# once: no residual test, no candidate that is thrown away.


def _instant(df: DataFrame, col: str):
    """(long, bits per level, levels) of a date or timestamp column."""
    if dict(df.dtypes)[col].startswith("timestamp"):
        return F.unix_micros(F.col(col).cast("timestamp")), 6, 10
    return F.unix_date(F.col(col)).cast("long"), 3, 6


def interval_blocks(start: Column, end: Column, bits: int, levels: int) -> Column:
    """The blocks (level, block) whose disjoint union is [start, end); none if it is empty."""
    down = lambda x, j: F.call_function("shiftright", x, F.lit(bits * j))
    up = lambda x, j: -down(-x, j)
    none = F.array().cast("array<struct<level:int,block:bigint>>")

    def run(j, lo, hi):                          # blocks lo .. hi - 1 of level j
        blocks = F.transform(F.sequence(lo, F.greatest(lo, hi - 1)), lambda b: F.struct(F.lit(j).alias("level"), b.alias("block")))
        return F.when(lo < hi, blocks).otherwise(none)

    parts = []
    for j in range(levels):
        lo, hi = up(start, j), down(end, j)
        if j == levels - 1:
            parts.append(run(j, lo, hi))
            continue
        lo_up, hi_up = up(start, j + 1), down(end, j + 1)
        some = lo_up < hi_up                     # larger blocks fill the middle
        wide = F.lit(1 << bits).cast("long")
        parts.append(F.when(some, F.concat(run(j, lo, lo_up * wide), run(j, hi_up * wide, hi))).otherwise(run(j, lo, hi)))
    return F.concat(*parts)


def dyadic_range_join(points: DataFrame, intervals: DataFrame, point_col: str, start_col: str, end_col: str, *,
                      keys: tuple[str, ...] = (), closed_end: bool = False) -> DataFrame:
    """Each point with each interval of its key that contains it ([start, end),
    or [start, end] with ``closed_end``); a missing point, start or end matches
    nothing.  Rows: points x levels + intervals x blocks + matches.

    Merged by hint: Spark's size of an exploded side is that of the side before it,
    some forty times too small, so it would send all blocks through the driver as a
    broadcast.  A merge join spills, and AQE splits its skewed partitions."""
    t, bits, levels = _instant(points, point_col)
    start, end = _instant(intervals, start_col)[0], _instant(intervals, end_col)[0]
    level = F.explode(F.array(*[F.struct(F.lit(j).alias("level"), F.call_function("shiftright", t, F.lit(bits * j)).alias("block"))
                                for j in range(levels)]))
    pts = points.withColumn("__at", level)
    spread = intervals.repartition(shuffle_partitions(intervals.sparkSession))      # a small file is one task, its blocks are many
    iv = spread.withColumn("__in", F.explode(interval_blocks(start, end + (1 if closed_end else 0), bits, levels)))
    cond = [pts[k] == iv[k] for k in keys] + [F.col("__at.level") == F.col("__in.level"), F.col("__at.block") == F.col("__in.block")]
    return pts.join(iv.hint("merge"), cond, "inner").drop(*[iv[k] for k in keys]).drop("__at", "__in")


# --- as-of merge --------------------------------------------------------------------
#
# Points and events of all keys are sorted together once: one range partitioning on
# (key, time), whatever the number of events of a key or the gap between them.  Each
# partition is read in order and remembers its last event; the last event of the
# partitions before (a row per partition) is handed to it, since the event that a
# point wants may lie there.  Nothing is grouped by key and nothing is exploded.


def _last_events(batches):
    """The last event of a partition, with the partition's number."""
    last = None
    for batch in batches:
        at = np.flatnonzero(batch.column("__side").to_numpy() == 0)
        if len(at):
            last = batch.slice(int(at[-1]), 1)
    if last is not None:
        yield pa.RecordBatch.from_arrays([*last.columns, pa.array([TaskContext.get().partitionId()], pa.int32())], names=[*last.schema.names, "__pid"])


def _same_as_before(table: pa.Table, names) -> np.ndarray:
    """Has a row the keys of the row before it?  (A missing key equals nothing.)"""
    same = np.ones(max(0, table.num_rows - 1), dtype=bool)
    for name in names:
        column = table.column(name).combine_chunks()
        same &= pc.fill_null(pc.equal(column.slice(1), column.slice(0, len(column) - 1)), False).to_numpy(zero_copy_only=False)
    return same


def asof_merge(points: DataFrame, events: DataFrame, point_time: str, event_time: str, *, keys: tuple[str, ...] = (),
               strict: bool = False, how: str = "left") -> DataFrame:
    """Each point with the last event of its key at or before it (``strict``:
    before it): the point's columns, then the event's other than ``keys``.  Among
    events of one key and time the one with the largest columns, in their order,
    counts.  A point without an event, or with a missing key or time, has NULLs
    (``how="left"``) or is left out (``"inner"``); events with a missing key or time
    are nobody's.  Dates and timestamps of any resolution."""
    spark = points.sparkSession
    importable(spark)
    extra = [c for c in events.columns if c not in keys]
    clash = {c.lower() for c in extra} & {c.lower() for c in points.columns}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    usable = events.filter(F.col(event_time).isNotNull())
    for k in keys:
        usable = usable.filter(F.col(k).isNotNull())
    both = points.select(F.col(point_time).alias("__t"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.lit(1).alias("__side"),
                         *[F.col(c).alias(f"p{i}") for i, c in enumerate(points.columns)])
    both = both.unionByName(usable.select(F.col(event_time).alias("__t"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                                          F.lit(0).alias("__side"), *[F.col(c).alias(f"e{i}") for i, c in enumerate(extra)]), allowMissingColumns=True)
    key_cols, event_cols = [f"__k{i}" for i in range(len(keys))], [f"e{i}" for i in range(len(extra))]
    side = F.desc("__side") if strict else F.asc("__side")
    parts = shuffle_partitions(spark)
    ranged = cut_lineage(both.repartitionByRange(parts, *key_cols, "__t").sortWithinPartitions(*key_cols, "__t", side, *event_cols))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    lasts = ranged.mapInArrow(_last_events, f"{fields}, __pid int").toArrow()                  # a row per partition
    order = np.argsort(lasts.column("__pid").to_numpy(), kind="stable")
    handed = spark.sparkContext.broadcast((lasts.column("__pid").to_numpy()[order], lasts.drop_columns(["__pid"]).take(pa.array(order))))

    point_cols = [f"p{i}" for i in range(len(points.columns))]

    def run(batches):
        numbers, rows = handed.value
        at = int(np.searchsorted(numbers, TaskContext.get().partitionId())) - 1                # the nearest partition before with an event
        carry = rows.slice(at, 1) if at >= 0 else None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if carry is None else pa.concat_tables([carry.cast(table.schema), table])
            n = table.num_rows
            is_event = table.column("__side").to_numpy() == 0
            last = np.maximum.accumulate(np.where(is_event, np.arange(n), -1))
            group = np.concatenate([[0], np.cumsum(~_same_as_before(table, key_cols))])
            point = np.flatnonzero(~is_event & (np.arange(n) >= n - batch.num_rows))
            known = ~pc.is_null(table.column("__t")).to_numpy()[point]
            j = last[point]
            good = known & (j >= 0) & (group[j] == group[point])
            keep = point if how == "left" else point[good]
            take = pa.array(np.where(good, j, 0) if how == "left" else j[good], mask=~good if how == "left" else None)
            yield from _beside(table, point_cols, keep, event_cols, take)
            carry = table.slice(int(last[-1]), 1) if last[-1] >= 0 else None

    schema = ", ".join(f"p{i} {points.schema[c].dataType.simpleString()}" for i, c in enumerate(points.columns))
    schema += "".join(f", e{i} {events.schema[c].dataType.simpleString()}" for i, c in enumerate(extra))
    return ranged.mapInArrow(run, schema).toDF(*points.columns, *extra)


def _beside(table: pa.Table, left, rows, right, others):
    """Columns of some rows beside columns of other rows."""
    a, b = table.select(left).take(pa.array(rows)), table.select(right).take(others)
    yield from pa.table([*a.columns, *b.columns], names=[*left, *right]).combine_chunks().to_batches()


# --- day-coverage bitmaps -----------------------------------------------------
#
# When only *whether* some interval covers a date matters (semi-join
# semantics), overlapping intervals of one key need not be paired with every
# point: each interval is cut into 32-day buckets, each piece becomes a
# 32-bit day mask, and masks are OR-ed per (key, bucket) -- a partial
# aggregation, so any number of overlapping intervals per key collapses to
# one row per bucket before the shuffle.  A point then equi-joins its
# (key, bucket) row and tests one bit.

MASK_DAYS = 32
_EPOCH = "1970-01-01"


def day_coverage(intervals: DataFrame, keys, start_col: str, end_col: str,
                 closed_end: bool = False) -> DataFrame:
    """(keys..., __bucket, __mask): days covered by the union of the
    intervals of each key, as one bitmap per 32-day bucket."""
    epoch = F.lit(_EPOCH).cast("date")
    s = F.datediff(F.col(start_col), epoch)
    e = F.datediff(F.col(end_col), epoch) + (1 if closed_end else 0)       # exclusive end
    iv = intervals.select(*keys, s.alias("__s"), e.alias("__e")).filter(F.col("__e") > F.col("__s"))
    iv = iv.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__s") / MASK_DAYS).cast("long"),
                                                        F.floor((F.col("__e") - 1) / MASK_DAYS).cast("long"))))
    base = F.col("__bucket") * MASK_DAYS
    lo = F.greatest(F.col("__s") - base, F.lit(0)).cast("int")
    hi = F.least(F.col("__e") - base, F.lit(MASK_DAYS)).cast("int")
    one = F.lit(1).cast("long")
    mask = F.call_function("shiftleft", one, hi) - F.call_function("shiftleft", one, lo)
    return iv.groupBy(*keys, "__bucket").agg(F.bit_or(mask).alias("__mask"))


def covered_points(points: DataFrame, coverage: DataFrame, point_col: str, join_keys=()) -> DataFrame:
    """Points whose date is covered for a key: equi-join on (join_keys,
    bucket) and a one-bit test.  Extra key columns of ``coverage`` (beyond
    ``join_keys``) come along, one output row per covering key value."""
    epoch = F.lit(_EPOCH).cast("date")
    p = F.datediff(F.col(point_col), epoch)
    pts = points.withColumns({"__bucket": F.floor(p / MASK_DAYS).cast("long"),
                              "__bit": (p - F.floor(p / MASK_DAYS) * MASK_DAYS).cast("int")})
    j = pts.join(coverage, list(join_keys) + ["__bucket"], "inner")
    hit = F.call_function("shiftright", F.col("__mask"), F.col("__bit")).bitwiseAND(F.lit(1).cast("long")) == 1
    return j.filter(hit).drop("__bucket", "__bit", "__mask")
