"""Summaries: bin counts on a spine, ranges, histograms, describe-style
summary, Spearman matrix (A11, A15, A16, A21, A22)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coverlake.operators import bins as B
from coverlake.operators.quantiles import exact_quantiles, value_histogram
from coverlake.session import cut_lineage, importable, shuffle_partitions


def number(c: str):
    """A column as double, NaN as NULL (missing, like in pandas)."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def r9(c):
    return F.round(c, 9)


def counts_on_spine(spark: SparkSession, binned: DataFrame, edges, bin_col: str = "bin") -> DataFrame:
    """Rows per bin and percent of all binned rows; empty bins kept
    (spine of len(edges)-1 rows left-joined with the tiny count table)."""
    counts = binned.filter(F.col(bin_col).isNotNull()).groupBy(bin_col).agg(F.count(F.lit(1)).alias("n"))
    spine = B.bin_spine(spark, edges).withColumnRenamed("bin", bin_col)
    out = spine.join(F.broadcast(counts), bin_col, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = F.sum("n").over(Window.partitionBy())     # spine-sized (k rows)
    return out.select(bin_col, r9(F.col("lower")).alias("lower"), r9(F.col("upper")).alias("upper"), "n",
                      r9(100.0 * F.col("n") / total).alias("pct"))


def on_spine(spark: SparkSession, per_bin: DataFrame, edges, bin_col: str = "bin") -> DataFrame:
    """Left-join a per-bin table that has ``n`` onto the bin spine: empty
    bins get n = 0; adds lower / upper edges and the percent of all rows."""
    spine = B.bin_spine(spark, edges).withColumnRenamed("bin", bin_col)
    out = spine.join(F.broadcast(per_bin), bin_col, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = F.sum("n").over(Window.partitionBy())     # spine-sized (k rows)
    return out.withColumns({"lower": r9(F.col("lower")), "upper": r9(F.col("upper")),
                            "pct": r9(100.0 * F.col("n") / total)})


def feature_ranges(df: DataFrame, features) -> DataFrame:
    """One aggregate pass, then the 2 x k result is unpivoted to rows."""
    aggs = []
    for f in features:
        aggs += [F.min(number(f)).alias(f"{f}__min"), F.max(number(f)).alias(f"{f}__max")]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}__min").alias("min"), F.col(f"{f}__max").alias("max"))
        for f in features])).alias("s")).select("s.*")


def histograms(spark: SparkSession, df: DataFrame, features, k: int = 10) -> DataFrame:
    """``np.histogram(x, bins=k)`` per feature: edges linspace(min, max,
    k+1) from one small aggregate, left-closed bins, last bin closed, empty
    bins kept."""
    mm = df.agg(*[F.min(number(f)).alias(f"{f}__min") for f in features],
                *[F.max(number(f)).alias(f"{f}__max") for f in features]).first()
    edges = {}
    for f in features:
        lo, hi = mm[f"{f}__min"], mm[f"{f}__max"]
        if lo is None:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        step = (hi - lo) / k
        edges[f] = [lo + i * step for i in range(k)] + [hi]
    if not edges:
        return spark.createDataFrame([], "feature string, bin int, lower double, upper double, n long")
    longf = df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), B.left_closed_bin(f, e).alias("bin")) for f, e in edges.items()
    ])).alias("fb")).select("fb.feature", "fb.bin")
    counts = longf.filter(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    spine = None
    for f, e in edges.items():
        sp = B.bin_spine(spark, e, {"feature": f})
        spine = sp if spine is None else spine.unionByName(sp)
    out = spine.join(F.broadcast(counts), ["feature", "bin"], "left")
    return out.select("feature", "bin", r9(F.col("lower")).alias("lower"), r9(F.col("upper")).alias("upper"),
                      F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def numeric_summary(df: DataFrame, columns) -> DataFrame:
    """A15 (``DataFrame.describe()`` with exact quartiles) over a long (column,
    value) view; NaN counts as missing.  One scan gives a histogram per column
    with sums and variances per bucket, from which the moments follow; a second
    one the rows of the buckets that hold a quartile."""
    longf = (df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("v"))
                                          for c in columns])).alias("cv")).select("cv.column", "cv.v"))
    hist = value_histogram(longf, "v", ["column"], __sum=F.sum("__v"), __var=F.var_pop("__v"))
    stats = hist.groupBy("column").agg(F.min("__blo").alias("__lo"), F.max("__bhi").alias("__hi"), F.sum("__c").alias("__n"),
                                       (F.sum("__sum") / F.sum("__c")).alias("__mean"))      # one row per column
    away = F.col("__sum") / F.col("__c") - F.col("__mean")
    spread = hist.filter("__c > 0").join(F.broadcast(stats.select("column", "__mean")), "column").groupBy("column").agg(
        F.sum(F.col("__c") * (F.col("__var") + away * away)).alias("__ss"))
    std = F.sqrt(F.col("__ss") / F.when(F.col("__n") > 1, F.col("__n") - 1))
    moments = stats.join(spread, "column", "left").select(
        "column", F.col("__n").alias("count"), r9(F.col("__mean")).alias("mean"), r9(std).alias("std"),
        r9(F.col("__lo")).alias("min"), r9(F.col("__hi")).alias("max"))
    qs = exact_quantiles(longf, "v", [0.25, 0.5, 0.75], ["column"], prefix="q", hist=hist)
    out = moments.join(qs, "column", "left")
    return out.select("column", "count", "mean", "std", "min", *[r9(F.col(c)).alias(c) for c in ("q_25", "q_50", "q_75")],
                      "max").withColumnsRenamed({"q_25": "q25", "q_50": "q50", "q_75": "q75"})


HEAVY = 1000
"""Values of a column that a dictionary holds at most; any other value has about one row in so many at most."""


def heavy_values(long_: DataFrame) -> DataFrame:
    """(__col, __v, __w): the most frequent values of each column, as a mergeable
    sketch finds them, with their exact counts: at most ``HEAVY`` rows a column."""
    top = long_.groupBy("__col").agg(F.expr(f"approx_top_k(__v, {HEAVY}, {20 * HEAVY})").alias("t"))
    items = cut_lineage(top.select("__col", F.explode("t").alias("t")).select("__col", F.col("t.item").alias("__v")))
    found = long_.join(F.broadcast(items), ["__col", "__v"]).groupBy("__col", "__v").agg(F.count(F.lit(1)).alias("__w"))
    return cut_lineage(found)


def _local_ranks(batches):
    """Average ranks within one partition of cells sorted by (column, value): rows
    of the column below, plus half of the ties and a half.  The last value of a
    batch waits for the next one; ties are few, since frequent values are one
    weighted cell."""
    waiting, column, below = None, None, 0.0

    def ranked(table):
        nonlocal column, below
        col, v, w = (table.column(c).to_numpy() for c in ("__col", "__v", "__w"))
        new = np.ones(len(col), dtype=bool)
        new[1:] = (col[1:] != col[:-1]) | (v[1:] != v[:-1])
        first = np.flatnonzero(new)
        weight = np.add.reduceat(w, first).astype(np.float64)
        before = np.cumsum(weight) - weight
        opens = np.ones(len(first), dtype=bool)
        opens[1:] = col[first[1:]] != col[first[:-1]]
        start = before[opens] - np.where(col[first[opens]] == column, below, 0.0)       # only the first column can go on
        before = before - np.repeat(start, np.diff(np.append(np.flatnonzero(opens), len(first))))
        column, below = col[-1], before[-1] + weight[-1]
        rank = np.repeat(before + (weight + 1) / 2, np.diff(np.append(first, len(col))))
        return pa.RecordBatch.from_arrays([table.column(c).combine_chunks() for c in ("__col", "__v", "__w", "__row")] + [
            pa.array(np.full(len(col), TaskContext.get().partitionId(), np.int32)), pa.array(rank)],
            names=["__col", "__v", "__w", "__row", "__pid", "__rk"])

    for batch in batches:
        table = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        col, v = table.column("__col").to_numpy(), table.column("__v").to_numpy()
        last = int(np.flatnonzero((col != col[-1]) | (v != v[-1]))[-1]) + 1 if ((col != col[-1]) | (v != v[-1])).any() else 0
        if last:
            yield ranked(table.slice(0, last))
        waiting = table.slice(last)
    if waiting is not None and waiting.num_rows:
        yield ranked(waiting)


def average_ranks(cells: DataFrame) -> DataFrame:
    """``cells`` (__col int, __v double, __w weight, __row) with the average rank
    ``__rk`` of each value in its column, a weight of w counting as w equal rows.
    The cells are range-partitioned on (column, value) and ranked in place; a
    partition's offset is the weight of its column before it (a row per partition
    and column), so no column is sorted in one task and nothing is joined back."""
    importable(cells.sparkSession)
    parts = shuffle_partitions(cells.sparkSession)
    ranged = cells.repartitionByRange(parts, "__col", "__v").sortWithinPartitions("__col", "__v")
    local = cut_lineage(ranged.mapInArrow(_local_ranks, "__col int, __v double, __w bigint, __row bigint, __pid int, __rk double"))
    totals = local.groupBy("__col", "__pid").agg(F.sum("__w").alias("__t"))
    before = Window.partitionBy("__col").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(totals.select("__col", "__pid", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__off")))
    return local.join(F.broadcast(offsets), ["__col", "__pid"]).select("__col", "__v", "__row", (F.col("__rk") + F.col("__off")).alias("__rk"))


def spearman_long(df: DataFrame, columns) -> DataFrame:
    """Spearman matrix = Pearson correlation of average ranks (booleans
    as 0/1), rows with a missing value in any column dropped.

    Frequent values (all values of a boolean or of a short list of levels) have
    their rank in a bounded dictionary that every task gets; they are never
    shuffled as rows and make no hot key.  The other cells are ranked in place by
    one range partitioning and put back to their row by one grouping.  A table whose
    values are all in the dictionary is not shuffled at all.  Then all pairwise
    sums of products run in one pass.  Upper triangle as (col_a, col_b, rho)."""
    columns, n_cols = list(columns), len(columns)
    num = df.select(*[(number(c) + F.lit(0.0)).alias(f"__c{k}") for k, c in enumerate(columns)]).na.drop()
    num = cut_lineage(num.withColumn("__row", F.monotonically_increasing_id()))      # ids are fixed by the checkpoint
    long_ = num.select("__row", F.explode(F.array(*[F.struct(F.lit(k).alias("__col"), F.col(f"__c{k}").alias("__v"))
                                                    for k in range(n_cols)])).alias("p")).select("__row", "p.*")
    heavy, n = heavy_values(long_), num.count()
    in_dictionary = {r[0]: r[1] for r in heavy.groupBy("__col").agg(F.sum("__w")).collect()}       # a row per column
    light = [k for k in range(n_cols) if in_dictionary.get(k, 0) < n]
    cells = heavy.select("__col", "__v", "__w", F.lit(None).cast("bigint").alias("__row"))
    if light:
        rare = long_.filter(F.col("__col").isin(light)).join(F.broadcast(heavy.select("__col", "__v")), ["__col", "__v"], "left_anti")
        cells = cells.unionByName(rare.select("__col", "__v", F.lit(1).cast("bigint").alias("__w"), "__row"))
    ranks = average_ranks(cells)
    known, ranked = cut_lineage(ranks.filter("__row IS NULL")), num.select("__row", *[f"__c{k}" for k in range(n_cols)])
    for k in range(n_cols):
        mine = known.filter(F.col("__col") == k).select(F.col("__v").alias(f"__c{k}"), F.col("__rk").alias(f"__rk_{k}"))
        ranked = ranked.join(F.broadcast(mine), f"__c{k}", "left")
    ranked = ranked.select("__row", *[f"__rk_{k}" for k in range(n_cols)])
    if light:
        found = ranks.filter("__row IS NOT NULL").select("__row", *[F.when(F.col("__col") == k, F.col("__rk")).alias(f"__rk_{k}") for k in range(n_cols)])
        ranked = ranked.unionByName(found).groupBy("__row").agg(*[F.max(f"__rk_{k}").alias(f"__rk_{k}") for k in range(n_cols)])
    # average ranks of n rows have the mean (n + 1) / 2, so the correlations are sums of products
    away = [F.col(f"__rk_{k}") - F.lit((n + 1) / 2) for k in range(n_cols)]
    pairs = [(i, j) for i in range(n_cols) for j in range(i, n_cols)]
    row = ranked.agg(*[F.sum(away[i] * away[j]).alias(f"{i}|{j}") for i, j in pairs]).first()

    def rho(i, j):
        size = math.sqrt((row[f"{i}|{i}"] or 0.0) * (row[f"{j}|{j}"] or 0.0))
        return float(round(row[f"{i}|{j}"] / size, 9)) if size else None

    rows = [(columns[i], columns[j], rho(i, j)) for i, j in pairs]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, rho double")
