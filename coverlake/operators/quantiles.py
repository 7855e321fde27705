"""Exact order statistics and quantiles per group, safe for huge groups.

Spark's exact ``percentile`` keeps a value->count map of the whole group in
one task.  Here a first scan makes a *log-linear histogram* per group
(``value_histogram``: buckets of 1/64 octave at fixed places, with count, least and
largest value).  It merges by adding counts, has a bounded number of rows per group,
and brackets every rank exactly, however wide the values range.  A second scan
takes the rows of the buckets that hold a requested rank, and ``kth_smallest``
resolves the rank with a window over that slice.  Only a slice of more than
``final_rows`` rows is divided further, by ``NUM_BUCKETS`` buckets over its own
range per scan, until it is small or a single value; each pass leaves a smaller
range, since both ends of a range are values of it, so there is no cap on the passes.

``exact_quantiles`` uses this search; ``method="percentile"`` is for callers
who know that every group is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlake.session import cut_lineage

NUM_BUCKETS = 4096
PER_OCTAVE = 64
BROADCAST_ROWS = 200_000
"""Value ranges (a few longs each) that are sent to every task; more are joined."""


def _scale(v: Column) -> Column:
    """A monotone logarithmic scale of all doubles: -2100 .. 2100, 0 at 0."""
    size = F.least(F.log2(F.abs(v)) + 1076.0, F.lit(2101.0))
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0.0))


def _bucket(v: Column, lo: Column, hi: Column) -> Column:
    """Bucket of ``v`` in [lo, hi], 0 for lo and NUM_BUCKETS - 1 for hi."""
    wide = _scale(hi) - _scale(lo) > 1.0
    # halves first: hi - lo can overflow to inf for values spanning the double range
    share = F.when(wide, F.try_divide(_scale(v) - _scale(lo), _scale(hi) - _scale(lo))).otherwise(
        F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2))
    inner = F.floor(F.coalesce(share, F.lit(0.0)) * NUM_BUCKETS).cast("int")
    return (F.when(v <= lo, F.lit(0)).when(v >= hi, F.lit(NUM_BUCKETS - 1))
             .otherwise(F.greatest(F.lit(0), F.least(F.lit(NUM_BUCKETS - 1), inner))))


def _clean(df: DataFrame, value: str, by) -> DataFrame:
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return df.select(*by, v.alias("__v"))


def _attach_range(data: DataFrame, ranges: DataFrame, by) -> DataFrame:
    """Rows within the (disjoint) value ranges of their group (no NULLs), with
    the range's ends.  Grouped: an equi-join on the group key with the range as
    a residual.  Ungrouped: the few ranges are inlined as a CASE expression."""
    v = F.col("__v")
    if by:
        r = ranges.select(*[F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)], "__lo", "__hi")
        if ranges.count() <= BROADCAST_ROWS:
            r = F.broadcast(r)
        # coalesce: otherwise Catalyst infers "v is not NULL" and repeats v's whole expression in a filter on the scan
        same = F.coalesce(v.between(F.col("__lo"), F.col("__hi")), F.lit(False))
        for i, c in enumerate(by):
            same = same & (F.col(c) == F.col(f"__by_{i}"))
        return data.join(r, same, "inner").drop(*[f"__by_{i}" for i in range(len(by))])
    rows = ranges.select("__lo", "__hi").collect()   # <= number of targets
    if not rows:
        return data.limit(0).withColumns({"__lo": F.lit(None).cast("double"), "__hi": F.lit(None).cast("double")})
    lo = hi = None
    for r in rows:
        cond = v.between(F.lit(r["__lo"]), F.lit(r["__hi"]))
        lo = (F.when(cond, F.lit(r["__lo"])) if lo is None else lo.when(cond, F.lit(r["__lo"])))
        hi = (F.when(cond, F.lit(r["__hi"])) if hi is None else hi.when(cond, F.lit(r["__hi"])))
    return data.withColumns({"__lo": lo, "__hi": hi}).filter(F.col("__lo").isNotNull())


def value_histogram(df: DataFrame, value: str, by=(), **extra: Column) -> DataFrame:
    """Per group and bucket (``__b``): count, least and largest value (``__c``,
    ``__blo``, ``__bhi``), and ``extra`` aggregates (of ``__v``, or of the columns
    of ``df``).  Missing values have a bucket of their own, NULL.  Checkpointed: at
    most a few thousand rows per group."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    data = df.withColumn("__v", v).withColumn("__b", F.when(F.col("__v").isNotNull(), F.floor(_scale(F.col("__v")) * PER_OCTAVE).cast("int")))
    return cut_lineage(data.groupBy(*by, "__b").agg(
        F.count("__v").alias("__c"), F.min("__v").alias("__blo"), F.max("__v").alias("__bhi"),
        *[c.alias(name) for name, c in extra.items()]))


def group_stats(hist: DataFrame, by=()) -> DataFrame:
    """Per group: min (``__lo``), max (``__hi``) and count (``__n``) of the
    non-NULL values, from a ``value_histogram``."""
    known = hist.filter(F.col("__b").isNotNull())
    return known.groupBy(*by).agg(F.min("__blo").alias("__lo"), F.max("__bhi").alias("__hi"), F.sum("__c").alias("__n"))


def _within(targets: DataFrame, hist: DataFrame, by) -> DataFrame:
    """Each target's bucket: its value range, its rows, the rank in it."""
    key = list(by) or ["__all"]
    if not by:
        targets, hist = targets.withColumn("__all", F.lit(0)), hist.withColumn("__all", F.lit(0))
    w = Window.partitionBy(*key).orderBy("__b")           # a bounded number of buckets
    hist = hist.filter(F.col("__b").isNotNull()).withColumn("__cum", F.sum("__c").over(w))
    found = targets.join(hist, key).filter((F.col("__cum") - F.col("__c") < F.col("__k")) & (F.col("__cum") >= F.col("__k")))
    return found.select(*by, "__tid", (F.col("__k") - (F.col("__cum") - F.col("__c"))).alias("__k"),
                        F.col("__blo").alias("__lo"), F.col("__bhi").alias("__hi"), F.col("__c").alias("__n"))


def kth_smallest(df: DataFrame, value: str, targets: DataFrame, by=(), *,
                 final_rows: int = 1_000_000, hist: DataFrame | None = None) -> DataFrame:
    """For each row of ``targets`` (columns ``by`` + ``__tid`` + ``__k``,
    1-based rank within its group) return ``by, __tid, __value``: the
    ``__k``-th smallest non-NULL ``value`` of the group (no row if k > n).
    ``hist`` = ``value_histogram(df, value, by)`` when the caller has it."""
    by = list(by)
    data = _clean(df, value, by)
    hist = value_histogram(df, value, by) if hist is None else hist
    # state: one row per target with its current value range and remaining rank
    st = cut_lineage(_within(targets.filter(F.col("__k") >= 1), hist, by))
    span = by + ["__lo", "__hi"]
    is_open = (F.col("__n") > final_rows) & (F.col("__lo") < F.col("__hi"))
    passes = 0
    while not st.filter(is_open).isEmpty():
        if passes == 0:
            data = cut_lineage(_attach_range(data, st.filter(F.col("__lo") < F.col("__hi")).select(*span).distinct(), by).select(*by, "__v"))
        passes += 1
        rows = _attach_range(data, st.filter(is_open).select(*span).distinct(), by)
        idx = _bucket(F.col("__v"), F.col("__lo"), F.col("__hi"))
        part = rows.groupBy(*span, idx.alias("__b")).agg(
            F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__blo"), F.max("__v").alias("__bhi"))
        w = Window.partitionBy(*span).orderBy("__b")      # <= NUM_BUCKETS rows per range
        part = part.withColumn("__cum", F.sum("__c").over(w))
        open_t = st.filter(is_open).select(*span, "__tid", "__k")
        picked = (open_t.join(part, span)
                        .filter((F.col("__cum") - F.col("__c") < F.col("__k")) & (F.col("__cum") >= F.col("__k")))
                        .select(*by, "__tid", (F.col("__k") - (F.col("__cum") - F.col("__c"))).alias("__k"),
                                F.col("__blo").alias("__lo"), F.col("__bhi").alias("__hi"),
                                F.col("__c").alias("__n")))
        st = cut_lineage(st.filter(~is_open).unionByName(picked))
    single = st.filter(F.col("__lo") == F.col("__hi")).select(*by, "__tid", F.col("__lo").alias("__value"))
    rest = st.filter(F.col("__lo") < F.col("__hi"))
    rows = _attach_range(data, rest.select(*span).distinct(), by)
    w = Window.partitionBy(*span).orderBy("__v")          # bounded slice (<= final_rows)
    ranked = rows.select(*span, "__v", F.row_number().over(w).alias("__k"))
    resolved = (rest.select(*span, "__tid", "__k").join(ranked, span + ["__k"], "inner")
                    .select(*by, "__tid", F.col("__v").alias("__value")))
    return single.unionByName(resolved)


def exact_quantiles(df: DataFrame, value: str, probs, by=(), *, prefix: str = "q", method: str = "search",
                    hist: DataFrame | None = None) -> DataFrame:
    """Linear-interpolated quantiles (pandas / numpy default) per group:
    one column ``{prefix}_{int(p*100)}`` per probability (the name keeps
    decimals as ``_``).  ``method``: ``"search"`` (any group size) or
    ``"percentile"`` (Spark's own aggregate, whose state is a group's distinct
    values: for groups known to be small).  ``hist`` = ``value_histogram(df,
    value, by)`` when the caller has it."""
    by = list(by)
    names = [f"{prefix}_{str(round(p * 100, 6)).rstrip('0').rstrip('.').replace('.', '_')}" for p in probs]
    if method == "percentile":
        v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
        agg = df.groupBy(*by).agg(F.percentile(v, F.array(*[F.lit(float(p)) for p in probs])).alias("__qs"))
        return agg.select(*by, *[F.col("__qs")[i].alias(n) for i, n in enumerate(names)])
    if method != "search":
        raise ValueError(f"unknown method {method!r}")
    return _quantiles_by_selection(df, value, probs, by, names, hist)


def _quantiles_by_selection(df, value, probs, by, names, hist=None):
    hist = value_histogram(df, value, by) if hist is None else hist
    stats = group_stats(hist, by)                                                   # one row per group
    h = (F.col("__n") - 1) * F.col("__p")
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("__pi"), F.lit(float(p)).alias("__p")) for i, p in enumerate(probs)]))
    plan = (stats.filter(F.col("__n") > 0).select(*by, "__n", asked.alias("__a")).select(*by, "__n", "__a.*")
                 .select(*by, "__pi", (F.floor(h) + 1).cast("long").alias("__klo"), (F.ceil(h) + 1).cast("long").alias("__khi"),
                         (h - F.floor(h)).alias("__frac")))
    ranks = (plan.select(*by, F.col("__klo").alias("__k"))
                 .unionByName(plan.select(*by, F.col("__khi").alias("__k"))).distinct()
                 .withColumn("__tid", F.col("__k")))
    vals = cut_lineage(kth_smallest(df, value, ranks, by, hist=hist))               # a row per rank
    lo = vals.select(*by, F.col("__tid").alias("__klo"), F.col("__value").alias("__vlo"))
    hi = vals.select(*by, F.col("__tid").alias("__khi"), F.col("__value").alias("__vhi"))
    q = (plan.join(lo, by + ["__klo"]).join(hi, by + ["__khi"])
             .select(*by, "__pi", (F.col("__vlo") + (F.col("__vhi") - F.col("__vlo")) * F.col("__frac")).alias("__q")))
    wide = q.groupBy(*by).pivot("__pi", list(range(len(probs)))).agg(F.first("__q"))
    return wide.select(*by, *[F.col(str(i)).alias(n) for i, n in enumerate(names)])
