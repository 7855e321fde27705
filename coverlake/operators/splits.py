"""Splits, folds and row labels.

Random splits are hash splits: a row's uniform draw is md5(seed ':' key), so
the assignment does not depend on partitioning, ordering or retries (unlike
``randomSplit``), and the same split is reproducible in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coverlake.functions.hashing import hash_uniform
from coverlake.session import cut_lineage, shuffle_partitions


def role_from_uniform(u, proper: float = 0.6, calib: float = 0.8):
    """60/20/20: proper_train / calibration / validation (train = first two)."""
    return (F.when(u < proper, "proper_train").when(u < calib, "calibration").otherwise("validation"))


def hash_split(df: DataFrame, key_cols, seed: int = 42, proper: float = 0.6, calib: float = 0.8,
               role_col: str = "role") -> DataFrame:
    """Seeded 80/20 then 75/25 split as one uniform draw per row."""
    u = hash_uniform(seed, *key_cols)
    return df.withColumn("__u", u).withColumn(role_col, role_from_uniform(F.col("__u"), proper, calib)).drop("__u")


def exact_split(df: DataFrame, key_cols, seed: int = 42, by=(), test_size: str = "0.2",
                calib_size: str = "0.25", role_col: str = "role") -> DataFrame:
    """X1, exact sizes: per group of ``by``, rows ordered by their hash draw
    (ties by key) get the first n - ceil(test n) - ceil(calib (n - ceil(test n)))
    positions as proper_train, then calibration, then validation -- the sizes
    of an 80/20 then 75/25 split, order-free and repeatable.

    Positions come from one distributed row numbering of (by, draw, key)
    minus each group's first position (a per-group min/count table), so no
    group is ever sorted inside one task."""
    from decimal import Decimal
    by = list(by)
    keyed = df.withColumn("__u", hash_uniform(seed, *key_cols))
    numbered = global_row_number(keyed, by + ["__u"] + list(key_cols), col="__rn")
    sizes = numbered.groupBy(*by).agg(F.min("__rn").alias("__first"), F.count(F.lit(1)).alias("__n"))
    n = F.col("__n")
    n_val = F.ceil(F.lit(Decimal(test_size)) * n)
    n_cal = F.ceil(F.lit(Decimal(calib_size)) * (n - n_val))
    sizes = sizes.withColumns({"__n_proper": n - n_val - n_cal, "__n_train": n - n_val})
    if by:
        j = numbered.join(sizes, by, "inner")     # one row per group
    else:
        row = sizes.first()
        j = numbered.withColumns({c: F.lit(row[c]) for c in ("__first", "__n", "__n_proper", "__n_train")})
    pos = F.col("__rn") - F.col("__first")
    role = (F.when(pos < F.col("__n_proper"), "proper_train")
             .when(pos < F.col("__n_train"), "calibration").otherwise("validation"))
    return j.withColumn(role_col, role).drop("__u", "__rn", "__first", "__n", "__n_proper", "__n_train")


def group_split(df: DataFrame, group_cols, seed: int = 42, proper: float = 0.6, calib: float = 0.8,
                role_col: str = "role") -> DataFrame:
    """Hash the group key instead of the row key, so every row of a group
    lands on the same side."""
    return hash_split(df, group_cols, seed, proper, calib, role_col)


def walk_forward_folds(spark: SparkSession, first_test: int = 2000, last_test: int = 2022,
                       train_years: int = 3) -> DataFrame:
    """X3 fold table: test year y, calibration y-1, training y-1-train_years .. y-2.
    (last_test - first_test + 1) x (train_years + 2) rows."""
    years = spark.range(first_test, last_test + 1).select(F.col("id").cast("int").alias("test_year"))
    offs = [(0, "test"), (1, "calibration")] + [(k, "train") for k in range(2, 2 + train_years)]
    roles = F.explode(F.array(*[F.struct(F.lit(o).alias("off"), F.lit(r).alias("role")) for o, r in offs]))
    return (years.select("test_year", roles.alias("x"))
                 .select("test_year", (F.col("test_year") - F.col("x.off")).cast("int").alias("year"),
                         F.col("x.role").alias("role")))


def assign_folds(df: DataFrame, folds: DataFrame, year_col: str = "year") -> DataFrame:
    """Rows x fold roles by an equi-join on year with the (tiny) fold table."""
    return df.join(F.broadcast(folds), year_col, "inner")


def seed_draws(df: DataFrame, key_cols, n_seeds: int, first_seed: int = 0) -> DataFrame:
    """One row per (row, seed) with that seed's role; the replication
    factor is the caller's seed count (a parameter, not data-dependent).

    One md5 digest holds four independent 32-bit uniforms, so seeds share a
    digest in blocks of four: seed s uses hex digits 8*(s % 4) .. +7 of
    md5((s // 4) ':' key) -- a quarter of the hashing of one digest per seed."""
    seeds = list(range(first_seed, first_seed + n_seeds))
    blocks = sorted({s // 4 for s in seeds})
    # the row key string is built once per row, not once per (row, seed)
    keyed = df.withColumn("__key", F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols]))
    per_block = keyed.select("*", F.explode(F.array(*[F.lit(b) for b in blocks])).alias("__block"))
    per_block = per_block.withColumn(
        "__h", F.md5(F.concat(F.col("__block").cast("string"), F.lit(":"), F.col("__key"))))
    per_seed = per_block.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("__part"))
    per_seed = per_seed.withColumn("seed", F.col("__block") * 4 + F.col("__part"))
    per_seed = per_seed.filter(F.col("seed").between(seeds[0], seeds[-1]))
    u = F.conv(F.substring(F.col("__h"), F.col("__part") * 8 + 1, 8), 16, 10).cast("bigint") / 4294967296.0
    return per_seed.withColumn("role", role_from_uniform(u)).drop("__key", "__block", "__h", "__part")


def global_row_number(df: DataFrame, order_cols, num_partitions: int | None = None,
                      col: str = "row_no") -> DataFrame:
    """0-based row number in ``order_cols`` order without a global
    single-partition window: range-partition and sort, number the rows of
    each partition as they stand (``monotonically_increasing_id``: partition
    in the high bits, place in the low 33), and add each partition's offset
    (prefix sum of a P-row table).  The sorted data is checkpointed with its
    ids, so the rows are shuffled once."""
    parts = num_partitions or shuffle_partitions(df.sparkSession)
    ranged = (df.repartitionByRange(parts, *order_cols).sortWithinPartitions(*order_cols)
                .withColumn("__id", F.monotonically_increasing_id()))
    place = F.lit((1 << 33) - 1)
    ranged = cut_lineage(ranged).withColumns({"__pid": F.call_function("shiftright", F.col("__id"), F.lit(33)),
                                              "__at": F.col("__id").bitwiseAND(place)})
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.orderBy("__pid")                       # P rows only
    offsets = counts.select("__pid", (F.sum("__cnt").over(w) - F.col("__cnt")).alias("__off"))
    return (ranged.join(F.broadcast(offsets), "__pid").withColumn(col, F.col("__off") + F.col("__at"))
                  .drop("__id", "__pid", "__at", "__off"))


def block_labels(df: DataFrame, sizes, row_col: str = "row_no", label: str = "sample_id") -> DataFrame:
    """Rows [sum(sizes[:i]), sum(sizes[:i+1])) get label i; later rows
    get NULL.  The size list is a short parameter, inlined as a CASE."""
    bounds, acc = [], 0
    for s in sizes:
        acc += s
        bounds.append(acc)
    expr = None
    for i, b in enumerate(bounds):
        cond = F.col(row_col) < b
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return df.withColumn(label, expr.cast("int"))


def first_rows(df: DataFrame, order_cols, n: int) -> DataFrame:
    """The first n rows by a unique order key (top-n: a limit is the feature)."""
    return df.orderBy(*order_cols).limit(n)
