"""Dyadic range join, positional alignment, co-partitioned tables, ranks in place."""

import datetime as dt
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from coverlake.operators import bins as B
from coverlake.operators import joins as J
from coverlake.operators import quantiles as QT
from coverlake.operators import quotes as Q
from coverlake.operators import stats as S
from coverlake.sources import io
from coverlake.queries import binning, io_queries
from coverlake.queries.io_queries import q_spot_lookup_bucketed

from tests.conftest import SF_SMALL

DAY0 = dt.date(1969, 11, 20)


def day(k):
    return None if k is None else DAY0 + dt.timedelta(days=k)


@pytest.mark.parametrize("closed", [False, True])
def test_dyadic_join_equals_brute_force(spark, closed):
    rng = random.Random(4)
    pts = [(rng.choice("abc"), rng.choice([None] + list(range(0, 900, 7)))) for _ in range(200)]
    ivs = [(rng.choice("abd"), rng.choice([None, *range(900)]), rng.choice([None, *range(0, 30_000, 41)]), k) for k in range(120)]
    ivs += [("a", 5, 5, 900), ("a", 8, 3, 901), ("b", 0, 700, 902), ("b", 0, 700, 903)]
    p = spark.createDataFrame([(k, day(x)) for k, x in pts], "key string, at date")
    i = spark.createDataFrame([(k, day(a), day(b), n) for k, a, b, n in ivs], "key string, lo date, hi date, n int")
    got = sorted((r["key"], (r["at"] - DAY0).days, r["n"]) for r in J.dyadic_range_join(p, i, "at", "lo", "hi", keys=("key",), closed_end=closed).collect())
    want = sorted((k, x, n) for k, x in pts for q, a, b, n in ivs
                  if k == q and None not in (x, a, b) and a <= x and (x <= b if closed else x < b))
    assert got == want


def test_dyadic_join_on_timestamps(spark):
    rng = random.Random(1)
    at = [dt.datetime(2020, 1, 1) + dt.timedelta(microseconds=rng.randrange(10 ** 12)) for _ in range(150)]
    lo = [dt.datetime(2020, 1, 1) + dt.timedelta(microseconds=rng.randrange(10 ** 12)) for _ in range(60)]
    hi = [x + dt.timedelta(microseconds=rng.choice([0, 1, 999, 10 ** 9, 10 ** 11])) for x in lo]
    p = spark.createDataFrame([(x,) for x in at + lo + hi], "at timestamp")
    i = spark.createDataFrame(list(zip(lo, hi)), "lo timestamp, hi timestamp")
    got = sorted(tuple(r) for r in J.dyadic_range_join(p, i, "at", "lo", "hi").collect())
    assert got == sorted((x, a, b) for x in at + lo + hi for a, b in zip(lo, hi) if a <= x < b)


def test_one_key_of_many_intervals_and_dates(spark):
    """1e5 intervals and 1e5 dates of one key (1e10 pairs by key alone)."""
    n = 100_000
    start = F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int"))
    ivs = spark.range(n).select(F.lit(1).alias("key"), start.alias("lo"), F.date_add(start, 1).alias("hi"), F.col("id").alias("n"))
    pts = spark.range(n).select(F.lit(1).alias("key"), start.alias("at"), F.col("id").alias("m"))
    row = J.dyadic_range_join(pts, ivs, "at", "lo", "hi", keys=("key",)).agg(F.count("*").alias("n"), F.sum((F.col("n") == F.col("m")).cast("int")).alias("same")).first()
    assert (row["n"], row["same"]) == (n, n)


def test_dyadic_join_sends_no_blocks_through_the_driver(spark):
    """Spark takes the exploded blocks for as small as the intervals; a broadcast of them fills the driver."""
    pts = spark.range(50).select(F.lit(1).alias("key"), F.date_add(F.lit(DAY0), F.col("id").cast("int")).alias("at"))
    ivs = spark.range(20).select(F.lit(1).alias("key"), F.lit(DAY0).alias("lo"), F.date_add(F.lit(DAY0), F.col("id").cast("int")).alias("hi"))
    joined = J.dyadic_range_join(pts, ivs, "at", "lo", "hi", keys=("key",))
    assert joined.count() == sum(range(20))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_blocks_cover_each_instant_once(spark):
    rows = [(a, b) for a in (-70, -8, -1, 0, 1, 7, 8, 9, 63, 64, 511) for b in (-70, -64, 0, 1, 8, 64, 65, 512, 4096, 40_000)]
    df = spark.createDataFrame(rows, "a bigint, b bigint").withColumn("x", F.explode(J.interval_blocks(F.col("a"), F.col("b"), 3, 6)))
    got = {}
    for r in df.select("a", "b", "x.level", "x.block").collect():
        got.setdefault((r["a"], r["b"]), []).append((r["level"], r["block"]))
    for a, b in rows:
        days = [d for level, block in got.get((a, b), []) for d in range(block * 8 ** level, (block + 1) * 8 ** level)]
        assert sorted(days) == list(range(a, b)) and len(got.get((a, b), [])) <= 14 * 5 + 8


def test_zip_by_position(spark):
    one, two, three = (io.scratch_path(spark, "t-zip") for _ in range(3))
    spark.range(0, 1000, 1, 3).select("id").write.parquet(one)
    spark.range(0, 1000, 1, 7).select((F.col("id") * 10).alias("ten")).write.parquet(two)
    spark.range(0, 999, 1, 2).select(F.col("id").alias("short")).write.parquet(three)
    rows = io.zip_by_position(spark.read.parquet(one), spark.read.parquet(two)).collect()
    assert sorted((r["id"], r["ten"]) for r in rows) == [(k, 10 * k) for k in range(1000)]
    with pytest.raises(ValueError):
        io.zip_by_position(spark.read.parquet(one), spark.read.parquet(three))


def test_positions_do_not_depend_on_splits(spark):
    path = io.scratch_path(spark, "t-pos")
    spark.range(0, 5000, 1, 4).write.option("parquet.block.size", 2000).parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = io.with_position(spark.read.parquet(path)).collect()
            assert all(r["id"] == r["position"] for r in rows) and len(rows) == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_positional_sets_get_more_files_with_more_rows(spark, monkeypatch):
    sides = []
    monkeypatch.setattr(io_queries, "ROWS_PER_FILE", 100, raising=False)
    monkeypatch.setattr(io_queries.io, "zip_by_position", lambda *both: sides.extend(both))
    io_queries.q_positional_concat(spark, SF_SMALL)
    rows = [[r["n"] for r in side.groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n")).collect()] for side in sides]
    assert len(rows[0]) != len(rows[1]) and sum(rows[0]) == sum(rows[1])
    assert max(rows[0] + rows[1]) <= 400


def test_bucketed_tables_join_without_a_shuffle(spark):
    plan = plan_of(q_spot_lookup_bucketed(spark, SF_SMALL))
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    q, p = (spark.createDataFrame([(1, day(3), 2.0)], "secid int, date date, close double") for _ in range(2))
    assert "Exchange" in plan_of(Q.attach_spot(q.drop("close").hint("merge"), p))


@pytest.mark.parametrize("heavy", [1, 4, 1000])
def test_spearman_of_frequent_and_rare_values(spark, monkeypatch, heavy):
    monkeypatch.setattr(S, "HEAVY", heavy)
    rng = np.random.default_rng(heavy)
    n = 3000
    a = np.where(rng.random(n) < 0.4, 0.0, np.round(rng.normal(size=n), 3))
    pdf = pd.DataFrame({"a": a, "b": a + rng.normal(size=n), "flag": rng.random(n) < 0.3, "five": rng.integers(0, 5, n).astype(float), "c": -0.0})
    pdf.loc[::97, "b"] = np.nan
    df = spark.createDataFrame(pdf).repartition(6)
    cols = ["a", "b", "flag", "five"]
    ours = {(r.col_a, r.col_b): r.rho for r in S.spearman_long(df, cols).collect()}
    want = pdf.dropna()[cols].astype(float).corr(method="spearman")
    for (x, y), rho in ours.items():
        assert rho == pytest.approx(want.loc[x, y], abs=1e-9)


def test_average_ranks_across_partitions_and_batches(spark):
    rng = random.Random(3)
    cells = [(rng.choice([0, 1, 3]), float(rng.randrange(40)), rng.choice([1, 1, 5]), k) for k in range(900)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        got = {r["__row"]: r["__rk"] for r in S.average_ranks(spark.createDataFrame(cells, "__col int, __v double, __w bigint, __row bigint")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for col, v, _, k in cells:
        below = sum(w for c, x, w, _ in cells if c == col and x < v)
        ties = sum(w for c, x, w, _ in cells if c == col and x == v)
        assert got[k] == below + (ties + 1) / 2


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_asof_merge_equals_brute_force(spark, strict, how):
    rng = random.Random(7)
    moment = lambda: rng.choice([None] + [dt.datetime(2020, 1, 1, 9, 0, rng.randrange(60), rng.randrange(3))] * 12)
    pts = [(rng.choice(["a", "b", "c", None]), moment(), k) for k in range(400)]
    evs = [(rng.choice(["a", "b", None]), moment(), rng.randrange(50)) for _ in range(60)]
    p = spark.createDataFrame(pts, "key string, at timestamp, id int").repartition(5)
    e = spark.createDataFrame(evs, "key string, seen timestamp, x int").repartition(3)
    got = sorted((r["id"], r["key"], r["at"], r["seen"], r["x"]) for r in J.asof_merge(p, e, "at", "seen", keys=("key",), strict=strict, how=how).collect())
    want = []
    for key, at, k in pts:
        able = [(t, x) for q, t, x in evs if None not in (key, at, t) and q == key and (t < at if strict else t <= at)]
        if able or how == "left":
            want.append((k, key, at, *(max(able) if able else (None, None))))
    assert got == sorted(want)


def test_asof_event_partitions_away(spark):
    """One event, then many points in all later partitions; two keys; dates; no key at all."""
    p = spark.range(5000).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("at"), (F.col("id") % 2).alias("key"))
    e = spark.createDataFrame([(dt.date(2000, 1, 1), 0, "first"), (dt.date(2010, 1, 1), 1, "second")], "seen date, key long, name string")
    got = {(r["key"], r["name"]): r["n"] for r in J.asof_merge(p, e, "at", "seen", keys=("key",)).groupBy("key", "name").agg(F.count("*").alias("n")).collect()}
    after = sum(1 for k in range(5000) if k % 2 and dt.date(2000, 1, 1) + dt.timedelta(days=k) >= dt.date(2010, 1, 1))
    assert got == {(0, "first"): 2500, (1, None): 2500 - after, (1, "second"): after}
    assert J.asof_merge(p, e.drop("key"), "at", "seen").filter("name is null").count() == 0
    assert J.asof_merge(p, e.limit(0), "at", "seen", keys=("key",)).filter("name is null").count() == 5000
    assert J.asof_merge(p.limit(0), e, "at", "seen", keys=("key",)).count() == 0


def test_asof_clashing_columns_are_refused(spark):
    p = spark.createDataFrame([(1, 1.0)], "at long, x double")
    with pytest.raises(ValueError):
        J.asof_merge(p, p.withColumnRenamed("at", "seen"), "at", "seen")


def test_decile_scans_are_compiled_by_the_jvm(spark, monkeypatch):
    """The JVM interprets methods of more than 8,000 bytes, at several times the time."""
    sizes, cut = [], QT.cut_lineage
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")

    def noted(df):
        text = df._jdf.queryExecution().explainString(mode)
        sizes.extend(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text))
        return cut(df)

    monkeypatch.setattr(QT, "cut_lineage", noted)
    spark.conf.set("spark.sql.adaptive.enabled", "false")       # otherwise nothing is generated before the run
    try:
        assert binning.q_width_by_feature_decile(spark, SF_SMALL).count() > 30
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) <= 6000


def test_bins_of_groups_equal_bins_by_comparison(spark):
    inf, nan = float("inf"), float("nan")
    edges = {"a": [0.0, 1.0, 1.5, 4.0], "b": [-inf, 2.0, inf], "c": [3.0], "d": [0.0, 2.0, nan]}
    values = [None, nan, -inf, inf, -1.0, -0.0, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0]
    df = spark.createDataFrame([(g, x) for g in [*edges, "e", None] for x in values + values[3:9]], "g string, x double")
    want = F.lit(None).cast("int")
    for g, e in edges.items():
        want = F.when(F.col("g") == g, B.right_closed_bin("x", e)).otherwise(want)
    want = sorted(map(repr, df.withColumn("bin", want).filter("bin IS NOT NULL").collect()))
    assert sorted(map(repr, B.with_right_closed_bin(df, "x", edges, "g").collect())) == want and len(want) > 40
    assert B.with_right_closed_bin(df, "x", {}, "g").count() == 0


def test_kth_smallest_scans_its_input_twice(spark, monkeypatch):
    """Once for the histogram, once for the rows of the buckets, even if a bucket is divided further."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(2000).select((F.col("id") % 2).alias("g"), (1 + F.col("id") / 100000).alias("v")).mapInArrow(count, "g bigint, v double")
    targets = spark.createDataFrame([(g, k, k) for g in (0, 1) for k in (1, 500, 1000)], "g bigint, __tid bigint, __k bigint")
    rows = QT.kth_smallest(df, "v", targets, ["g"], final_rows=500).collect()      # the lower bucket is divided, the upper one not
    assert {(r["g"], r["__tid"]): r["__value"] for r in rows} == {(g, k): 1 + (2 * (k - 1) + g) / 100000 for g in (0, 1) for k in (1, 500, 1000)}
    assert seen.value == 2 * 2000
