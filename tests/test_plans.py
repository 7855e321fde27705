"""Physical-plan checks: broadcast where intended, no nested loops,
pruned scans and partition pruning."""

from pyspark.sql import functions as F

from coverlake.operators import curve as cv
from coverlake.sources import fixtures as fx
from coverlake.sources import io

from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_curve_lookup_is_one_broadcast_hash_join(spark):
    q = fx.quotes(spark, SF_SMALL).withColumn("days", F.datediff("exdate", "date"))
    df = cv.attach_rate(q, fx.zero_curve(spark, SF_SMALL))
    df.collect()
    plan = _plan(df)
    assert "BroadcastHashJoin" in plan
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_fixture_scan_reads_only_needed_columns(spark):
    df = fx.quotes(spark, SF_SMALL).select("secid", "date")
    plan = df._jdf.queryExecution().executedPlan().toString()
    schema = [ln for ln in plan.splitlines() if "ReadSchema" in ln or "struct<" in ln][0]
    assert "l_partkey" in schema and "l_shipdate" in schema
    for unused in ("l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag", "l_suppkey"):
        assert unused not in schema


def test_year_slice_prunes_partitions(spark):
    from coverlake.queries.cleaning import q_clean_features
    path = io.scratch_path(spark, "test-years")
    io.export_by_year(q_clean_features(spark, SF_SMALL), path)
    plan = _plan(io.read_year(spark, path, 1997))
    assert "PartitionFilters: [isnotnull(year" in plan and "(year#" in plan


def test_no_nested_loop_or_cartesian_joins(spark):
    """No registered query plans a nested-loop or cartesian join (range
    conditions always ride on an equi-key)."""
    from coverlake.registry import load_all
    queries, _ = load_all()
    bad = []
    for name in sorted(queries):
        plan = _plan(queries[name](spark, SF_SMALL))
        if "NestedLoop" in plan or "CartesianProduct" in plan:
            bad.append(name)
    assert bad == []
