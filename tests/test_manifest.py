"""The loader's manifest and Bloom filters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from coverlake.sources import io
from coverlake.streaming import incremental as L

SCHEMA = "k int, date date, v double"
DAYS = [dt.date(2000, 1, 3) + dt.timedelta(days=d) for d in range(4)]


def rows(spark, ks, day):
    return spark.createDataFrame([(k, DAYS[day], float(k)) for k in ks], SCHEMA)


def writer(target, bits=16, run="r"):
    return L._write_batch(target, run, lambda df: df, ["k", "date"], 1, bits)


def keys_of(df):
    return sorted((r["k"], DAYS.index(r["date"])) for r in df.collect())


def test_versions(spark):
    target = io.scratch_path(spark, "t-manifest")
    assert L.read_table(spark, target) is None and L.manifest(spark, target)["version"] == 0
    write = writer(target)
    write(rows(spark, range(5), 0), 0)
    first = L.manifest(spark, target)
    write(rows(spark, range(3, 8), 0).union(rows(spark, [1], 1)), 1)
    second = L.manifest(spark, target)
    assert (first["version"], second["version"]) == (1, 2)
    assert keys_of(L.read_table(spark, target, first)) == [(k, 0) for k in range(5)]        # an older version stays readable
    assert keys_of(L.read_table(spark, target)) == sorted([(k, 0) for k in range(8)] + [(1, 1)])
    assert second["drops"]["r-1"] == {"rows": 4, "first": str(DAYS[0]), "last": str(DAYS[1])}
    assert keys_of(L.read_table(spark, target, days=[DAYS[1]])) == [(1, 1)]


def test_files_that_no_version_lists_are_not_read(spark):
    target = io.scratch_path(spark, "t-manifest")
    writer(target)(rows(spark, range(5), 0), 0)
    rows(spark, range(100, 200), 0).write.parquet(f"{target}/data/r-1")           # a batch that died before its commit
    assert L.read_table(spark, target).count() == 5
    writer(target)(rows(spark, range(50, 53), 0), 1)                               # and is run again
    assert keys_of(L.read_table(spark, target)) == [(k, 0) for k in [*range(5), 50, 51, 52]]


def test_a_batch_that_is_run_again_counts_once(spark):
    target = io.scratch_path(spark, "t-manifest")
    for _ in range(2):
        writer(target)(rows(spark, range(5), 0), 0)
    writer(target, run="other")(rows(spark, range(5), 0), 0)                       # all rows held: an empty drop
    v = L.manifest(spark, target)
    assert v["version"] == 3 and v["drops"]["other-0"]["rows"] == 0
    assert keys_of(L.read_table(spark, target)) == [(k, 0) for k in range(5)]


def test_a_version_number_is_taken_once(spark):
    target = io.scratch_path(spark, "t-manifest")
    version = {"version": 1, "schema": None, "drops": {}}
    L._commit(spark, target, version)
    with pytest.raises(Exception):
        L._commit(spark, target, version)


def test_new_keys_reread_nothing(spark, monkeypatch):
    target = io.scratch_path(spark, "t-manifest")
    writer(target, bits=20)(rows(spark, range(200), 0), 0)
    read, real = [], L.read_table
    monkeypatch.setattr(L, "read_table", lambda *a, **k: read.append(a[3] if len(a) > 3 else None) or real(*a, **k))
    writer(target, bits=20)(rows(spark, range(200, 300), 0), 1)
    assert not read
    writer(target, bits=20)(rows(spark, [0, 301], 0).union(rows(spark, [0], 2)), 2)
    assert read == [[DAYS[0]]]
    assert keys_of(real(spark, target)) == sorted([(k, 0) for k in [*range(300), 301]] + [(0, 2)])


@pytest.mark.parametrize("bits", [4, 16])
def test_filters_never_miss(spark, bits):
    """Also when nearly all bits are set."""
    held, fresh = rows(spark, range(0, 400, 2), 0), rows(spark, range(400), 0)
    found = {r["k"] for r in L.maybe_held(fresh, ["k"], L.bloom_filter(held, ["k"], bits), bits).collect()}
    assert found >= set(range(0, 400, 2))
    assert bits == 4 or len(found) < 260


def test_full_filters_lose_nothing(spark):
    target = io.scratch_path(spark, "t-manifest")
    for batch, ks in enumerate([range(300), range(100, 400), range(500)]):
        writer(target, bits=4)(rows(spark, ks, 0), batch)
    assert keys_of(L.read_table(spark, target)) == [(k, 0) for k in range(500)]


def test_missing_keys_and_repeated_rows(spark):
    target = io.scratch_path(spark, "t-manifest")
    some = spark.createDataFrame([(None, DAYS[0], 1.0), (None, DAYS[0], 1.0), (1, DAYS[0], 2.0)], SCHEMA)
    for batch in range(2):
        writer(target)(some, batch)
    out = L.read_table(spark, target)
    assert out.count() == 2 and out.filter(F.col("k").isNull()).count() == 1
