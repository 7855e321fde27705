"""Range-join helpers against brute force on random intervals."""

import datetime as dt
import random

import pytest

from coverlake.operators.joins import bucketed_range_join, covered_points, day_coverage

D0 = dt.date(1999, 12, 20)


def _random_case(seed, n_iv=60, n_pts=120):
    rnd = random.Random(seed)
    ivs = []
    for _ in range(n_iv):
        k = rnd.randint(0, 4)
        s = rnd.randint(0, 200)
        length = rnd.choice([0, 1, 31, 32, 33, rnd.randint(0, 150)])   # empty, bucket-edge and long
        ivs.append((k, rnd.randint(0, 3), D0 + dt.timedelta(s), D0 + dt.timedelta(s + length)))
    pts = [(rnd.randint(0, 4), D0 + dt.timedelta(rnd.randint(-5, 260))) for _ in range(n_pts)]
    return ivs, pts


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("closed", [False, True])
def test_day_coverage_equals_brute_force(spark, seed, closed):
    ivs, pts = _random_case(seed)
    iv_df = spark.createDataFrame(ivs, "k int, v int, s date, e date")
    pt_df = spark.createDataFrame(list(set(pts)), "k int, d date")
    cov = day_coverage(iv_df, ["k", "v"], "s", "e", closed_end=closed)
    got = {(r.k, r.d, r.v) for r in covered_points(pt_df, cov, "d", join_keys=["k"]).collect()}
    want = {(k, d, v) for (k, d) in set(pts) for (k2, v, s, e) in ivs
            if k2 == k and s <= d and (d <= e if closed else d < e)}
    assert got == want


@pytest.mark.parametrize("seed", [4, 5])
def test_bucketed_range_join_equals_brute_force(spark, seed):
    ivs, pts = _random_case(seed)
    iv_df = spark.createDataFrame([(k, v, s, e) for k, v, s, e in ivs], "k int, v int, s date, e date")
    pt_df = spark.createDataFrame(pts, "k int, d date")
    got = sorted((r.k, r.d, r.v, r.s, r.e) for r in
                 bucketed_range_join(pt_df, iv_df, "d", "s", "e", keys=("k",), bucket_days=16).collect())
    want = sorted((k, d, v, s, e) for (k, d) in pts for (k2, v, s, e) in ivs if k2 == k and s <= d < e)
    assert got == want
