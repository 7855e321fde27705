"""Hand-made edge frames (FIXTURES.md section B)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from coverlake.functions.normal import norm_cdf, with_bs_values
from coverlake.operators import bins as B
from coverlake.operators import conformal as C
from coverlake.operators import curve as cv
from coverlake.operators import intervals as I
from coverlake.operators import universe as U

D = dt.date


def test_curve_null_neighbour_exact_null_single_tenor_outside(spark):
    curve = spark.createDataFrame([
        (D(2000, 1, 3), 10, 1.0), (D(2000, 1, 3), 30, None), (D(2000, 1, 3), 60, 3.0),
        (D(2000, 1, 3), 91, 4.0),
        (D(2000, 1, 4), 30, 2.0),                       # single tenor
    ], "date date, days int, rate double")
    quotes = spark.createDataFrame([
        (1, D(2000, 1, 3), 20),   # upper neighbour 30 has NULL rate -> NULL
        (2, D(2000, 1, 3), 30),   # exact tenor with NULL rate -> interpolate 10..60
        (3, D(2000, 1, 3), 70),   # between 60 and 91
        (4, D(2000, 1, 3), 5),    # below range: no extrapolation
        (5, D(2000, 1, 4), 30),   # exact on single tenor
        (6, D(2000, 1, 4), 40),   # single tenor: no neighbour above
    ], "id int, date date, days int")
    got = {r["id"]: r["rf"] for r in cv.attach_rate(quotes, curve).collect()}
    assert got[1] is None
    assert got[2] == pytest.approx(1.0 + (3.0 - 1.0) / 50 * 20)
    assert got[3] == pytest.approx(3.0 + (4.0 - 3.0) / 31 * 10)
    assert got[4] is None and got[6] is None
    assert got[5] == 2.0


def test_interval_flags_edges(spark):
    nan = float("nan")
    df = spark.createDataFrame([
        (1, 1.0, 1.0, 1.0, 1.0),     # lb = ub = y: covered, valid, ill
        (2, 1.0, 2.0, 1.5, 0.5),     # lb > ub: not covered, not valid, ill
        (3, 1.0, nan, 1.0, 2.0),     # NaN bound: every comparison false
        (4, 1.0, -2.0, 0.0, -1.0),   # ub < 0
        (5, 0.0, -1.0, 0.0, 1.0),    # y = 0: relative width +inf
        (6, 2.0, 1.0, 1.5, 3.0),     # ordinary
    ], "id int, y_true double, lb double, pp double, ub double")
    got = {r["id"]: r for r in I.add_interval_flags(df).collect()}
    assert (got[1].covered, got[1].valid, got[1].ill, got[1].pp_valid) == (True, True, True, True)
    assert (got[2].covered, got[2].valid, got[2].ill) == (False, False, True)
    assert (got[3].covered, got[3].valid, got[3].ill, got[3].pp_valid) == (False, False, False, False)
    assert got[4].covered is False and got[4].valid is True
    assert math.isinf(got[5].rel_width) and got[5].rel_width_w == 100.0
    assert got[6].covered and got[6].rel_width == pytest.approx(100.0)
    rep = I.coverage_report(I.add_interval_flags(df), []).first()
    assert rep.coverage_all == pytest.approx(3 / 6)              # crossed counted as misses
    assert rep.coverage_valid == pytest.approx(3 / 4)            # crossed excluded
    assert rep.covered_n + rep.missed_n == 6


def test_bins_edges_empty_and_constant(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 1, 2, 5, 9, 10]], "x double")
    edges = B.equal_width_edges(df, "x", 10)
    assert edges[0] < 0 and edges[-1] == 10.0
    got = [r[0] for r in df.select(B.right_closed_bin("x", edges)).collect()]
    assert got == [0, 0, 0, 1, 4, 8, 9]               # right-closed: 1.0 -> (0, 1], 10 -> last
    const = spark.createDataFrame([(3.0,)] * 4, "x double")
    ce = B.equal_width_edges(const, "x", 10)
    assert ce[0] < 3.0 < ce[-1]
    fixed = B.linspace_edges(0.0, 1.0, 5)             # [0, .25, .5, .75, 1]
    vals = spark.createDataFrame([(v,) for v in [0.0, 0.25, 0.5, 1.0, 1.5, -0.1]], "x double")
    lb = [r[0] for r in vals.select(B.left_closed_bin("x", fixed)).collect()]
    assert lb == [0, 1, 2, 3, None, None]             # left-closed, last bin closed, outside dropped
    from coverlake.operators.stats import counts_on_spine
    spine = counts_on_spine(spark, df.select(B.right_closed_bin("x", edges).alias("bin")), edges).collect()
    assert len(spine) == 10 and sum(r.n for r in spine) == 7
    assert sum(1 for r in spine if r.n == 0) == 5     # empty bins kept


def test_log_edges_pinned(spark):
    df = spark.createDataFrame([(v,) for v in [0.001, 0.01, 0.1, 1.0]], "x double")
    e = B.log_edges(df, "x", 11)
    assert e[0] == 0.001 and e[-1] == 1.0
    assert df.select(B.right_closed_bin("x", e).alias("b")).filter("b IS NULL").count() == 0
    e2 = B.log_edges(df, "x", 11, first=0.002)
    assert df.select(B.right_closed_bin("x", e2).alias("b")).filter("b IS NULL").count() == 1


def test_decile_duplicates_raise(spark):
    df = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)] * 50, "x double")
    with pytest.raises(ValueError):
        B.decile_edges(df, "x", 10)
    dropped = B.decile_edges(df, "x", 10, duplicates="drop").first().edges
    assert dropped == [1.0, 1.5, 2.0]


@pytest.mark.parametrize("n,k", [(9, 9), (19, 18), (8, 9)])
def test_conformal_k(spark, n, k):
    df = spark.createDataFrame([(float(i),) for i in range(1, n + 1)], "score double")
    r = C.conformal_constant(df, 0.1).first()
    assert r.k == k and r.n == n
    assert r.q_hat == (math.inf if k > n else float(k))


def test_touching_intervals_half_open_vs_closed(spark):
    dates = spark.createDataFrame([(D(2000, 1, 1),), (D(2000, 2, 1),)], "change_date date")
    mem = spark.createDataFrame([(1, D(1999, 1, 1), D(2000, 1, 1)), (2, D(2000, 1, 1), D(2000, 2, 1))],
                                "permno int, start date, ending date")
    links = spark.createDataFrame([(10, 1, D(1990, 1, 1), D(2030, 1, 1)), (20, 2, D(1990, 1, 1), D(2030, 1, 1))],
                                  "secid int, permno int, sdate date, edate date")
    got = {(r.change_date, r.secid) for r in U.members_at_change(dates, mem, links).collect()}
    assert got == {(D(2000, 1, 1), 20)}               # [start, ending): permno 1 ended, 2 started
    rets = spark.createDataFrame([(1, D(2000, 1, 1), 0.1), (2, D(2000, 2, 1), 0.2)], "permno int, date date, ret double")
    closed = U.members_with_returns(mem, rets).count()
    assert closed == 2                                 # closed [start, ending] keeps both edge days


def test_change_dates_and_asof(spark):
    mem = spark.createDataFrame([(1, D(2000, 1, 1), D(2000, 3, 1)), (2, D(2000, 2, 1), D(2000, 4, 1))],
                                "permno int, start date, ending date")
    cd = U.change_dates(mem)
    assert sorted(r[0] for r in cd.collect()) == [D(2000, 1, 1), D(2000, 2, 1), D(2000, 3, 1)]   # last dropped
    td = spark.createDataFrame([(D(1999, 12, 31),), (D(2000, 1, 15),), (D(2000, 3, 1),), (D(2001, 1, 1),)], "date date")
    got = {r.date: r.change_date for r in U.asof_change_date(td, cd).collect()}
    assert D(1999, 12, 31) not in got                  # before the first change date: drops out
    assert got[D(2000, 1, 15)] == D(2000, 1, 1) and got[D(2000, 3, 1)] == D(2000, 3, 1)
    assert got[D(2001, 1, 1)] == D(2000, 3, 1)


def test_year_alignment_guard(spark):
    left = spark.createDataFrame([(2000, 1), (2000, 2), (2001, 3)], "year int, v int")
    right = spark.createDataFrame([(2000,), (2000,), (2001,), (2001,)], "year int")
    assert sorted(r.v for r in I.aligned_years(left, right).collect()) == [1, 2]


def test_black_scholes_reference_values_and_parity(spark):
    df = spark.createDataFrame([(100.0, 100.0, 0.05, 0.2, 1.0)], "S double, K double, r double, sigma double, tau double")
    df = df.crossJoin(spark.createDataFrame([("C",), ("P",), ("X",)], "cp string"))
    v = {x.cp: x.v for x in with_bs_values(df, cp="cp", out="v").collect()}
    assert v["X"] is None
    r = type("R", (), {"c": v["C"], "p": v["P"]})
    assert r.c == pytest.approx(10.450584, abs=1e-6)
    assert r.p == pytest.approx(5.573526, abs=1e-6)
    assert r.c - r.p == pytest.approx(100.0 - 100.0 * math.exp(-0.05), abs=1e-9)


def test_norm_cdf_accuracy(spark):
    xs = [x / 10 for x in range(-80, 81)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for row in df.select("x", norm_cdf("x").alias("p")).collect():
        assert row.p == pytest.approx(0.5 * math.erfc(-row.x / math.sqrt(2)), abs=1e-15)


def test_year_alignment_strict_keys(spark):
    left = spark.createDataFrame([(2000, 1), (2000, 2), (2001, 3)], "year int, k int")
    right = spark.createDataFrame([(2000, 1), (2000, 9), (2001, 3)], "year int, k int")
    assert sorted(r.k for r in I.aligned_years(left, right).collect()) == [1, 2, 3]          # counts equal
    assert sorted(r.k for r in I.aligned_years(left, right, strict_keys=["k"]).collect()) == [3]


def test_spot_lookup_duplicates(spark):
    from coverlake.operators.quotes import attach_spot
    q = spark.createDataFrame([(1, D(2000, 1, 3))], "secid int, date date")
    p = spark.createDataFrame([(1, D(2000, 1, 3), 10.0), (1, D(2000, 1, 3), 11.0)], "secid int, date date, close double")
    assert attach_spot(q, p).first().spot_price == 11.0          # one row, deterministic pick
    with pytest.raises(ValueError):
        attach_spot(q, p, on_duplicate="error")


def test_clean_table_moneyness_audit(spark):
    from coverlake.queries.cleaning import q_clean_features
    from tests.conftest import SF_SMALL
    df = q_clean_features(spark, SF_SMALL)
    assert df.filter((df.S < 0.5) | (df.S > 1.5)).count() == 0
    assert df.count() > 0 and df.na.drop().count() == df.count()


def test_missing_bounds_stay_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, -1.0, 0.5, 2.0), (1.0, None, 0.5, 2.0), (1.0, 0.5, 0.7, 900.0), (nan, 0.1, 0.2, 0.3), (1.0, nan, 0.2, nan)],
                               "y_true double, lb double, pp double, ub double")
    f = I.add_interval_flags(df).collect()
    assert [r.rel_width_w for r in f] == [100.0, None, 100.0, None, None]
    r = I.coverage_report(I.add_interval_flags(df), []).first()
    assert r.neg_lb_pct == pytest.approx(20.0) and r.neg_ub_pct == 0.0
    # not ill: rows 1-5 but the crossed ones; a missing width is not below 100
    assert r.rel_width_lt100_share == pytest.approx(0.0)
    assert I.crossing_metrics().keys() == {"coverage", "crossed_pct", "point_out_pct"}


def test_share_of_rows_counts_missing_values_in_the_denominator(spark):
    df = spark.createDataFrame([(-1.0, 1.6), (None, None), (2.0, 1.0)], "lb double, S double")
    r = df.agg(I._pct(F.col("lb") < 0).alias("neg"), I.share_outside().alias("out")).first()
    assert r.neg == pytest.approx(100 / 3) and r.out == pytest.approx(100 / 3)


def test_score_needs_both_quantiles(spark):
    from coverlake.functions.losses import cqr_score
    df = spark.createDataFrame([(1.0, 0.5, 2.0), (1.0, None, 2.0), (1.0, 0.5, None), (None, 0.5, 2.0)], "y double, lo double, hi double")
    assert [r[0] for r in df.select(cqr_score("y", "lo", "hi")).collect()] == [-0.5, None, None, None]


def test_summaries_leave_nan_out(spark):
    from coverlake.operators import stats as S
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,), (4.0,)], "x double")
    r = S.numeric_summary(df, ["x"]).first()
    assert (r["count"], r["min"], r["max"], r["q50"]) == (3, 1.0, 4.0, 2.0) and r["mean"] == pytest.approx(7 / 3)
    assert tuple(S.feature_ranges(df, ["x"]).first()) == ("x", 1.0, 4.0)
    h = S.histograms(spark, df, ["x"], 3).collect()
    assert sum(b.n for b in h) == 3 and max(b.upper for b in h) == 4.0


def test_surface_of_an_empty_and_a_one_value_box(spark):
    from coverlake.operators.valuation import binned_surface
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 2.5, 4.0)], "x double, y double, z double")
    assert binned_surface(spark, df, "x", "y", "z", df.limit(0), 4).count() == 0
    cells = {(r.i, r.j): r.n for r in binned_surface(spark, df, "x", "y", "z", df, 4).collect()}
    assert len(cells) == 16 and cells[0, 0] == 1 and cells[3, 0] == 1 and sum(cells.values()) == 2


def test_checkpoint_folder_is_required_off_local(monkeypatch):
    from coverlake import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    fake = type("S", (), {"sparkContext": Context(), "conf": Conf()})()
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(fake)


def test_loader_loses_and_doubles_nothing(spark):
    import datetime as dt
    from coverlake.sources import io
    from coverlake.streaming import incremental as L
    day, other = dt.date(2000, 1, 3), dt.date(2000, 1, 4)
    schema = "k int, date date, v double"
    make = lambda ks, d: spark.createDataFrame([(k, d, float(k)) for k in ks], schema)
    landing, target, ckpt = (io.scratch_path(spark, f"t-{x}") for x in ("landing", "target", "ckpt"))
    run = {"transform": lambda df: df, "key_cols": ["k", "date"], "max_files_per_trigger": 1}
    make(range(10), day).coalesce(1).write.mode("append").parquet(landing)
    make(range(10, 20), day).coalesce(1).write.mode("append").parquet(landing)          # the same day, another file
    make(range(5), other).coalesce(1).write.mode("append").parquet(landing)
    out = L.ingest_available(spark, landing, target, ckpt, make([], day).schema, **run)
    assert out.count() == 25
    make([30], day).coalesce(1).write.mode("append").parquet(landing)                   # a late row
    make(range(10), day).coalesce(1).write.mode("append").parquet(landing)              # a replayed file
    assert L.ingest_available(spark, landing, target, ckpt, make([], day).schema, **run).count() == 26
    again = io.scratch_path(spark, "t-ckpt2")                                           # all of it, from the start
    out = L.ingest_available(spark, landing, target, again, make([], day).schema, files_per_day=3, **run)
    assert out.count() == 26 and out.select("k", "date").distinct().count() == 26


def test_order_statistics_of_log_uniform_values(spark):
    import random
    from coverlake.operators.quantiles import exact_quantiles, kth_smallest
    rng = random.Random(1)
    xs = [rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300) for _ in range(3000)] + [0.0, 5e-324, -5e-324, float("inf"), float("-inf")] + [7.0] * 200
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    ranks = [1, 2, 700, 1500, 1604, 1700, len(xs) - 1, len(xs)]
    t = spark.createDataFrame([(k, k) for k in ranks], "__tid long, __k long")
    got = {r["__tid"]: r["__value"] for r in kth_smallest(df, "x", t, final_rows=4).collect()}
    assert got == {k: sorted(xs)[k - 1] for k in ranks}
    assert exact_quantiles(df, "x", [0.5], method="percentile").first()[0] == exact_quantiles(df, "x", [0.5]).first()[0]


def test_boosting_rounds_add_no_scan(spark):
    from coverlake.operators.quantreg import QuantileGBM, leaf_lookup
    df = spark.createDataFrame([(float(k % 7), float(k % 3), 1.0, 2.0, float(k % 11)) for k in range(400)], "S double, sigma double, tau double, r double, y double")
    m = QuantileGBM(alpha=0.5, n_rounds=3, max_depth=2, min_instances=5).fit(df)
    plan = m.predict(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan") == 1
    row = spark.createDataFrame([(1.0,), (5.0,)], "leaf double").select(leaf_lookup({1.0: 2.5}, F.col("leaf")).alias("v")).collect()
    assert [r.v for r in row] == [2.5, 0.0]
