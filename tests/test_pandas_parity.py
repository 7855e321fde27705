"""The binning / summary operators against pandas and numpy themselves (the
libraries whose rules they restate), on seeded data with ties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from coverlake.operators import bins as B
from coverlake.operators import conformal as C
from coverlake.operators import stats as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({
        "x": rng.lognormal(0.0, 1.0, n),
        "t": np.round(rng.uniform(0, 5, n), 1),          # heavy ties
        "b": rng.integers(0, 2, n).astype(bool),
        "y": rng.normal(0, 1, n),
    })
    return pdf, spark.createDataFrame(pdf)


def _spark_counts(df, col_expr):
    return {r[0]: r[1] for r in df.select(col_expr.alias("bin")).groupBy("bin").count().collect() if r[0] is not None}


def test_equal_width_matches_pd_cut(data):
    pdf, df = data
    edges = B.equal_width_edges(df, "x", 10)
    ours = _spark_counts(df, B.right_closed_bin("x", edges))
    ref = pd.cut(pdf["x"], bins=10).cat.codes.value_counts().to_dict()
    assert ours == {int(k): v for k, v in ref.items()}


def test_log_bins_match_pd_cut_with_pinned_edges(data):
    pdf, df = data
    edges = B.log_edges(df, "x", 11)
    ref_edges = np.logspace(np.log10(pdf.x.min()), np.log10(pdf.x.max()), 11)
    ref_edges[0], ref_edges[-1] = pdf.x.min(), pdf.x.max()
    ref = pd.cut(pdf["x"], bins=ref_edges, include_lowest=True).cat.codes.value_counts().to_dict()
    ours = _spark_counts(df, B.right_closed_bin("x", edges))
    assert ours == {int(k): v for k, v in ref.items() if k >= 0}


@pytest.mark.parametrize("col", ["x", "t"])
def test_deciles_match_pd_qcut(data, col):
    pdf, df = data
    e = B.decile_edges(df, col, 10, duplicates="drop").first().edges
    ours = _spark_counts(df, B.right_closed_bin(col, e))
    ref = pd.qcut(pdf[col], 10, duplicates="drop").cat.codes.value_counts().to_dict()
    assert ours == {int(k): v for k, v in ref.items()}


def test_fixed_bins_match_np_histogram(data):
    pdf, df = data
    edges = B.linspace_edges(0.0, 4.0, 10)
    counts, _ = np.histogram(pdf["t"], bins=np.linspace(0.0, 4.0, 10))
    ours = _spark_counts(df, B.left_closed_bin("t", edges))
    assert [ours.get(i, 0) for i in range(9)] == counts.tolist()


def test_summary_matches_describe(data):
    pdf, df = data
    ours = {r["column"]: r for r in S.numeric_summary(df, ["x", "t"]).collect()}
    for c in ("x", "t"):
        d = pdf[c].describe()
        r = ours[c]
        assert r["count"] == d["count"]
        for ours_k, ref_k in (("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                              ("q50", "50%"), ("q75", "75%"), ("max", "max")):
            assert r[ours_k] == pytest.approx(d[ref_k], abs=1e-8)


def test_spearman_matches_pandas(data):
    pdf, df = data
    cols = ["x", "t", "b", "y"]
    ours = {(r.col_a, r.col_b): r.rho for r in S.spearman_long(df, cols).collect()}
    ref = pdf[cols].astype(float).corr(method="spearman")
    for (a, b), rho in ours.items():
        assert rho == pytest.approx(ref.loc[a, b], abs=1e-8)


def test_conformal_constant_matches_numpy(data):
    pdf, df = data
    scores = pdf["y"].to_numpy()
    n = len(scores)
    k = math.ceil(0.9 * (n + 1))
    r = C.conformal_constant(df.withColumnRenamed("y", "score"), 0.1).first()
    assert r.k == k and r.q_hat == pytest.approx(np.sort(scores)[k - 1], abs=0)
