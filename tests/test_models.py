"""Boosted quantile regression, persistence and conformal coverage."""

import pytest
from pyspark.sql import functions as F

from coverlake.functions.losses import pinball
from coverlake.operators.quantreg import QuantileGBM, QuantileGBMModel
from coverlake.plans import experiments as X
from coverlake.plans.clean import clean_features
from coverlake.sources import fixtures as fx
from coverlake.sources import io
from coverlake.sources.fixtures import KEY_COLS

from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def clean(spark):
    df = clean_features(fx.quotes(spark, SF_MID), fx.prices(spark, SF_MID), fx.zero_curve(spark, SF_MID),
                        keep_keys=KEY_COLS)
    return df.cache()


def _loss(model, df, alpha):
    return model.predict(df).agg(F.avg(pinball("V", "prediction", alpha))).first()[0]


def test_pinball_loss_falls_with_rounds(clean):
    l0 = _loss(QuantileGBM(alpha=0.9, n_rounds=0, label="V").fit(clean), clean, 0.9)
    l3 = _loss(QuantileGBM(alpha=0.9, n_rounds=3, max_depth=3, label="V").fit(clean), clean, 0.9)
    assert l3 < l0


def test_model_save_load_roundtrip(spark, clean):
    m = QuantileGBM(alpha=0.5, n_rounds=2, max_depth=2, label="V").fit(clean)
    path = io.scratch_path(spark, "t-model")
    m.save(path)
    back = QuantileGBMModel.load(path)
    a = m.predict(clean).select(*KEY_COLS, "prediction")
    b = back.predict(clean).select(*KEY_COLS, "prediction")
    assert a.exceptAll(b).count() == 0


def test_cqr_coverage_on_exchangeable_split(clean):
    row = X.cqr_run(clean, KEY_COLS, "V", seed=5, n_rounds=2, max_depth=3).first()
    # nominal 0.90; hash split is exchangeable; allow sampling error on ~4k test rows
    assert row.coverage >= 0.90 - 0.03
    assert row.n_test > 1000
