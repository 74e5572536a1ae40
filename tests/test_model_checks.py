"""The registered model queries fit with the operators' defaults."""

import pytest
from pyspark.sql import SparkSession

from checks import models
from fieldlens.plans import boosting, model


class Fitted(Exception):
    pass


@pytest.mark.parametrize(
    "query, losses",
    [
        ("yield_model_score", [None]), ("importance", [None]), ("score_fields", [None]),
        ("interval_model", [None, 0.1, 0.9]),
    ],
)
def test_models_are_fitted_with_the_defaults(spark: SparkSession, monkeypatch, query, losses):
    def fit(rows, quantiles, settings):
        raise Fitted(quantiles, settings)

    monkeypatch.setattr(boosting, "fit", fit)
    with pytest.raises(Fitted) as stopped:
        models.QUERIES[query][0](spark, "/root/testdata/sf0.001")
    quantiles, settings = stopped.value.args
    assert quantiles == losses
    assert {k: getattr(settings, k) for k in model.DEFAULTS} == model.DEFAULTS
