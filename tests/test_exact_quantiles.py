"""Exact quantiles by sketch and refinement against numpy, however narrow the bounds must get."""
import math

import numpy as np
import pytest

from surveykit.operators.describe import exact_quantiles

PROBS = [0.0, 0.1, 0.33, 0.5, 0.66, 0.999, 1.0]


@pytest.mark.parametrize("limit", [1, 50, 100_000])
def test_equals_numpy(spark, limit):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.round(rng.normal(0, 5, 2000), 2), np.full(1500, 1.25), [1e300, -1e300, 0.0]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(5)
    probs = PROBS if limit > 1 else [0.1, 0.5]
    assert exact_quantiles(df, "x", probs, error=0.05, bracket_rows=limit) == pytest.approx(
        list(np.quantile(values, probs)), rel=1e-12)


def test_equal_rows_nan_and_empty(spark):
    same = spark.createDataFrame([(7.0,)] * 40, "x double")
    assert exact_quantiles(same, "x", PROBS, bracket_rows=1) == [7.0] * len(PROBS)
    assert exact_quantiles(same.limit(0), "x", [0.5]) == [None]
    top = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "x double")
    low, high = exact_quantiles(top, "x", [0.5, 1.0])
    assert low == 2.0 and math.isnan(high)
    two = spark.createDataFrame([(1,)] * 30 + [(2,)] * 30, "x int")
    assert exact_quantiles(two, "x", [0.0, 0.5, 1.0], bracket_rows=1) == [1.0, 1.5, 2.0]
