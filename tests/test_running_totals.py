"""Prefix sums over runs of the order: infinities, NaN, nulls and many cut points."""
import math

import pytest

from surveykit.operators import metrics as M


@pytest.mark.parametrize("parts", [1, 3, 200])
@pytest.mark.parametrize("descending", [False, True])
def test_every_kind_of_number(spark, parts, descending):
    keys = [float(i % 50) for i in range(400)] + [math.inf] * 5 + [-math.inf] * 5 + [math.nan] * 5
    keys = sorted(set(k for k in keys if k == k)) + [math.nan]
    rows = [(k, i + 1) for i, k in enumerate(keys)] + [(None, 1000)]
    got = M.running_totals(spark.createDataFrame(rows, "k double, v long"), "k", ["v"],
                           descending=descending, num_partitions=parts).collect()
    ordered = [rows[-1], *rows[:-1]]  # nulls first ascending, last descending; NaN is the greatest
    total, want = 0, {}
    for k, v in reversed(ordered) if descending else ordered:
        total += v
        want[str(k)] = total
    assert {str(r["k"]): r["v_cum"] for r in got} == want
