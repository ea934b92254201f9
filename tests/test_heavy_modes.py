"""Modes of very many values against plain counting."""
from collections import Counter, defaultdict

import pytest

from surveykit.operators import heavy_modes
from surveykit.operators.describe import group_mode, mode


def rows():
    out = [("a", f"k{i * 7919 % 3000}") for i in range(4000)]     # many values, hardly a mode
    out += [("b", "hot")] * 1500 + [("b", f"k{i}") for i in range(900)]
    out += [("c", f"k{i}") for i in range(40)]                     # all equal
    out += [("d", "y"), ("d", "x"), ("d", "x"), ("d", "y"), ("e", None), (None, "k1"), (None, None), ("f", "")]
    return out


def brute(pairs):
    counts = defaultdict(Counter)
    for g, v in pairs:
        if g is not None and v is not None:
            counts[g][v] += 1
    return {(g, *min(((-n, v) for v, n in c.items()))[::-1]) for g, c in counts.items()}


@pytest.mark.parametrize("buckets, most", [(1, 200_000), (7, 200_000), (4096, 200_000), (64, 0)])
def test_equals_counting(spark, monkeypatch, buckets, most):
    monkeypatch.setattr(heavy_modes, "BROADCAST_BUCKETS", most)
    df = spark.createDataFrame(rows(), "_g0 string, v string")
    got = heavy_modes.heavy_mode(df, "v", "_g0", buckets=buckets)
    assert got.columns == ["_g0", "v", "n"]
    found = got.collect()
    assert {(r[0], -r[2], r[1]) for r in found} == {(g, n, v) for g, v, n in brute(rows())}
    assert sorted(map(tuple, found)) == sorted(map(tuple, group_mode(df, "_g0", "v").collect()))
    assert heavy_modes.heavy_mode(df, "v", buckets=buckets).collect() == mode(df, "v").collect()


def test_empty_and_null(spark):
    df = spark.createDataFrame([("a", None)], "g string, v int")
    assert heavy_modes.heavy_mode(df, "v", "g").collect() == []
    assert [tuple(r) for r in heavy_modes.heavy_mode(df, "v").collect()] == [tuple(r) for r in mode(df, "v").collect()]
