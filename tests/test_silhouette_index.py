"""Euclidean silhouette: brute force when the index holds all rows, errors that cover it when not."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from surveykit.operators import silhouette_index as S


def brute(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = k == k[i]
        if own.sum() == 1 or len(set(k)) == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, k == c].mean() for c in set(k) - {k[i]})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.array(out)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1.0, (n, 3)) for c, n in ((0, 150), (3, 90), (7, 60))] + [np.ones((40, 3)), [[9.0, 9.0, 9.0]]])
    return x, np.array([0] * 150 + [1] * 90 + [2] * 60 + [0] * 40 + [3])


def frame(spark, x, k):
    rows = [(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, k))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, cluster int").repartition(5)


def test_whole_index_equals_brute_force(spark, blobs):
    x, k = blobs
    out = {r.id: r for r in S.silhouette_euclid(frame(spark, x, k), ["a", "b", "c"]).collect()}
    want = brute(x, k)
    assert len(out) == len(x) and all(abs(out[i].silhouette - want[i]) < 1e-9 and out[i].silhouette_error == 0 for i in range(len(x)))
    mean = S.silhouette_euclid_mean(frame(spark, x, k), ["a", "b", "c"]).first()
    assert mean.silhouette == pytest.approx(want.mean()) and mean.n == len(x)


def test_small_index_errs_within_its_bound(spark, blobs):
    x, k = blobs
    df = frame(spark, x, k)
    out = {r.id: r for r in S.silhouette_euclid(df, ["a", "b", "c"], per_cluster=40).collect()}
    want = brute(x, k)
    inside = np.mean([abs(out[i].silhouette - want[i]) <= out[i].silhouette_error + 1e-9 for i in range(len(x))])
    assert inside > 0.85 and abs(np.mean([r.silhouette for r in out.values()]) - want.mean()) < 0.1
    again = {r.id: r for r in S.silhouette_euclid(df.coalesce(1), ["a", "b", "c"], per_cluster=40).collect()}
    assert all(abs(again[i].silhouette - out[i].silhouette) < 1e-12 for i in out)
    index = S.reference_index(df, ["a", "b", "c"], per_cluster=40).collect()
    assert {r.k: (r["size"], len(r.refs), r.whole) for r in index} == {0: (190, 40, False), 1: (90, 40, False), 2: (60, 40, False), 3: (1, 1, True)}
    copies = sum(v == [1.0, 1.0, 1.0] for r in index if r.k == 0 for v in r.refs)
    assert 1 <= copies <= 20  # a fifth of the cluster, so about eight


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 0), (2, 0.0, 0), (3, None, 0), (4, 1.0, None), (5, float("nan"), 0)], "id int, a double, cluster int")
    assert {(r.id, r.silhouette) for r in S.silhouette_euclid(df, ["a"]).collect()} == {(1, 0.0), (2, 0.0)}
    assert S.silhouette_euclid(df.limit(0), ["a"]).count() == 0
    with pytest.raises(ValueError):
        S.MOST_NUMBERS, most = 1, S.MOST_NUMBERS
        try:
            S.silhouette_euclid(df, ["a"])
        finally:
            S.MOST_NUMBERS = most


def test_index_of_computed_columns_is_planned_without_them(spark):
    from surveykit.operators import cluster as K
    df = spark.range(60).select(*[(F.col("id") * (j + 1) % 7).cast("double").alias(f"c{j}") for j in range(6)])
    cols = [f"c{j}" for j in range(6)]
    rows = K.assign_clusters(K.standardize(df, cols), cols, [[0.5] * 6, [-0.5] * 6])
    index = S.reference_index(rows, cols)
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "Range" not in plan
    assert sum(r["size"] for r in index.collect()) == 60
