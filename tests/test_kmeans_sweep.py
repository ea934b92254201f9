"""Shared-scan k-means: the same best costs as separate fits, one scan per round, any partitioning."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from surveykit.operators import cluster as K
from surveykit.operators import kmeans_sweep as S


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 8, (6, 5))
    rows = np.concatenate([rng.normal(c, 1.0, (n, 5)) for c, n in zip(centres, (700, 30, 200, 100, 400, 60))] + [np.repeat(centres[:1], 500, axis=0)])
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"x{j} double" for j in range(5))).repartition(6)


def test_best_cost_equals_separate_fits(spark, blobs):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    cols = [f"x{j}" for j in range(5)]
    got = K.fit_kmeans_many(blobs, cols, [2, 4, 6])
    vec = VectorAssembler(inputCols=cols, outputCol="features").transform(blobs).persist()
    for k in (2, 4, 6):
        single = min(KMeans(k=k, seed=s, maxIter=300).fit(vec).summary.trainingCost for s in range(42, 52))
        assert got[k][1] <= single * 1.001
        again = K.inertia(K.assign_clusters(blobs, cols, got[k][2])).first()["inertia"]
        assert got[k][1] == pytest.approx(again, rel=1e-9)
    vec.unpersist()


def test_one_scan_moves_every_set(spark, blobs, monkeypatch):
    vectors = blobs.select(F.array(*blobs.columns).alias("x"))
    scans, scan = [], S._scan
    monkeypatch.setattr(S, "_scan", lambda v, sets: scans.append(len(sets)) or scan(v, sets))
    rounds = []
    sets = S.fit_sets(vectors, [2, 3], [1, 2, 3], watch=lambda s: rounds.append(sum(x.moving for x in s)))
    assert len(sets) == 6 and not any(s.moving for s in sets)
    assert len(scans) == S.ROUNDS + 1 + len(rounds) + 1 and max(scans) == 6  # start, moves, final cost
    for s in sets:  # at rest: each centre is the mean of its rows
        rows = np.array([r.x for r in vectors.collect()])
        near = S.distances(rows, s.centres).argmin(1)
        assert all(np.allclose(rows[near == c].mean(0), s.centres[c], atol=1e-3) for c in range(len(s.centres)))


def test_partitioning_does_not_matter(spark, blobs):
    vectors = blobs.select(F.array(*blobs.columns).alias("x"))
    a, b = (S.fit_sets(v, [3], [7]) for v in (vectors, vectors.orderBy("x").coalesce(2)))
    assert np.allclose(a[0].centres, b[0].centres, atol=1e-9) and a[0].cost == pytest.approx(b[0].cost)


def test_awkward_rows(spark):
    cols = ["a", "b"]
    same = spark.createDataFrame([(1.0, 2.0)] * 9, "a double, b double")
    assert K.fit_kmeans_many(same, cols, [3])[3][1] == 0
    two = spark.createDataFrame([(0.0, 0.0), (5.0, 5.0), (None, 1.0), (float("nan"), 2.0)], "a double, b double")
    _, cost, centres = K.fit_kmeans(two, cols, 2)
    assert cost == 0 and sorted(map(tuple, centres)) == [(0.0, 0.0), (5.0, 5.0)]
    assert K.fit_kmeans_many(two.limit(0), cols, [2]) == {}
    with pytest.raises(ValueError):
        K.fit_kmeans_many(two, cols, [1])


def test_vectors_are_packed_into_few_blocks(spark):
    from surveykit.operators import kmeans_sweep as W
    rows = [([float(i), float(i % 3)],) for i in range(500)] + [([None, 1.0],), (None,), ([float("nan"), 2.0],)]
    blocks = W.packed(spark.createDataFrame(rows, "x array<double>").repartition(9)).collect()
    found = [tuple(v) for b in blocks for v in np.frombuffer(b["block"]).reshape(-1, b["d"])]
    assert len(blocks) == 1 and sorted(found) == [tuple(r[0]) for r in rows[:500]]
