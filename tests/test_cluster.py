"""Standardisation, assignment, inertia and the exact squared silhouette."""
import numpy as np
import pytest

from surveykit.operators import cluster as K


def sil_sq_bruteforce(x, lab):
    n = len(x)
    out = []
    for i in range(n):
        d = ((x - x[i]) ** 2).sum(axis=1)
        own = lab == lab[i]
        if own.sum() <= 1:
            out.append(0.0)
            continue
        a = d[own].sum() / (own.sum() - 1)
        others = [d[lab == c].mean() for c in set(lab) if c != lab[i]]
        if not others:
            out.append(0.0)
            continue
        b = min(others)
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_closed_form_equals_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    lab = rng.integers(0, 3, 60)
    lab[0] = 3  # a singleton cluster scores 0
    rows = [(float(a), float(b), float(c), int(k)) for (a, b, c), k in zip(x, lab)]
    df = spark.createDataFrame(rows, "f0 double, f1 double, f2 double, cluster int")
    got = K.silhouette_sq(df, ["f0", "f1", "f2"]).first()["silhouette_sq"]
    assert got == pytest.approx(sil_sq_bruteforce(x, lab), abs=1e-9)


def test_standardize_population_std_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    z = K.standardize(df, ["a", "b"]).collect()
    a = np.array([1.0, 2.0, 3.0])
    assert [r["a"] for r in z] == pytest.approx(list((a - a.mean()) / a.std()))
    assert [r["b"] for r in z] == [0.0, 0.0, 0.0]


def test_k1_inertia_is_n_times_features_after_scaling(spark, survey_small):
    from surveykit.spec import KMEANS_FEATURES
    from pyspark.sql import functions as F
    z = K.standardize(survey_small, KMEANS_FEATURES)
    sd = z.agg(*[F.stddev_pop(c).alias(c) for c in KMEANS_FEATURES]).first()
    nonconst = [c for c in KMEANS_FEATURES if sd[c] > 0]
    r = K.total_sum_of_squares(z, KMEANS_FEATURES).first()
    assert r["inertia"] == pytest.approx(r["n"] * len(nonconst), rel=1e-9)


def test_assignment_ties_go_to_lowest_index(spark):
    df = spark.createDataFrame([(0.0,)], "a double")
    r = K.assign_clusters(df, ["a"], [[1.0], [-1.0]]).first()
    assert r["cluster"] == 0 and r["dist2"] == 1.0


def test_kmeans_elbow_is_monotone_and_k1_exact(spark, survey_small):
    from surveykit.spec import KMEANS_FEATURES
    z = K.standardize(survey_small, KMEANS_FEATURES)
    e = {r["k"]: r["inertia"] for r in K.elbow(z, KMEANS_FEATURES, [1, 2, 3, 4], seeds=(42, 7), max_iter=30).collect()}
    assert e[1] >= e[2] >= e[3] >= e[4]
    sw = K.silhouette_sweep(z, KMEANS_FEATURES, [2, 3], seeds=(42,), max_iter=20).collect()
    assert all(-1 <= r["silhouette_sq"] <= 1 for r in sw)


def test_name_clusters_merges_and_null_labels(spark):
    from surveykit.spec import SurveySpec
    rows = [(1, "Tech_Purist", 0), (2, "Tech_Purist", 1), (3, "FURNITURE", 2), (4, "FURNITURE", 2)]
    df = spark.createDataFrame(rows, "respondent_id long, Segment string, cluster int")
    named = {r["cluster"]: r["Cluster_Label"] for r in K.name_clusters(df, SurveySpec()).collect()}
    assert named[0] == named[1] == "Tech Purist" and named[2] is None


def test_two_clusters_same_majority_merge_in_profile(spark):
    from surveykit.spec import SurveySpec
    rows = [(1, "Tech_Purist", 0, 100.0, 200.0, 3, 1), (2, "Tech_Purist", 1, 300.0, 400.0, 5, 0),
            (3, "FURNITURE", 2, 50.0, 60.0, 1, 0)]
    df = spark.createDataFrame(rows, "respondent_id long, Segment string, cluster int, Q9_Price_Bargain double, "
                                     "Q11_Price_Too_Expensive double, Q5_Rattle_Severity_Scale int, "
                                     "Q12_Reserve_Slot_Intent int")
    prof = K.cluster_profile(K.name_clusters(df, SurveySpec()), SurveySpec()).collect()
    assert len(prof) == 1 and prof[0]["Cluster_Label"] == "Tech Purist"
    assert prof[0]["bargain_price"] == 200.0 and prof[0]["n"] == 2


def test_silhouette_sq_equals_spark_clustering_evaluator(spark, survey_small):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    from surveykit.sources.fixture import fixed_centres
    from surveykit.spec import KMEANS_FEATURES
    z = K.standardize(survey_small, KMEANS_FEATURES)
    asg = K.assign_clusters(z, KMEANS_FEATURES, fixed_centres(len(KMEANS_FEATURES), 4))
    ours = K.silhouette_sq(asg, KMEANS_FEATURES).first()["silhouette_sq"]
    vec = VectorAssembler(inputCols=KMEANS_FEATURES, outputCol="features").transform(asg)
    ev = ClusteringEvaluator(predictionCol="cluster", featuresCol="features",
                             distanceMeasure="squaredEuclidean")
    assert ours == pytest.approx(ev.evaluate(vec), abs=1e-9)


def test_embedding_clusters_use_the_whole_vector(spark, tmp_path):
    """Vectors that differ only from the ninth number on still come apart."""
    from surveykit.plans.contract import QUERIES
    rows = [(i, [0.5] * 8 + [float(i % 5 == j) * 9 + 0.01 * (i % 7) for j in range(5)], i % 5) for i in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["embedding_kmeans_check"](spark, str(tmp_path)).first().n_clusters == 4
    assert tuple(QUERIES["embedding_kmeans_full_check"](spark, str(tmp_path)).first()) == (100, 5, 13, 0)
    pairs = QUERIES["embedding_kmeans_labels"](spark, str(tmp_path)).collect()
    assert sorted(r.label for r in pairs) == [0, 1, 2, 3, 4] and {r.n for r in pairs} == {20}
