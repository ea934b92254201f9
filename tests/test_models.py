"""Fitted models: invariants (importances, rule partition, routing, CV folds)."""
from pyspark.sql import functions as F

from surveykit.operators import classify as C

from conftest import SF_SMALL


def test_tree_rules_partition_rows(spark, survey_small):
    data = C.feature_vectors(C.stratified_split(survey_small))
    train = data.where(F.col("split") == "train")
    model = C.fit_tree(train, max_depth=4, min_leaf=5)
    rules = C.tree_rules(model, train).collect()
    n = train.count()
    assert sum(r["n"] for r in rules) == n
    assert all(r["n"] == r["n_train"] for r in rules)
    # predicted rate from rules equals the rate from transform
    scored = C.score(model, train)
    assert sum(r["n"] * r["probability"] for r in rules) == __import__("pytest").approx(
        scored.agg(F.sum("score")).first()[0], rel=1e-9)


def test_forest_importances_sum_to_100(spark, survey_small):
    data = C.feature_vectors(survey_small)
    model = C.fit_forest(data, num_trees=10, max_depth=5)
    imp = C.importances(model).collect()
    assert len(imp) == 14
    assert abs(sum(r["importance"] for r in imp) - 100) < 1e-6
    banded = C.tercile_band(C.importances(model), "importance").collect()
    assert {r["band"] for r in banded} <= {"high", "mid", "low"}


def test_folds_disjoint_and_complete(spark, survey_small):
    f = C.assign_folds(survey_small).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in f) == [0, 1, 2, 3, 4]
    assert sum(r["count"] for r in f) == survey_small.count()


def test_single_leaf_tree_gives_one_rule(spark):
    rows = [(float(i % 2), 1.0) for i in range(10)]
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.dense([x]), y) for x, y in rows], ["features", "label"])
    model = C.fit_tree(df, max_depth=4, min_leaf=20)
    from surveykit.operators.classify import _rules_from_nodes, tree_nodes
    rules = _rules_from_nodes(tree_nodes(model), ["Q5_Rattle_Severity_Scale"])
    assert len(rules) == 1 and rules[0]["conds"] == []


def test_compute_all_small(spark, survey_small):
    from surveykit.plans.analyses import compute_all
    out = compute_all(survey_small, num_trees=5, max_depth=4, elbow_ks=[1, 2], silhouette_ks=[2],
                      folds=2, kmeans_max_iter=10, boosted_iter=3)
    assert out["vw_points"].count() == 4
    assert out["clusters"].count() == survey_small.count()
    assert out["cv_auc"].count() == 2
    cmp = out["compare_models"]
    assert cmp.count() == 6 and {"decision_tree", "random_forest", "boosted_trees"} <= set(cmp.columns)


def test_exact_split_counts_and_boundary_ranking(spark):
    """Tiny bucket count forces big boundary buckets; result equals a plain ranking."""
    import hashlib
    rows = [(i, i % 3 % 2) for i in range(1, 301)]
    df = spark.createDataFrame(rows, "respondent_id long, Q12_Reserve_Slot_Intent int")
    for bits in (2, 16):
        got = {r["respondent_id"]: r["split"] for r in C.stratified_split_exact(df, bucket_bits=bits).collect()}
        ref = {}
        for y in (0, 1):
            ids = [i for i, c in rows if c == y]
            ids.sort(key=lambda i: (int(hashlib.md5(f"{i}:42:exact".encode()).hexdigest()[:15], 16), i))
            t = (len(ids) * 50 + 100) // 200
            ref.update({i: ("test" if k < t else "train") for k, i in enumerate(ids)})
        assert got == ref


def test_rules_for_class(spark, survey_small):
    data = C.feature_vectors(survey_small)
    rules = C.tree_rules(C.fit_tree(data), data)
    ones = C.rules_for_class(rules, 1).collect()
    assert all(r["prediction"] == 1 for r in ones)


def test_forest_does_not_depend_on_how_its_rows_are_dealt(spark):
    from pyspark.ml.functions import array_to_vector
    rows = spark.range(600).select(F.array(*[(F.xxhash64(F.lit(j), "id") % 100).cast("double") for j in range(4)]).alias("x"), "id")
    rows = rows.select(array_to_vector("x").alias("features"), (F.col("x")[0] + F.col("x")[1] > 0).cast("double").alias("label"))
    with C._dealt(rows.repartition(40)) as held:
        assert held.rdd.getNumPartitions() == 1 and held.count() == 600
    a, b = (C.fit_forest(rows.repartition(n), num_trees=5, max_depth=6) for n in (3, 40))
    assert a.featureImportances == b.featureImportances
