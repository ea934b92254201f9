"""The model store: order-independent keys, one fit, atomic publishing; leaves against the nodes."""
import pytest
from pyspark.sql import functions as F

from surveykit.operators import classify as C
from surveykit.operators.model_store import ModelStore, model_key, table_fingerprint
from surveykit.spec import DEFAULT_SPEC as SPEC


def test_fingerprint(spark):
    rows = [(1, "a", 1.5), (2, None, 2.0), (2, None, 2.0), (3, "", None), (None, "b", 0.0)]
    df = spark.createDataFrame(rows, "x int, y string, z double")
    own = table_fingerprint(df, ["x", "y", "z"])
    assert own == table_fingerprint(df.repartition(4).orderBy(F.desc("z")), ["x", "y", "z"])
    others = [df.limit(4), df.unionAll(df.limit(1)), df.withColumn("x", F.coalesce("x", F.lit(0))), df.withColumn("x", F.col("x").cast("long")),
              df.withColumn("y", F.coalesce("y", F.lit(""))), df.distinct(), df.where("x <> 2"), df.limit(0)]
    keys = [table_fingerprint(o, ["x", "y", "z"]) for o in others] + [table_fingerprint(df, ["x", "z", "y"]), own]
    assert len(set(keys)) == len(keys)
    # a cell swapped between two rows changes the rows, not the columns' contents
    swapped = spark.createDataFrame([(2, "a", 1.5), (1, None, 2.0), *rows[2:]], df.schema)
    assert table_fingerprint(swapped, ["x", "y", "z"]) != own


def test_one_fit_then_load(spark, survey_small, tmp_path):
    from pyspark.ml.regression import DecisionTreeRegressionModel as Reader
    store = ModelStore(spark, str(tmp_path / "models"))
    train = C.feature_vectors(survey_small)
    cols, fits = [*SPEC.model_features, "label"], []

    def fit(df):
        fits.append(1)
        return C.fit_tree(df)
    a = store.fit_or_load(train, "tree", {"max_depth": 4}, cols, fit, Reader)
    b = store.fit_or_load(train.repartition(5), "tree", {"max_depth": 4}, cols, fit, Reader)
    assert len(fits) == 1 and a.toDebugString.split("\n")[1:] == b.toDebugString.split("\n")[1:]
    changed = survey_small.withColumn(SPEC.model_features[0], F.when(F.col(SPEC.id_col) == survey_small.first()[SPEC.id_col], 1 - F.col(SPEC.model_features[0]))
                                      .otherwise(F.col(SPEC.model_features[0])))
    store.fit_or_load(C.feature_vectors(changed), "tree", {"max_depth": 4}, cols, fit, Reader)
    store.fit_or_load(train, "tree", {"max_depth": 5}, cols, fit, Reader)
    assert len(fits) == 3
    key = model_key("tree", {"max_depth": 4}, table_fingerprint(train, cols))
    # a second writer leaves the first one's model alone
    assert store.has(key) and not store.publish(key, C.fit_tree(train, max_depth=1))
    assert store.load(key, Reader).depth == a.depth
    assert not [p.name for p in (tmp_path / "models").iterdir() if p.name.startswith(".staging")]
    # a later store on the same folder scores new rows without a fit
    later = C.score_new_rows(ModelStore(spark, str(tmp_path / "models")), key, Reader, survey_small.limit(7))
    want = C.score(a, C.feature_vectors(survey_small.limit(7)))
    assert sorted(map(tuple, later.select(SPEC.id_col, "score").collect())) == sorted(map(tuple, want.select(SPEC.id_col, "score").collect()))


def walk(nodes, row):
    by_id, order = {n["id"]: n for n in nodes}, []
    stack = [0]
    while stack:
        n = by_id[stack.pop()]
        if n["leftChild"] < 0:
            order.append(n["id"])
        else:
            stack += [n["rightChild"], n["leftChild"]]
    n = by_id[0]
    while n["leftChild"] >= 0:
        n = by_id[n["rightChild"] if row[n["feature"]] > n["thr"][0] else n["leftChild"]]
    return order.index(n["id"])


@pytest.mark.parametrize("trees", [1, 5])
def test_leaf_counts_equal_a_walk(spark, survey_small, tmp_path, trees):
    from collections import Counter
    data = C.feature_vectors(survey_small).persist()
    model = C.fit_tree(data) if trees == 1 else C.fit_forest(data, num_trees=trees, max_depth=6)
    got = {(r.tree, r.leaf): r.n for r in C.leaf_counts(model, data).collect()}
    rows = [[r[c] for c in SPEC.model_features] for r in survey_small.select(*SPEC.model_features).collect()]
    if trees == 1:
        all_nodes = {0: C.tree_nodes(model)}
    else:
        model.write().save(str(tmp_path / "forest"))
        saved = spark.read.parquet(str(tmp_path / "forest" / "data")).select("treeID", "nodeData.*").collect()
        all_nodes = {}
        for r in saved:
            all_nodes.setdefault(r.treeID, []).append({"id": r.id, "leftChild": r.leftChild, "rightChild": r.rightChild,
                                                       "feature": r.split.featureIndex, "thr": r.split.leftCategoriesOrThreshold})
    assert got == Counter((t, walk(nodes, row)) for t, nodes in all_nodes.items() for row in rows)
    if trees == 1:
        rules = C.tree_rules(model, data).collect()
        assert [r.n for r in sorted(rules, key=lambda r: r.rule_id)] == [r.n_train for r in sorted(rules, key=lambda r: r.rule_id)]
        by_nodes = C.rules_by_nodes(survey_small, all_nodes[0]).collect()
        assert sorted(map(str, by_nodes)) == sorted(map(str, rules))
        imp = C.node_importances(all_nodes[0], len(SPEC.model_features))
        assert imp == pytest.approx(model.featureImportances.toArray().tolist(), abs=1e-9)
    data.unpersist()
