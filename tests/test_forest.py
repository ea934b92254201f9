"""Forests grown in tasks: splits against brute force, walks against the nodes, nothing but thresholds at the driver."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveykit.operators import classify as C
from surveykit.operators import forest as X
from surveykit.operators.model_store import ModelStore


def some_rows(n=400, d=5, seed=1):
    rng = np.random.default_rng(seed)
    bins = np.vstack([rng.integers(0, 2, (2, n)), rng.integers(0, 9, (d - 2, n))]).astype(np.uint8)
    y = ((bins[0] + (bins[2] > 4) + (rng.random(n) < .1)) >= 1.5).astype(float)
    return bins, y, rng.integers(1, 4, n).astype(float)


def vectors(spark, rows, schema="x array<double>, label double, id int"):
    return spark.createDataFrame(rows, schema).select(array_to_vector("x").alias("features"), "label", "id")


def gain_of(y, w, go):
    left, right = w[~go].sum(), w[go].sum()
    if not left or not right:
        return 0.0
    return (w * y)[~go].sum() ** 2 / left + (w * y)[go].sum() ** 2 / right - (w @ y) ** 2 / w.sum()


@pytest.mark.parametrize("most_cells", [X.MOST_CELLS, 20])
def test_each_split_is_the_best_one(most_cells):
    bins, y, w = some_rows()
    tree = X.grow(bins, y, w, bins.max(1).astype(int) + 1, 5, 30, np.random.default_rng(0), most_cells)
    rows, gains = {0: np.arange(len(y))}, np.zeros(5)
    for i, (f, b, left) in enumerate(zip(tree["feature"], tree["bin"], tree["left"])):
        at = rows[i]
        assert tree["count"][i] == w[at].sum() and tree["value"][i] == pytest.approx((w * y)[at].sum() / w[at].sum())
        best = max(gain_of(y[at], w[at], bins[g, at] > c) for g in range(5) for c in range(9))
        if f < 0:
            assert best == pytest.approx(0, abs=1e-9)
            continue
        go = bins[f, at] > b
        assert gain_of(y[at], w[at], go) == pytest.approx(best)
        gains[f] += best
        rows[left], rows[left + 1] = at[~go], at[go]
    assert len(rows) == len(tree["left"]) and tree["gains"] == pytest.approx(gains)
    ends = X.walk(bins, X._walker(tree["feature"], tree["bin"], tree["left"]))
    assert all((ends[at] == i).all() for i, at in rows.items() if tree["feature"][i] < 0)


def test_depth_and_draws():
    bins, y, w = some_rows()
    widths = bins.max(1).astype(int) + 1
    assert len(X.grow(bins, y, w, widths, 5, 0, np.random.default_rng(0))["left"]) == 1
    assert len(X.grow(bins, y, w, widths, 5, 2, np.random.default_rng(0))["left"]) <= 7
    first = {int(X.grow(bins, y, w, widths, 2, 1, np.random.default_rng(s))["feature"][0]) for s in range(40)}
    assert len(first) > 2


def test_thresholds():
    few = np.array([1.0, 2.0, 2.0, 5.0])
    assert X.thresholds(*X.summary(few), 128).tolist() == [1.5, 3.5]
    assert X.thresholds(*X.summary(np.ones(9)), 128).tolist() == []
    many = np.random.default_rng(0).random(20_000)
    cuts = X.thresholds(*X.summary(many), 128)
    assert len(cuts) == 127
    assert np.bincount(X.binned(many[None], [cuts])[0], minlength=128).max() < 2 * 20_000 / 128
    gaps = np.array([0.0, 1.0, np.nan, 1.0])
    cuts = X.thresholds(*X.summary(gaps), 128)
    assert cuts.tolist() == [0.5, 1.0] and X.binned(gaps[None], [cuts])[0].tolist() == [0, 1, 2, 1]
    assert X.thresholds(*X.summary(np.array([np.nan])), 128).tolist() == []


def test_scores_are_means_of_leaves_and_models_are_kept(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 2, 500), rng.integers(0, 6, 500), rng.normal(size=500)]).astype(float)
    x[::50, 2] = np.nan
    y = ((x[:, 0] + (x[:, 1] > 2)) >= 1).astype(float)
    df = vectors(spark, [(a.tolist(), float(b), i) for i, (a, b) in enumerate(zip(x, y))])
    model = C.fit_forest(df, num_trees=7, max_depth=8)
    model.write().save(str(tmp_path / "m"))
    trees = {}
    for r in spark.read.parquet(str(tmp_path / "m/data")).select("treeID", "nodeData.*").collect():
        trees.setdefault(r.treeID, {})[r.id] = r

    def value(nodes, row):
        n = nodes[0]
        while n.leftChild >= 0:
            n = nodes[n.leftChild if row[n.split.featureIndex] <= n.split.leftCategoriesOrThreshold[0] else n.rightChild]
        return n.prediction

    want = {i: np.mean([value(t, row) for t in trees.values()]) for i, row in enumerate(x)}
    assert len(trees) == 7
    store = ModelStore(spark, str(tmp_path / "store"))
    assert store.publish("k", model)
    for m in (model, store.load("k", X.ForestModel)):
        got = C.score(m, df.repartition(3)).select("id", "label", "score", "prediction", "intent_band").collect()
        assert len(got) == 500 and {r.id: r.score for r in got} == pytest.approx(want)
        assert m.featureImportances == model.featureImportances
    assert C.score(model, df.limit(0)).count() == 0


def test_driver_gets_no_trees_and_no_rows(spark, monkeypatch):
    df = spark.range(4000).select(F.array(*[F.rand(j) for j in range(4)]).alias("x"), "id")
    df = df.select(array_to_vector("x").alias("features"), ((F.col("x")[0] + F.rand(9)) > 1).cast("double").alias("label"), "id").persist()
    got, collect = [], DataFrame.collect

    def watched(self):
        out = collect(self)
        got.append(sum(len(v) if isinstance(v, (bytes, bytearray)) else 8 for r in out for v in r))
        return out
    monkeypatch.setattr(DataFrame, "collect", watched)
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_: pytest.fail("fetched"))
    model = C.fit_forest(df, num_trees=20)
    assert C.score(model, df).agg(F.count_if(F.col("score").between(0, 1))).collect()[0][0] == 4000
    size = model.trees.agg(F.sum("n"), F.count("*"), F.min("n")).collect()[0]
    assert size[1] == 20 and size[0] * 14 > 5 * sum(got)  # thresholds and group numbers, far less than the trees
    assert len(model.trees.inputFiles()) > 1  # grown by several tasks
    df.unpersist()


def test_groups_have_a_partition_each(spark):
    groups = X._groups(spark, 24)
    assert groups.count() == 24
    dealt = groups.repartition(24, "at").select("g", F.spark_partition_id().alias("p")).collect()
    assert {r.g for r in dealt} == set(range(24)) and len({r.p for r in dealt}) == 24


def test_rows_that_make_no_forest(spark):
    ok = [([1.0, 2.0], 1.0, 0), ([0.0, 1.0], 0.0, 1)]
    for bad in ([([1.0, 2.0], None, 2)], [([1.0, 2.0], float("nan"), 2)], [([1.0, 2.0], 3.0, 2)]):
        with pytest.raises(ValueError):
            C.fit_forest(vectors(spark, ok + bad), num_trees=2)
    with pytest.raises(ValueError):
        C.fit_forest(vectors(spark, []), num_trees=2)
    with pytest.raises(ValueError):
        C.fit_forest(vectors(spark, ok), num_trees=2, max_bins=300)


def test_stream_is_scored_as_a_batch(spark, tmp_path):
    rows = [([float(i % 7), float(i % 3)], float(i % 7 > 3), i) for i in range(90)]
    model = C.fit_forest(vectors(spark, rows), num_trees=5)
    spark.createDataFrame(rows, "x array<double>, label double, id int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x array<double>, label double, id int").parquet(str(tmp_path / "in"))
    scored = C.score(model, stream.withColumn("features", array_to_vector("x"))).select("id", "score")
    scored.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")) \
        .trigger(availableNow=True).start().awaitTermination()
    want = {r.id: r.score for r in C.score(model, vectors(spark, rows)).collect()}
    assert {r.id: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()} == pytest.approx(want)


def test_batches_are_as_before_after_fits_side_by_side(spark):
    import threading
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, first, second = spark.conf.get(key), [], threading.Event(), threading.Event()

    def one():
        with X._small_batches(spark):
            first.set()
            second.wait(20)

    a = threading.Thread(target=one)
    a.start()
    first.wait(20)
    with X._small_batches(spark):
        second.set()
        a.join(20)
        seen.append(spark.conf.get(key))
    assert seen == [str(X.BATCH_BYTES)] and spark.conf.get(key) == before


def test_folds_are_scored_by_forests_fitted_side_by_side(spark, survey_small):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    out = C.cross_validate(survey_small, k=2, num_trees=6, max_depth=6, parallelism=2).collect()
    assert sorted(r.fold for r in out) == [0, 1] and all(r.auc > 0.6 for r in out)
    assert spark.conf.get(key) == before


def test_compared_forest_comes_from_the_store_as_a_table(spark, survey_small, monkeypatch):
    from surveykit.plans import contract as Q
    data = C.feature_vectors(C.stratified_split_exact(survey_small)).persist()
    monkeypatch.setattr(C.fit_forest, "__defaults__", (*C.fit_forest.__defaults__[:1], 4, 5, *C.fit_forest.__defaults__[3:]))
    a, b = (Q._model(spark, data, C.fit_forest) for _ in range(2))
    assert isinstance(a, X.ForestModel) and a.trees.inputFiles() == b.trees.inputFiles() and a.trees.count() == 4
    m = Q.M.model_metrics(C.score(a, data)).first()
    assert 50 < m.test_accuracy <= 100 and 50 < m.roc_auc <= 100
    data.unpersist()


@pytest.mark.parametrize("most, depth", [(120, 30), (100, 3), (10, 0)])
def test_more_rows_than_a_task_holds_give_the_same_trees(spark, monkeypatch, most, depth):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 2, 900), rng.integers(0, 6, 900), rng.normal(size=900).round(2)]).astype(float)
    y = (((x[:, 0] + (x[:, 1] > 2)) >= 1) ^ (rng.random(900) < .1)).astype(float)
    df = vectors(spark, [(a.tolist(), float(b), i) for i, (a, b) in enumerate(zip(x, y))]).repartition(3).persist()
    # all features drawn: nothing is left to chance but the bootstrap
    monkeypatch.setattr(X, "FIT_BLOCK", 100)
    whole = X.fit(df, 6, depth, 3, 42, 128, 1.0)
    monkeypatch.setattr(X, "MOST_TREE_ROWS", most)
    parts = X.fit(df, 6, depth, 3, 42, 128, 1.0)
    assert parts.trees.count() == 6
    a, b = ({r.id: r.prediction for r in m.transform(df).select("id", "prediction").collect()} for m in (whole, parts))
    assert a == b and len(a) == 900
    assert parts.featureImportances.toArray() == pytest.approx(whole.featureImportances.toArray())
    kept = "nodeData.prediction", "nodeData.rawCount", "nodeData.split.featureIndex"
    nodes = [m.nodes().select("treeID", *kept).groupBy("treeID", "prediction", "rawCount", "featureIndex").count() for m in (whole, parts)]
    assert sorted(map(tuple, nodes[0].collect())) == sorted(map(tuple, nodes[1].collect()))
    leaves = [m.leaf_counts(df).collect() for m in (whole, parts)]
    assert sorted(map(tuple, leaves[0])) == sorted(map(tuple, leaves[1]))
    df.unpersist()
