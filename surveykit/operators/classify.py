"""Intent models (M9-M13, M16, M17): split, forest, tree, importances, scoring, rules
and cross-validation on Spark ML.

Trees are grown as *regressors* on the 0/1 label: the variance criterion equals half
the Gini impurity for binary labels, so splits are the same, and leaves keep their
class-1 share (Spark's classification trees merge equal-class siblings). The
probability of class 1 is the leaf mean (averaged over trees); class = p > 0.5.
"""
from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import DEFAULT_SPEC, MODEL_FEATURE_LABELS, RULE_FEATURE_LABELS, SEED, SurveySpec
from .forest import ForestModel, fit

#: Trees grow as deep as Spark ML allows (the original grows them without a limit).
MAX_DEPTH = 30
#: Training rows that make a task of their own worth it, and those that a task gets at most.
LEAST_TASK_ROWS, MOST_TASK_ROWS = 2_500, 100_000


def hash_bucket(id_col: str | Column, salt: str, buckets: int = 100) -> Column:
    """Stateless bucket in [0, buckets): first 32 bits of md5(id ':' salt)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(f":{salt}"))), 1, 8), 16, 10)
    return (h.cast("bigint") % buckets).cast("int")


def stratified_split(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC, test_pct: int = 25,
                     seed: int = SEED) -> DataFrame:
    """M9: adds ``split`` ('train'/'test'). The md5 bucket of the id decides, so each
    class is split at the same rate in expectation, with no shuffle and no state;
    a retried task reproduces it exactly."""
    return df.withColumn("split", F.when(hash_bucket(spec.id_col, str(seed)) < test_pct, "test")
                         .otherwise("train"))


def hash_key(id_col: str | Column, salt: str) -> Column:
    """Stateless 60-bit key: the first 15 hex digits of md5(id ':' salt)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(f":{salt}"))), 1, 15), 16, 10) \
        .cast("bigint")


def stratified_split_exact(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC, test_pct: int = 25,
                           seed: int = SEED, bucket_bits: int = 16) -> DataFrame:
    """M9 (exact counts): in every class the round-half-up(pct·n_c/100) rows with the
    smallest (hash, id) go to 'test'.

    Never sorts a class in one task: rows are counted per (class, top ``bucket_bits`` of
    the hash) with a partial aggregation (≤ classes × 2^bits rows), a window over that
    small histogram finds each class's boundary bucket, and only rows of the boundary
    bucket (≈ n_c / 2^bits) are ranked. Ids are assumed unique.
    """
    y, key = F.col(spec.target_col), hash_key(spec.id_col, f"{seed}:exact")
    shift = 60 - bucket_bits
    keyed = df.withColumn("_h", key).withColumn("_b", F.shiftright(F.col("_h"), shift))
    hist = keyed.groupBy(y.alias("_y"), "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_y").orderBy("_b")
    cum = hist.select("_y", "_b", "_n",
                      F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_c"),
                      F.sum("_n").over(Window.partitionBy("_y")).alias("_nc"))
    target = F.floor((F.col("_nc") * (2 * test_pct) + 100) / 200).cast("bigint")
    bounds = cum.withColumn("_t", target).where(
        (F.col("_c") >= F.col("_t")) & (F.col("_c") - F.col("_n") < F.col("_t"))).select(
        "_y", F.col("_b").alias("_bb"), (F.col("_t") - (F.col("_c") - F.col("_n"))).alias("_r"))
    # one row per class: a proven-size broadcast
    j = keyed.join(F.broadcast(bounds), keyed[spec.target_col].eqNullSafe(bounds["_y"]), "left")
    edge = j.where(F.col("_b") == F.col("_bb"))
    ranked = edge.withColumn("_rk", F.row_number().over(
        Window.partitionBy("_y", "_b").orderBy("_h", spec.id_col)))
    rest = j.where(~F.coalesce(F.col("_b") == F.col("_bb"), F.lit(False))).withColumn(
        "_rk", F.lit(None).cast("int"))
    test = F.coalesce(F.col("_b") < F.col("_bb"), F.lit(False)) | \
        F.coalesce((F.col("_b") == F.col("_bb")) & (F.col("_rk") <= F.col("_r")), F.lit(False))
    out = ranked.unionByName(rest).withColumn("split", F.when(test, "test").otherwise("train"))
    return out.drop("_h", "_b", "_y", "_bb", "_r", "_rk")


def assign_folds(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC, k: int = 5,
                 seed: int = SEED, bucket_bits: int = 16, target: str | None = None) -> DataFrame:
    """Adds ``fold`` in [0, k): a row's rank by (hash, id) in its class, modulo k, so
    every class has ⌊n/k⌋ or ⌈n/k⌉ rows in each fold (disjoint, complete).

    Ranks are a prefix sum: rows per (class, top ``bucket_bits`` of the hash) first, then
    the rank inside a bucket, so a class is never sorted in one task.
    """
    y = F.col(target or spec.target_col)
    keyed = df.withColumn("_h", hash_key(spec.id_col, f"{seed}:fold")).withColumn("_y", y)
    keyed = keyed.withColumn("_b", F.shiftright(F.col("_h"), 60 - bucket_bits))
    hist = keyed.groupBy("_y", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = hist.select(F.col("_y").alias("_yy"), F.col("_b").alias("_bb"),
                         (F.sum("_n").over(Window.partitionBy("_y").orderBy("_b")) - F.col("_n")).alias("_o"))
    j = keyed.join(before, F.col("_y").eqNullSafe(F.col("_yy")) & (F.col("_b") == F.col("_bb")))
    rank = F.row_number().over(Window.partitionBy("_y", "_b").orderBy("_h", spec.id_col)) - 1
    return j.withColumn("fold", ((F.col("_o") + rank) % k).cast("int")).drop("_h", "_y", "_b", "_yy", "_bb", "_o")


def feature_vectors(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=spec.model_features, outputCol="features", handleInvalid="keep")
    return va.transform(df.withColumn("label", F.col(spec.target_col).cast("double")))


@contextmanager
def _dealt(train: DataFrame) -> Iterator[DataFrame]:
    """The training vectors, held while a model is fitted, in no more tasks than the cores and
    the rows call for.

    In each pass over the rows a task sets up and hands out the statistics of all nodes that
    the pass splits, with rows of them or without: nodes x tasks is what a fit costs. The rows
    of a partition are in an order of their values, so a fit can be repeated.
    """
    vectors = train.select("features", "label")
    n = vectors.count()
    tasks = max(1, min(train.sparkSession.sparkContext.defaultParallelism, n // LEAST_TASK_ROWS), -(-n // MOST_TASK_ROWS))
    held = vectors.repartition(tasks).sortWithinPartitions(F.xxhash64("features", "label")).persist()
    try:
        yield held
    finally:
        held.unpersist()


def fit_forest(train: DataFrame, spec: SurveySpec = DEFAULT_SPEC, num_trees: int = 300,
               max_depth: int = MAX_DEPTH, seed: int = SEED, max_bins: int = 128,
               subsampling_rate: float = 1.0):
    """Random forest (√features per split, bootstrap, full depth) on feature vectors.

    The trees are grown in tasks and stay in a table, see ``forest``.
    """
    with _dealt(train) as rows:
        return fit(rows, num_trees, max_depth, math.ceil(math.sqrt(len(spec.model_features))), seed, max_bins, subsampling_rate)


def fit_tree(train: DataFrame, max_depth: int = 4, min_leaf: int = 20, seed: int = SEED,
             max_bins: int = 128):
    """One readable tree (depth 4, at least 20 rows per leaf)."""
    from pyspark.ml.regression import DecisionTreeRegressor
    dt = DecisionTreeRegressor(featuresCol="features", labelCol="label", maxDepth=max_depth,
                               minInstancesPerNode=min_leaf, seed=seed, maxBins=max_bins)
    return dt.fit(train)


def fit_boosted(train: DataFrame, max_iter: int = 100, max_depth: int = 3, step: float = 0.1,
                seed: int = SEED, max_bins: int = 128):
    """Gradient-boosted trees (logistic loss) — a *computed* third model for comparisons.
    ``score`` works on it through its ``probability`` column."""
    from pyspark.ml.classification import GBTClassifier
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=max_iter,
                        maxDepth=max_depth, stepSize=step, seed=seed, maxBins=max_bins)
    with _dealt(train) as rows:
        return gbt.fit(rows)


def score(model, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``score`` (P(class 1)), ``prediction`` (score > threshold) and
    ``intent_band`` ('high'/'low') to any batch or streaming DataFrame of vectors."""
    out = model.transform(df)
    if "probability" in out.columns:   # classifiers: P(class 1) from the probability vector
        from pyspark.ml.functions import vector_to_array
        out = out.drop("prediction", "rawPrediction").withColumn(
            "score", vector_to_array("probability")[1]).drop("probability")
    else:                              # regressors on the 0/1 label: the prediction is P(1)
        out = out.withColumnRenamed("prediction", "score")
    pred = (F.col("score") > threshold).cast("int")
    return out.withColumn("prediction", pred).withColumn(
        "intent_band", F.when(pred == 1, "high").otherwise("low"))


def node_importances(nodes: list[dict], features: int) -> list[float]:
    """Each feature's share of the impurity that a tree given by its nodes removes."""
    by_id = {n["id"]: n for n in nodes}
    gain = [0.0] * features
    for n in nodes:
        if n["leftChild"] >= 0:
            below = (by_id[n["leftChild"]], by_id[n["rightChild"]])
            left = sum(b["rawCount"] * b["prediction"] * (1 - b["prediction"]) for b in below)
            gain[n["feature"]] += n["rawCount"] * n["prediction"] * (1 - n["prediction"]) - left
    return [g / (sum(gain) or 1.0) for g in gain]


def importances(model, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    """(feature, label, importance ×100) ascending — one row per feature."""
    return importance_table(model.featureImportances.toArray().tolist(), spec)


def importance_table(vals: Sequence[float], spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    spark = _spark()
    rows = [(f, lab, float(v) * 100) for f, lab, v in zip(spec.model_features, MODEL_FEATURE_LABELS, vals)]
    return spark.createDataFrame(rows, "feature string, label string, importance double") \
        .orderBy("importance", "feature")


def tercile_band(df: DataFrame, col: str, labels=("high", "mid", "low")) -> DataFrame:
    """> q66 → high, > q33 → mid, else low; exact interpolated quantiles of ``col``
    (computed without holding the column in one buffer, see ``exact_quantiles``)."""
    from .describe import exact_quantiles
    q33, q66 = exact_quantiles(df, col, [0.33, 0.66])
    if q33 is None:
        return df.withColumn("band", F.lit(labels[2]))
    return df.withColumn("band", F.when(F.col(col) > F.lit(q66), labels[0])
                         .when(F.col(col) > F.lit(q33), labels[1]).otherwise(labels[2]))


def _spark():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


# ---- tree rules ----------------------------------------------------------------------
def tree_nodes(model) -> list[dict]:
    """The fitted tree's nodes, read back from the saved model (≤ 2^(depth+1) rows)."""
    from ..session import scratch_path
    spark = _spark()
    path = scratch_path(spark, f"tree-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "id", "prediction", "leftChild", "rightChild", "rawCount",
        F.col("split.featureIndex").alias("feature"),
        F.col("split.leftCategoriesOrThreshold").alias("thr")).collect()
    return [r.asDict() for r in nodes]


def _rules_from_nodes(nodes: list[dict], features: Sequence[str]) -> list[dict]:
    by_id = {n["id"]: n for n in nodes}
    root = min(by_id)
    out = []
    stack = [(root, [])]
    while stack:
        nid, conds = stack.pop()
        n = by_id[nid]
        if n["leftChild"] < 0:
            out.append({"conds": conds, "prediction": float(n["prediction"]), "n_model": n["rawCount"]})
            continue
        f, t = features[n["feature"]], float(n["thr"][0])
        stack.append((n["rightChild"], conds + [(f, ">", t)]))
        stack.append((n["leftChild"], conds + [(f, "<=", t)]))
    return out


def _condition_text(feature: str, op: str, thr: float) -> str:
    label = RULE_FEATURE_LABELS.get(feature, feature)
    if thr == 0.5:  # a 0/1 flag split
        return f"{label} = {'No' if op == '<=' else 'Yes'}"
    return f"{label} {op} {thr:.2f}"


def leaf_counts(model, data: DataFrame) -> DataFrame:
    """(tree, leaf, n): rows of ``data`` that end in each leaf, by the model's own leaf numbers
    (a tree's leaves from left to right); leaves without rows are left out. For a single tree
    (tree 0) and for ensembles."""
    if isinstance(model, ForestModel):
        return model.leaf_counts(data)
    from pyspark.ml.functions import vector_to_array
    out = model.copy().setLeafCol("_leaf").transform(data.select("features"))
    if isinstance(out.schema["_leaf"].dataType, T.DoubleType):
        leaves = out.select(F.lit(0).alias("tree"), F.col("_leaf").cast("int").alias("leaf"))
    else:
        leaves = out.select(F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf")).select("tree", F.col("leaf").cast("int"))
    return leaves.groupBy("tree", "leaf").agg(F.count("*").alias("n"))


def _rules_frame(rules: list[dict], counts: dict[int, int]) -> DataFrame:
    rows = [(i, [_condition_text(*c) for c in r["conds"]], int(r["prediction"] > 0.5),
             r["prediction"], int(counts.get(i, 0)), int(r["n_model"])) for i, r in enumerate(rules)]
    return _spark().createDataFrame(
        rows, "rule_id int, conditions array<string>, prediction int, probability double, "
              "n bigint, n_train bigint")


def tree_rules(model, data: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    """One IF-THEN rule per leaf: (rule_id, conditions, predicted class, leaf
    probability, rows reached in ``data``). Rules are numbered as the model numbers its
    leaves; the rows come from one count per leaf."""
    rules = _rules_from_nodes(tree_nodes(model), spec.model_features)
    counts = {r["leaf"]: r["n"] for r in leaf_counts(model, data).collect()}  # one row per leaf
    return _rules_frame(rules, counts)


def leaf_of(nodes: list[dict], features: Sequence[str]) -> Column:
    """The number of the leaf that a row ends in, for a tree given by its nodes: one nested
    condition, so a row tests one path. A null is not above a threshold and goes left."""
    by_id, numbers = {n["id"]: n for n in nodes}, iter(range(len(nodes)))

    def at(node: dict) -> Column:
        if node["leftChild"] < 0:
            return F.lit(next(numbers))
        left, right = at(by_id[node["leftChild"]]), at(by_id[node["rightChild"]])
        return F.when(F.col(features[node["feature"]]) > F.lit(float(node["thr"][0])), right).otherwise(left)

    return at(by_id[min(by_id)])


def score_by_nodes(df: DataFrame, nodes: list[dict], spec: SurveySpec = DEFAULT_SPEC, threshold: float = 0.5) -> DataFrame:
    """M13 for a tree given by its nodes (read back, or written by hand): adds ``leaf``,
    ``score``, ``prediction`` and ``intent_band``."""
    rules = _rules_from_nodes(nodes, spec.model_features)
    scores = F.array(*[F.lit(float(r["prediction"])) for r in rules])
    out = df.withColumn("leaf", leaf_of(nodes, spec.model_features)).withColumn("score", F.get(scores, F.col("leaf")))
    prediction = (F.col("score") > threshold).cast("int")
    return out.withColumn("prediction", prediction).withColumn("intent_band", F.when(prediction == 1, "high").otherwise("low"))


def rules_by_nodes(df: DataFrame, nodes: list[dict], spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    """M16 for a tree given by its nodes."""
    counted = score_by_nodes(df, nodes, spec).groupBy("leaf").agg(F.count("*").alias("n")).collect()
    return _rules_frame(_rules_from_nodes(nodes, spec.model_features), {r["leaf"]: r["n"] for r in counted})


def first_rules_per_class(rules: DataFrame, k: int = 5) -> DataFrame:
    """The first k rules of each predicted class."""
    from pyspark.sql import Window
    w = Window.partitionBy("prediction").orderBy("rule_id")
    return rules.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---- cross-validation --------------------------------------------------------------
def cross_validate(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC, k: int = 5,
                   num_trees: int = 300, max_depth: int = MAX_DEPTH, seed: int = SEED,
                   parallelism: int | None = None) -> DataFrame:
    """K folds; each fold scored by a forest fitted on the others: (fold, auc).
    The k fits are independent; two run at a time by default (one fills the cores but for the
    ends of its stages)."""
    from concurrent.futures import ThreadPoolExecutor

    from .metrics import auc
    spark = _spark()
    data = feature_vectors(assign_folds(df, spec, k, seed), spec).persist()

    def one(f):
        model = fit_forest(data.where(F.col("fold") != f), spec, num_trees, max_depth, seed)
        return f, auc(score(model, data.where(F.col("fold") == f))).first()["auc"]

    try:
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism or 2, k))) as ex:
            rows = list(ex.map(one, range(k)))
    finally:
        data.unpersist()
    return spark.createDataFrame(rows, "fold int, auc double")


def score_new_rows(store, key: str, reader, df: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    """M13 from a stored model: survey rows of any later batch, scored without a fit."""
    return score(store.load(key, reader), feature_vectors(df, spec))


def predict_profile(model, spark, profile: dict, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    """Live predictor (S5 + M13): one literal respondent profile → class, probability, band.
    ``profile`` maps model feature columns to values (0/1 flags, score, four prices)."""
    from ..sources.survey import survey_rows
    cols = [spec.id_col, *spec.model_features, spec.target_col]
    row = [0, *[profile[c] for c in spec.model_features], None]
    return score(model, feature_vectors(survey_rows(spark, [row], cols), spec))


def rules_for_class(rules: DataFrame, prediction: int) -> DataFrame:
    """the tree rules that predict one class."""
    return rules.where(F.col("prediction") == prediction)
