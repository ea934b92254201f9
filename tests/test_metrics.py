"""Metric operators against plain-Python definitions and the edge cases."""
import numpy as np
import pytest

from surveykit.operators import metrics as M


def frame(spark, rows):
    return spark.createDataFrame(rows, "label int, score double, prediction int")


def auc_pairs(rows):
    pos = [s for y, s, _ in rows if y == 1]
    neg = [s for y, s, _ in rows if y == 0]
    tot = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def test_auc_equals_pairwise_definition(spark):
    rng = np.random.default_rng(5)
    rows = [(int(y), float(np.round(s, 2)), int(s > 0.5)) for y, s in
            zip(rng.integers(0, 2, 400), rng.random(400))]
    got = M.auc(frame(spark, rows)).first()["auc"]
    assert got == pytest.approx(auc_pairs(rows), abs=1e-12)


def test_auc_all_tied_and_one_class(spark):
    rows = [(1, 0.3, 0), (0, 0.3, 0), (1, 0.3, 0)]
    assert M.auc(frame(spark, rows)).first()["auc"] == 0.5
    assert M.auc(frame(spark, [(1, 0.1, 0), (1, 0.2, 0)])).first()["auc"] is None


def test_running_totals_equal_cumsum(spark):
    rng = np.random.default_rng(2)
    vals = [(int(g), float(k), int(v)) for g, k, v in zip(rng.integers(0, 3, 500), rng.random(500), rng.integers(0, 9, 500))]
    df = spark.createDataFrame(vals, "g int, k double, v long")
    got = M.running_totals(df, "k", ["v"], ["g"], num_partitions=7).collect()
    for g in range(3):
        mine = sorted((r["k"], r["v_cum"]) for r in got if r["g"] == g)
        ref = sorted((k, v) for gg, k, v in vals if gg == g)
        assert [c for _, c in mine] == list(np.cumsum([v for _, v in ref]))


def test_auc_of_many_distinct_scores_is_exact_and_repeatable(spark):
    from pyspark.sql import functions as F
    df = spark.range(200_000).select(
        (F.pmod(F.xxhash64("id"), F.lit(1000003)) / 1000003.0).alias("noise"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    df = df.select("label", (F.col("noise") + 0.4 * F.col("label")).alias("score"), F.lit(0).alias("prediction"))
    rows = df.select("label", "score").toPandas()
    ranks = rows["score"].rank().to_numpy()
    pos = rows["label"].to_numpy() == 1
    exact = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    for _ in range(4):
        assert abs(M.auc(df).first()["auc"] - exact) < 1e-12
    pts = M.roc_points(df).orderBy("fpr", "tpr").toPandas()
    area = float(((pts["fpr"].diff() * (pts["tpr"] + pts["tpr"].shift()) / 2).dropna()).sum())
    assert abs(area - exact) < 1e-9


def test_roc_points_start_and_end(spark):
    rows = [(1, 0.9, 1), (0, 0.8, 1), (1, 0.4, 0), (0, 0.1, 0)]
    pts = sorted(((r["fpr"], r["tpr"]) for r in M.roc_points(frame(spark, rows)).collect()))
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)


def test_undefined_precision_is_zero(spark):
    rows = [(0, 0.1, 0), (1, 0.2, 0)]
    m = M.binary_metrics(frame(spark, rows)).first()
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and m["f1"] == 0.0 and m["accuracy"] == 0.5


def test_overfit_gap_strict(spark):
    df = spark.createDataFrame([(90.0, 85.0), (90.0, 85.5)], "train_accuracy double, test_accuracy double")
    flags = [r["overfit"] for r in M.overfit_check(df).collect()]
    assert flags == [True, False]


def test_class_balance_one_class(spark):
    from surveykit.operators.describe import class_balance
    from surveykit.spec import SurveySpec
    df = spark.createDataFrame([(1,), (1,)], "Q12_Reserve_Slot_Intent int")
    r = class_balance(df, SurveySpec()).first()
    assert r["ratio"] is None and r["balanced"] is False


def test_class_difference_exactly_20_is_flagged(spark):
    from surveykit.operators.describe import class_balance
    from surveykit.spec import SurveySpec
    df = spark.createDataFrame([(1,)] * 6 + [(0,)] * 4, "Q12_Reserve_Slot_Intent int")
    r = class_balance(df, SurveySpec()).first()
    assert r["abs_diff"] == 20.0 and r["balanced"] is False


def test_confusion_matrix_square(spark):
    rows = [(1, 0.9, 1), (0, 0.8, 1), (1, 0.4, 0), (0, 0.1, 0), (0, 0.2, 0)]
    cm = {r["actual"]: (r["pred_0"], r["pred_1"]) for r in M.confusion_matrix(frame(spark, rows)).collect()}
    assert cm == {0: (2, 1), 1: (1, 1)}


def test_exact_quantiles_match_numpy(spark):
    from surveykit.operators.describe import exact_quantiles
    rng = np.random.default_rng(11)
    vals = [float(v) for v in np.round(rng.normal(size=777), 1)]   # many ties
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    probs = [0.0, 0.33, 0.5, 0.66, 1.0]
    got = exact_quantiles(df, "x", probs)
    assert got == pytest.approx(list(np.quantile(vals, probs)), abs=1e-12)
