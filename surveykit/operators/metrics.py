"""Classification metrics (M14, M15, M18-M20, A15) on any scored DataFrame.

Inputs are rows with a 0/1 label, a score and a 0/1 prediction. Counts come from one
aggregation; ROC and AUC work on the score histogram (distinct scores), whose running
totals are computed with a distributed prefix sum so no single task ever holds
all distinct scores of a large test set.
"""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from ..spec import OVERFIT_GAP_POINTS


def confusion(scored: DataFrame, label: str = "label", pred: str = "prediction",
              by: Sequence[str] = ()) -> DataFrame:
    """(by..., tn, fp, fn, tp) as bigints."""
    y, p = F.col(label), F.col(pred)
    return scored.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).cast("bigint").alias("tn"),
        F.count_if((y == 0) & (p == 1)).cast("bigint").alias("fp"),
        F.count_if((y == 1) & (p == 0)).cast("bigint").alias("fn"),
        F.count_if((y == 1) & (p == 1)).cast("bigint").alias("tp"))


def _ratio(num: Column, den: Column) -> Column:
    """num/den, 0 when the denominator is 0 (undefined precision/recall/F1 → 0)."""
    return F.when(den != 0, num.cast("double") / den).otherwise(F.lit(0.0))


def binary_metrics(scored: DataFrame, label: str = "label", pred: str = "prediction",
                   by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 for class 1 (fractions), supports."""
    cm = confusion(scored, label, pred, by)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    prec = _ratio(tp, tp + fp)
    rec = _ratio(tp, tp + fn)
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    return cm.select(*by, "tn", "fp", "fn", "tp", n.alias("n"),
                     _ratio(tp + tn, n).alias("accuracy"), prec.alias("precision"),
                     rec.alias("recall"), f1.alias("f1"),
                     (tp + fn).alias("support_1"), (tn + fp).alias("support_0"))


def class_report(scored: DataFrame, label: str = "label", pred: str = "prediction",
                 by: Sequence[str] = ()) -> DataFrame:
    """Per-class precision / recall / F1 / support (both classes)."""
    m = binary_metrics(scored, label, pred, by)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    rows = F.array(
        F.struct(F.lit(0).alias("class"), _ratio(tn, tn + fn).alias("precision"),
                 _ratio(tn, tn + fp).alias("recall"), _ratio(2 * tn, 2 * tn + fn + fp).alias("f1"),
                 (tn + fp).alias("support")),
        F.struct(F.lit(1).alias("class"), _ratio(tp, tp + fp).alias("precision"),
                 _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
                 (tp + fn).alias("support")))
    return m.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def running_totals(df: DataFrame, order: str, values: Sequence[str], by: Sequence[str] = (),
                   descending: bool = False, inclusive: bool = True,
                   num_partitions: int | None = None) -> DataFrame:
    """Distributed prefix sums of ``values`` along a numeric ``order`` within each ``by`` group.

    The rows are written once, cut points of ``order`` are taken from them, and the run of
    a row is a plain function of its value: totals per run and the sums inside a run are
    sure to speak of the same runs, however often a branch is computed. Each run is summed
    by itself, and the totals (runs × groups rows) give every run its starting offset.
    Adds ``<v>_cum`` columns (inclusive of the row itself, or strictly before it when
    ``inclusive=False``).
    """
    by = list(by)
    df = written(df, "prefix")
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.25 / parts)) if parts > 1 else ()
    cuts = sorted(c for c in cuts if math.isfinite(c))
    if cuts:  # a binary search per row; NaN, the greatest value, has a run of its own, nulls the first
        r = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_x", outputCol="_at", handleInvalid="keep").transform(
            df.withColumn("_x", F.col(order).cast("double")))
        run = F.when(F.col("_x").isNull(), -1).otherwise(F.col("_at").cast("int"))
        r = r.withColumn("_run", -run if descending else run).drop("_x", "_at")
    else:
        r = df.withColumn("_run", F.lit(0))
    key = F.col(order).desc() if descending else F.col(order).asc()
    tot = r.groupBy("_run", *by).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    w_off = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_run", *by, *[F.coalesce(F.sum(f"_t_{v}").over(w_off), F.lit(0))
                                    .alias(f"_o_{v}") for v in values])
    frame = (Window.unboundedPreceding, Window.currentRow) if inclusive else \
        (Window.unboundedPreceding, -1)
    w_loc = Window.partitionBy("_run", *by).orderBy(key).rowsBetween(*frame)
    loc = r.select("*", *[F.coalesce(F.sum(v).over(w_loc), F.lit(0)).alias(f"_l_{v}") for v in values])
    # ``off`` has one row per (run, group). Without groups that is ≤ ``parts`` rows, a
    # proven bound, so it is broadcast; with groups its size is left to AQE's runtime check.
    j = loc.join(F.broadcast(off) if not by else off, on=["_run", *by])
    return j.select(*[c for c in df.columns],
                    *[(F.col(f"_l_{v}") + F.col(f"_o_{v}")).cast("bigint").alias(f"{v}_cum")
                      for v in values])


def score_histogram(scored: DataFrame, label: str = "label", score: str = "score",
                    by: Sequence[str] = ()) -> DataFrame:
    y = F.col(label)
    return scored.where(y.isNotNull() & F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.count_if(y == 1).cast("bigint").alias("pos"), F.count_if(y == 0).cast("bigint").alias("neg"))


def roc_points(scored: DataFrame, label: str = "label", score: str = "score",
               by: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score (descending), plus the (0, 0) start with a null
    threshold: (by..., threshold, fpr, tpr). Collinear points are kept."""
    by = list(by)
    keys = by or ["_all"]
    if not by:
        scored = scored.withColumn("_all", F.lit(1))
    h = score_histogram(scored, label, score, keys)
    cum = running_totals(h, score, ["pos", "neg"], keys, descending=True)
    totals = h.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    pts = cum.join(totals, on=keys)   # one row per group on the right; AQE broadcasts it
    out = pts.select(*by, F.col(score).cast("double").alias("threshold"),
                     _ratio(F.col("neg_cum"), F.col("N")).alias("fpr"),
                     _ratio(F.col("pos_cum"), F.col("P")).alias("tpr"))
    start = totals.select(*by, F.lit(None).cast("double").alias("threshold"),
                          F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return out.unionByName(start)


def auc(scored: DataFrame, label: str = "label", score: str = "score",
        by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC (trapezoid over all thresholds = Mann-Whitney with ties ½):
    (by..., auc, n_pos, n_neg); null when a class is missing."""
    by = list(by)
    h = score_histogram(scored, label, score, by)
    cum = running_totals(h, score, ["pos"], by, descending=True, inclusive=False)
    # 2·Σ neg(s)·(pos above s) + neg(s)·pos(s), exact in decimals
    term = F.col("neg").cast("decimal(38,0)") * (2 * F.col("pos_cum") + F.col("pos")).cast("decimal(38,0)")
    agg = cum.groupBy(*by).agg(F.sum(term).alias("num2"), F.sum("pos").alias("P"),
                               F.sum("neg").alias("N"))
    den = F.col("P").cast("double") * F.col("N").cast("double") * 2
    return agg.select(*by, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                  F.col("num2").cast("double") / den).alias("auc"),
                      F.col("P").cast("bigint").alias("n_pos"), F.col("N").cast("bigint").alias("n_neg"))


def model_metrics(scored: DataFrame, label: str = "label", score: str = "score",
                  pred: str = "prediction", split: str = "split") -> DataFrame:
    """The six headline numbers (×100) of one model: train/test accuracy, test ROC-AUC,
    precision, recall, F1 for class 1 on the test split. One row."""
    m = binary_metrics(scored, label, pred, [split])
    test = scored.where(F.col(split) == "test")
    a = auc(test, label, score).select("auc")
    acc = lambda s: F.max(F.when(F.col(split) == s, F.col("accuracy")))
    tst = lambda c: F.max(F.when(F.col(split) == "test", F.col(c)))
    one = m.agg((acc("train") * 100).alias("train_accuracy"), (acc("test") * 100).alias("test_accuracy"),
                (tst("precision") * 100).alias("precision"), (tst("recall") * 100).alias("recall"),
                (tst("f1") * 100).alias("f1"))
    return one.select("train_accuracy", "test_accuracy", (a.scalar() * 100).alias("roc_auc"),
                      "precision", "recall", "f1")


METRIC_ORDER = ("train_accuracy", "test_accuracy", "roc_auc", "precision", "recall", "f1")


def compare_models(metrics: Mapping[str, DataFrame]) -> DataFrame:
    """One row per metric, one column per model (full join on the metric)."""
    out = None
    for name, m in metrics.items():
        entries = [F.struct(F.lit(i).alias("pos"), F.lit(k).alias("metric"),
                            F.col(k).cast("double").alias(name)) for i, k in enumerate(METRIC_ORDER)]
        long = m.select(F.explode(F.array(*entries)).alias("r")).select("r.*")
        out = long if out is None else out.join(long, on=["pos", "metric"], how="full")
    return out


def overfit_check(metrics: DataFrame, max_gap: float = OVERFIT_GAP_POINTS) -> DataFrame:
    """gap = train − test accuracy (points); ``overfit`` unless gap < max_gap."""
    gap = F.col("train_accuracy") - F.col("test_accuracy")
    return metrics.select("train_accuracy", "test_accuracy", gap.alias("gap"),
                          (~(gap < max_gap)).alias("overfit"))


def score_stats(scores: DataFrame, col: str = "auc") -> DataFrame:
    """Mean and population standard deviation of per-fold scores."""
    return scores.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"),
                      F.count(col).alias("n_folds"))


def confusion_matrix(scored: DataFrame, label: str = "label", pred: str = "prediction",
                     by: Sequence[str] = ()) -> DataFrame:
    """Square view of the confusion matrix: one row per actual class, columns
    ``pred_0`` / ``pred_1`` (counts)."""
    cm = confusion(scored, label, pred, by)
    rows = F.array(F.struct(F.lit(0).alias("actual"), F.col("tn").alias("pred_0"), F.col("fp").alias("pred_1")),
                   F.struct(F.lit(1).alias("actual"), F.col("fn").alias("pred_0"), F.col("tp").alias("pred_1")))
    return cm.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
