"""Euclidean silhouette without all pairs (M4): every row against a stratified reference index.

The index holds up to a fixed number of rows of each cluster, those with the smallest hash, so
it doesn't depend on the partitioning. Each row's mean distance to a cluster is estimated from
that cluster's reference rows; clusters that the index holds whole are exact. A row is compared
with the index in its task, a block of rows and a cluster at a time, and nothing of the data's
size is sent anywhere: the index is clusters x size x dimensions, and its size is checked.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Reference rows of a cluster, and the most numbers that an index may hold (it is broadcast).
PER_CLUSTER, MOST_NUMBERS = 512, 4_000_000
#: Distances held at a time while a task scores a block of rows.
HELD = 1 << 20
#: Half the width of a two-sided interval of about 95 %, in standard errors.
INTERVAL = 1.96


def _vector(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in cols])


def reference_index(df: DataFrame, cols: Sequence[str], cluster_col: str = "cluster", per_cluster: int = PER_CLUSTER) -> DataFrame:
    """One row per cluster: k, size (its rows), whole (whether the index holds all), refs (vectors).

    Rows without a cluster or with a missing number are left out. Of each cluster the rows with
    the smallest hash of (vector, occurrence) are kept; copies of one vector are told apart by
    their place among the copies, so a vector with many copies is drawn as often as others.
    """
    rows = df.select(F.col(f"`{cluster_col}`").alias("k"), _vector(cols).alias("x"))
    rows = rows.where(F.col("k").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    # copies are counted, not ranked: at most per_cluster of them can be drawn
    # written: both branches read it, and planning stays free of the columns' own expressions,
    # whose constraints the optimizer would carry through every join (gigabytes on the driver)
    counted = written(rows.groupBy("k", "x").agg(F.count("*").alias("copies")), "vectors")
    drawn = counted.select("k", "x", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("copies"), F.lit(per_cluster).cast("long")))).alias("i"),
                           "copies")
    # the i-th smallest of n uniform numbers, drawn one from another: (1 - u)^(1/n) and so on downwards
    u = lambda salt: (F.pmod(F.xxhash64(F.lit(salt), "x", "i"), F.lit(1 << 52)) + 1) / float(1 << 52)
    step = -F.log(u("reference")) / (F.col("copies") - F.col("i") + 1)
    place = F.sum(step).over(Window.partitionBy("k", "x").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = drawn.withColumn("place", place).withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("place", "x", "i")))
    kept = ranked.where(F.col("rank") <= per_cluster).groupBy("k").agg(F.collect_list("x").alias("refs"))
    sizes = counted.groupBy("k").agg(F.sum("copies").alias("size"))
    return sizes.join(kept, "k").select("k", "size", (F.col("size") == F.size("refs")).alias("whole"), "refs")


def _block_scores(x: np.ndarray, own: np.ndarray, index: Sequence[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Score and error of each row of ``x`` in its cluster (a place in the index)."""
    a, a_error, b, b_error = (np.full(len(x), np.nan) for _ in range(4))
    has_a, has_b, single = (np.zeros(len(x), bool) for _ in range(3))
    with np.errstate(all="ignore"):
        for c, (size, whole, refs) in enumerate(index):
            mine, d = own == c, np.zeros((len(x), len(refs)))
            for j in range(x.shape[1]):
                d += (x[:, j, None] - refs[None, :, j]) ** 2
            d = np.sqrt(d)
            # of its own cluster's reference rows, the row itself (or one copy) must not count
            n = len(refs) - (mine & (d == 0).any(1))
            mean = d.sum(1) / n
            spread = np.where(n > 1, np.sqrt(np.maximum((d * d).sum(1) - n * mean * mean, 0.0) / (n - 1)), 0.0)
            # without replacement from the cluster's other rows
            left = np.maximum(0.0, 1 - n / (size - mine))
            error = np.zeros(len(x)) if whole else INTERVAL * spread * np.sqrt(left / n)
            a, a_error = np.where(mine, mean, a), np.where(mine, error, a_error)
            has_a, single = has_a | (mine & (n > 0)), single | (mine & (size <= 1))
            nearer = ~mine & (n > 0) & (~has_b | (mean < b) | ((mean == b) & (error < b_error)) | (np.isnan(b) & ~np.isnan(mean)))
            b, b_error, has_b = np.where(nearer, mean, b), np.where(nearer, error, b_error), has_b | nearer
        top, low = np.maximum(a, b), np.fmin(a, b)
        nothing = single | ~has_a | ~has_b | (top == 0)
        # s is 1 - a/b or b/a - 1: the errors of both means, carried over
        error = np.sqrt((a_error * np.where(a >= b, low / top, 1.0)) ** 2 + (b_error * np.where(a >= b, 1.0, low / top)) ** 2) / top
        return np.where(nothing, 0.0, (b - a) / top), np.where(nothing, 0.0, error)


def silhouette_euclid(df: DataFrame, cols: Sequence[str], cluster_col: str = "cluster", per_cluster: int = PER_CLUSTER) -> DataFrame:
    """``df``'s clustered rows with ``silhouette`` and ``silhouette_error``.

    The error is half a 95 % interval from the spread of the distances to the reference rows (0
    where the index holds whole clusters: then the score is exact). A row in a cluster of its own
    scores 0, as do all rows of a single cluster. Rows without a cluster or with a missing number
    are left out.
    """
    clusters = reference_index(df, cols, cluster_col, per_cluster).collect()  # bounded by the check below
    if sum(len(r["refs"]) for r in clusters) * len(cols) > MOST_NUMBERS:
        raise ValueError("the reference index is too large: take a smaller per_cluster")
    rows = df.withColumn("_x", _vector(cols)).where(
        F.col(f"`{cluster_col}`").isNotNull() & ~F.exists("_x", lambda v: v.isNull() | F.isnan(v)))
    kind = dict(df.dtypes)[cluster_col]
    place = F.array_position(F.array(*[F.lit(r["k"]) for r in clusters]).cast(f"array<{kind}>"), F.col(f"`{cluster_col}`")) - 1
    index = [(r["size"], r["whole"], np.array(r["refs"], dtype=np.float64).reshape(-1, len(cols))) for r in clusters]

    @F.pandas_udf("struct<silhouette:double,silhouette_error:double>")
    def scores(x: pd.Series, own: pd.Series) -> pd.DataFrame:
        own, parts, step = own.to_numpy(), [], max(1, HELD // max(len(refs) for *_, refs in index))
        for low in range(0, len(x), step):
            block = np.array(x.iloc[low:low + step].tolist(), dtype=np.float64)
            parts.append(_block_scores(block, own[low:low + step], index))
        score, error = (np.concatenate(p) for p in zip(*parts)) if parts else ([], [])
        return pd.DataFrame({"silhouette": score, "silhouette_error": error})

    scored = rows.withColumn("_s", scores("_x", place))
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], "_s.silhouette", "_s.silhouette_error")


def silhouette_euclid_mean(df: DataFrame, cols: Sequence[str], cluster_col: str = "cluster", per_cluster: int = PER_CLUSTER) -> DataFrame:
    """(silhouette, mean_error, n): the mean score, the mean of the rows' errors (a bound of the
    mean's own error, as rows share the index), and the rows scored."""
    return silhouette_euclid(df, cols, cluster_col, per_cluster).agg(
        F.avg("silhouette").alias("silhouette"), F.avg("silhouette_error").alias("mean_error"), F.count("*").alias("n"))
