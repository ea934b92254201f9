"""Segmentation (M1-M8): standardisation, assignment, inertia, silhouette, k-means
sweeps and cluster naming.

Statistics that every row needs (means, deviations, per-cluster sums) are one-row or
k-row aggregates attached as scalar subqueries, so the row-level work is a single
projection inside whole-stage codegen. The silhouette is the exact squared-Euclidean
one in closed form (O(n·k)); the Euclidean one is estimated from a reference index
(``silhouette_index``).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import recode
from ..spec import DEFAULT_SPEC, SEED, SurveySpec
from . import kmeans_sweep
from .describe import group_mode, segment_profile, crosstab_rates


def column_stats(df: DataFrame, cols: Sequence[str]) -> list[tuple[float | None, float | None]]:
    """(mean, population std) of each column from ONE aggregation (2·d numbers)."""
    r = df.agg(*[F.avg(c).alias(f"mu{i}") for i, c in enumerate(cols)],
               *[F.stddev_pop(c).alias(f"sd{i}") for i, c in enumerate(cols)]).first()
    return [(r[f"mu{i}"], r[f"sd{i}"]) for i in range(len(cols))]


def standardize(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
                suffix: str = "", stats: Sequence | None = None) -> DataFrame:
    """M1: (x - mean) / population std per column; a constant column becomes 0.

    Like an ML fit/transform: the statistics come from one aggregation job (a bounded
    2·d numbers), the transform is a literal projection inside whole-stage codegen.
    Nulls stay null.
    """
    stats = stats if stats is not None else column_stats(df, cols)
    out = []
    for (mu, sd), c in zip(stats, cols):
        x = F.col(c).cast("double")
        if sd is not None and sd > 0:
            z = (x - F.lit(float(mu))) / F.lit(float(sd))
        else:
            z = F.when(x.isNotNull(), F.lit(0.0))
        out.append(z.alias(f"{c}{suffix}"))
    return df.select(*keep, *out)


def _sqdist_to_each(x: Column, centres: Sequence[Sequence[float]]) -> Column:
    """array<struct<d2, k>>: squared distance of the feature array ``x`` to each centre.

    ``x`` is referenced once (inside the higher-order function), so the optimizer
    cannot copy the standardisation expressions once per centre and per term.
    """
    lit_centres = F.array(*[F.struct(F.lit(k).alias("k"),
                                     F.array(*[F.lit(float(v)) for v in c]).alias("c"))
                            for k, c in enumerate(centres)])
    return F.transform(lit_centres, lambda e: F.struct(
        F.aggregate(F.zip_with(x, e["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                    lambda acc, t: acc + t).alias("d2"),
        e["k"].alias("k")))


def assign_clusters(df: DataFrame, cols: Sequence[str], centres: Sequence[Sequence[float]],
                    out_col: str = "cluster") -> DataFrame:
    """M8: nearest centre (squared Euclidean; ties → lowest index) and its distance².

    Centres are literals in the projection (k × d values), so no join is needed.
    """
    x = F.array(*[F.col(c).cast("double") for c in cols])
    best = F.array_min(_sqdist_to_each(x, centres))
    return df.select("*", best.alias("_best")).select(
        *[F.col(c) for c in df.columns], F.col("_best.k").alias(out_col),
        F.col("_best.d2").alias("dist2"))


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("dist2").alias("inertia"), F.count(F.lit(1)).alias("n"))


def total_sum_of_squares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M3 at k = 1: inertia of one cluster = Σ over columns of Σ (x - mean)².

    The means come from one aggregation; the sum of squares is a second one."""
    means = [mu for mu, _ in column_stats(df, cols)]
    total = None
    for c, mu in zip(cols, means):
        d = F.col(c).cast("double") - F.lit(float(mu) if mu is not None else 0.0)
        t = F.sum(d * d)
        total = t if total is None else total + t
    return df.agg(F.lit(1).alias("k"), total.alias("inertia"), F.count(F.lit(1)).alias("n"))


def silhouette_sq(df: DataFrame, cols: Sequence[str], cluster_col: str = "cluster",
                  per_row: bool = False) -> DataFrame:
    """M4 (exact, squared Euclidean, closed form).

    For x in cluster A, mean squared distance to cluster C is
    ||x||² − 2·x·S_C/n_C + Q_C/n_C with S_C = Σy, Q_C = Σ||y||²; a(x) excludes x
    itself (n_A − 1 in the denominator), b(x) is the smallest over C ≠ A, a row in a
    singleton cluster scores 0. Cluster statistics are k rows (a bounded scalar).
    """
    d = len(cols)
    norm = None
    for c in cols:
        t = F.col(c) * F.col(c)
        norm = t if norm is None else norm + t
    per_cluster = df.groupBy(F.col(cluster_col).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)],
        F.sum(norm).alias("q")).collect()   # k rows × (d + 3) numbers: bounded by k
    stats = F.array(*[F.struct(F.lit(r["k"]).alias("k"), F.lit(r["n"]).alias("n"),
                               F.array(*[F.lit(float(r[f"s{i}"])) for i in range(d)]).alias("s"),
                               F.lit(float(r["q"])).alias("q")) for r in per_cluster
                      if r["k"] is not None])
    x = F.array(*[F.col(c).cast("double") for c in cols])

    def mean_d2(e: Column) -> Column:
        dot = F.aggregate(F.sequence(F.lit(1), F.lit(d)), F.lit(0.0),
                          lambda acc, i: acc + F.element_at(x, i) * F.element_at(e["s"], i))
        return F.col("_nx") - 2 * dot / e["n"] + e["q"] / e["n"]

    rows = df.select("*", norm.alias("_nx"), stats.alias("_stats")).select(
        "*", F.transform(F.col("_stats"), lambda e: F.struct(e["k"].alias("k"), e["n"].alias("n"),
                                                   mean_d2(e).alias("m"))).alias("_d"))
    own = F.filter(F.col("_d"), lambda e: e["k"] == F.col(cluster_col))[0]
    others = F.filter(F.col("_d"), lambda e: e["k"] != F.col(cluster_col))
    a = own["m"] * own["n"] / (own["n"] - 1)
    b = F.array_min(F.transform(others, lambda e: e["m"]))
    s = F.when((own["n"] <= 1) | b.isNull(), F.lit(0.0)).otherwise(
        (b - a) / F.greatest(a, b))
    scored = rows.select(*[c for c in df.columns], s.alias("silhouette"))
    if per_row:
        return scored
    return scored.agg(F.avg("silhouette").alias("silhouette_sq"), F.count(F.lit(1)).alias("n"))


#: Seeds of the starts whose best is kept.
STARTS = tuple(range(SEED, SEED + 10))


# ---- fitted k-means ------------------------------------------------------------------
def fit_kmeans_many(std_df: DataFrame, cols: Sequence[str], ks: Sequence[int],
                    seeds: Sequence[int] = STARTS, max_iter: int = 300, tol: float = 1e-4) -> dict:
    """Fit every (k, seed) pair, all moving in the same scans (``kmeans_sweep``), and keep the
    cheapest start per k (ties → earlier seed). Returns {k: (set, cost, centres)}; without
    rows there is no fit."""
    if any(k < 2 for k in ks):
        raise ValueError("k >= 2; use total_sum_of_squares for k = 1")
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("x")
    vectors = std_df.select(x).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    best = kmeans_sweep.best_sets(kmeans_sweep.fit_sets(vectors, list(ks), [int(s) for s in seeds], max_iter, tol))
    return {k: (s, s.cost, s.centres.tolist()) for k, s in best.items()}


def fit_kmeans(std_df: DataFrame, cols: Sequence[str], k: int, seeds: Sequence[int] = STARTS,
               max_iter: int = 300, tol: float = 1e-4):
    """M2: best of several k-means|| starts by training cost. Returns (set, cost, centres)."""
    return fit_kmeans_many(std_df, cols, [k], seeds, max_iter, tol)[k]


def kmeans_labels(std_df: DataFrame, cols: Sequence[str], k: int = 4,
                  seeds: Sequence[int] = STARTS, max_iter: int = 300) -> DataFrame:
    """Rows with their k-means cluster (nearest fitted centre)."""
    _, _, centres = fit_kmeans(std_df, cols, k, seeds, max_iter)
    return assign_clusters(std_df, cols, centres)


def elbow(std_df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(1, 10),
          seeds: Sequence[int] = STARTS, max_iter: int = 300) -> DataFrame:
    """M3: (k, inertia); k = 1 is the exact total sum of squares, every other k one
    best-of-seeds fit (all fits share their scans)."""
    spark = std_df.sparkSession
    ks = list(ks)
    rows = []
    if 1 in ks:
        rows.append((1, float(total_sum_of_squares(std_df, cols).first()["inertia"])))
    fits = fit_kmeans_many(std_df, cols, [k for k in ks if k != 1], seeds, max_iter) if any(k != 1 for k in ks) else {}
    rows += [(int(k), float(fits[k][1])) for k in sorted(fits)]
    return spark.createDataFrame(rows, "k int, inertia double")


def silhouette_sweep(std_df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(2, 9),
                     seeds: Sequence[int] = STARTS, max_iter: int = 300,
                     parallelism: int = 4) -> DataFrame:
    """M4 sweep: (k, silhouette_sq) for each k, from one best-of-seeds fit per k."""
    from concurrent.futures import ThreadPoolExecutor
    spark = std_df.sparkSession
    fits = fit_kmeans_many(std_df, cols, list(ks), seeds, max_iter)
    persisted = std_df.select(*cols).persist()
    try:
        def sil(k):
            r = silhouette_sq(assign_clusters(persisted, cols, fits[k][2]), cols).first()
            return int(k), float(r["silhouette_sq"])
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(fits)))) as ex:
            rows = list(ex.map(sil, sorted(fits)))
    finally:
        persisted.unpersist()
    return spark.createDataFrame(rows, "k int, silhouette_sq double")


# ---- naming and profiles ------------------------------------------------------------
def name_clusters(assigned: DataFrame, spec: SurveySpec = DEFAULT_SPEC,
                  cluster_col: str = "cluster") -> DataFrame:
    """Each cluster takes the label of its majority given segment (tie →
    smallest key); unmapped keys give a null label. Adds ``Cluster_Label``."""
    names = group_mode(assigned, cluster_col, spec.segment_col).select(
        cluster_col, recode(spec.segment_col, spec.segment_labels).alias("Cluster_Label"))
    # k rows: a proven-size broadcast
    return assigned.join(F.broadcast(names), on=cluster_col, how="left")


def cluster_profile(named: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    """M6: segment profile grouped by cluster *name* (clusters sharing a name merge)."""
    return segment_profile(named, spec, label=F.col("Cluster_Label"), label_name="Cluster_Label")


def bundle_rates(named: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    """Module rates (×100) by cluster name, long form."""
    return crosstab_rates(named, "Cluster_Label", spec.module_cols, spec.module_names)


def cluster_points(named: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    """M7: the three plotted measures with the cluster name, every row."""
    return named.select(spec.id_col, spec.bargain, spec.too_expensive, spec.score_col, "Cluster_Label")
