"""The whole dashboard's computations as one call over a survey DataFrame.

This is the entry a user of the original dashboard switches to: upload → every
analysis. It returns lazily planned DataFrames (plus the eager model fits, which
Spark ML runs as jobs), ready for ``write_results``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import baskets as B
from ..operators import classify as C
from ..operators import cluster as K
from ..operators import decide as D
from ..operators import describe as A
from ..operators import metrics as M
from ..operators import pricing as V
from ..spec import DEFAULT_SPEC, KMEANS_K, SurveySpec


def compute_all(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC, k: int = KMEANS_K,
                seeds=K.STARTS, num_trees: int = 300, max_depth: int = C.MAX_DEPTH,
                elbow_ks=range(1, 10), silhouette_ks=range(2, 9), folds: int = 5,
                kmeans_max_iter: int = 300, boosted_iter: int = 100) -> dict[str, DataFrame]:
    """Descriptive tables, price curves and points, rules and co-occurrence, k-means
    segmentation (labels, elbow, silhouettes, named profiles), forest and tree models
    (metrics, ROC, importances, rules, CV) and the evidence tables."""
    feats = spec.kmeans_features
    z = K.standardize(df, feats, keep=df.columns, suffix="_z")
    zcols = [f"{c}_z" for c in feats]
    _, _, centres = K.fit_kmeans(z, zcols, k, seeds, kmeans_max_iter)
    labelled = K.assign_clusters(z, zcols, centres)
    named = K.name_clusters(labelled, spec)     # all survey columns ride along: no join back

    data = C.feature_vectors(C.stratified_split_exact(df, spec), spec)
    train = data.where(F.col("split") == "train")
    forest = C.fit_forest(train, spec, num_trees, max_depth)
    tree = C.fit_tree(train)
    boosted = C.fit_boosted(train, max_iter=boosted_iter)
    f_scored = C.score(forest, data)
    t_scored = C.score(tree, data)
    b_metrics = M.model_metrics(C.score(boosted, data))
    f_metrics = M.model_metrics(f_scored)
    t_metrics = M.model_metrics(t_scored)
    rules = B.survey_rules(df, spec)
    points = V.vw_points(df, spec)

    return {
        "kpis": A.kpis(df, spec),
        "segment_freq": A.segment_freq(df, spec),
        "brand_freq": A.brand_freq_typed(df, spec),
        "score_hist": A.score_hist(df, spec),
        "friction_rates": A.friction_rates(df, spec),
        "module_rates": A.module_rates(df, spec),
        "year_rate": A.year_rate(df, spec),
        "style_module_rates": A.style_module_rates(df, spec),
        "price_by_segment": A.price_by_segment(df, spec),
        "vw_curves": V.vw_curves(df, spec),
        "vw_points": points,
        "vw_range": V.vw_range(points),
        "rules": B.rule_text(rules),
        "rule_kpis": B.rule_kpis(rules),
        "cooccurrence": B.cooccurrence(df, spec.module_cols, spec.module_names),
        "clusters": named.select(spec.id_col, "cluster", "Cluster_Label"),
        "cluster_profile": K.cluster_profile(named, spec),
        "bundle_rates": K.bundle_rates(named, spec),
        "elbow": K.elbow(z, zcols, elbow_ks, seeds, kmeans_max_iter),
        "silhouette": K.silhouette_sweep(z, zcols, silhouette_ks, seeds, kmeans_max_iter),
        "forest_metrics": f_metrics,
        "forest_confusion": M.confusion(f_scored, by=["split"]),
        "forest_report": M.class_report(f_scored.where(F.col("split") == "test")),
        "forest_roc": M.roc_points(f_scored.where(F.col("split") == "test")),
        "forest_importances": C.tercile_band(C.importances(forest, spec), "importance"),
        "tree_metrics": t_metrics,
        "tree_rules": C.tree_rules(tree, train, spec),
        "compare_models": M.compare_models({"decision_tree": t_metrics, "random_forest": f_metrics,
                                            "boosted_trees": b_metrics}),
        "overfit": M.overfit_check(f_metrics),
        "class_balance": A.class_balance(df, spec),
        "cv_auc": C.cross_validate(df, spec, folds, num_trees, max_depth),
        "evidence": D.evidence(df, points, M.binary_metrics(f_scored, by=["split"]), spec=spec),
    }
