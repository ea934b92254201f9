"""Prescriptive layer (D1-D4): evidence, recommendation facts, report tables, routing.

One-row results are combined with scalar subqueries (each a single aggregate), never
by collecting to the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import write_results  # noqa: F401  (S6 re-export)
from ..spec import DEFAULT_SPEC, SurveySpec
from . import baskets as B
from . import describe as A

ELITE = "Elite_Enthusiast"


def intent_routing(scored: DataFrame, pred: str = "prediction") -> DataFrame:
    """High-intent visitors go to the pre-order page, the rest to nurture content."""
    band = F.when(F.col(pred) == 1, "high").otherwise("low")
    return scored.withColumn("intent_band", band).withColumn(
        "route", F.when(F.col(pred) == 1, "pre_order").otherwise("education"))


def _test_accuracy(metrics: DataFrame):
    return metrics.where(F.col("split") == "test").select(F.col("accuracy") * 100).scalar()


def evidence(df: DataFrame, points: DataFrame, metrics: DataFrame, segment_key: str = ELITE,
             spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    """Optimal price (reference 'opp'), overall intent %, one segment's intent %, the
    most-chosen module, test accuracy %. One row."""
    opp = points.where(F.col("point") == "opp").select("price").scalar()
    seg = A.segment_intent(df, segment_key, spec).select("intent_pct").scalar()
    top = A.top_item(df, spec.module_cols, spec.module_names).select("name").scalar()
    return df.agg((F.avg(spec.target_col) * 100).alias("intent_pct")).select(
        opp.alias("optimal_price"), "intent_pct", seg.alias("segment_intent_pct"),
        top.alias("top_module"), _test_accuracy(metrics).alias("test_accuracy"))


def recommendation_facts(df: DataFrame, points: DataFrame, metrics: DataFrame,
                         segment_key: str = ELITE, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    """The numbers behind each recommendation, long (rec_id, fact, value, text).

    The module recommendation uses the top module's *own* rate and lists every module
    in demand order (rank 1 = most chosen; ties by declared position)."""
    pr = points.groupBy().agg(*[F.max(F.when(F.col("point") == p, F.col("price"))).alias(p)
                                for p in ("opp", "iap", "pmc", "pme")])
    ev = evidence(df, points, metrics, segment_key, spec)
    price = pr.select(F.explode(F.array(*[
        F.struct(F.lit(1).alias("rec_id"), F.lit(f"price_{p}").alias("fact"),
                 F.col(p).alias("value"), F.lit(None).cast("string").alias("text"))
        for p in ("opp", "pmc", "pme")])).alias("r")).select("r.*")
    other = ev.select(F.explode(F.array(
        F.struct(F.lit(2).alias("rec_id"), F.lit("segment_intent_pct").alias("fact"),
                 F.col("segment_intent_pct").alias("value"), F.lit(segment_key).alias("text")),
        F.struct(F.lit(2).alias("rec_id"), F.lit("overall_intent_pct").alias("fact"),
                 F.col("intent_pct").alias("value"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit(5).alias("rec_id"), F.lit("test_accuracy").alias("fact"),
                 F.col("test_accuracy").alias("value"), F.lit(None).cast("string").alias("text")),
    )).alias("r")).select("r.*")
    rates = A.module_rates(df, spec)
    from pyspark.sql import Window
    ranked = rates.select(F.lit(3).alias("rec_id"),
                          F.concat(F.lit("module_rank_"),
                                   F.row_number().over(Window.orderBy(F.desc("rate_pct"), "pos"))
                                   .cast("string")).alias("fact"),
                          F.col("rate_pct").alias("value"), F.col("name").alias("text"))
    return price.unionByName(other).unionByName(ranked)


def report_tables(df: DataFrame, scored: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> dict:
    """D3: the report's tables, all computed (the segment table included)."""
    from . import metrics as M
    from . import pricing as V
    rules = B.survey_rules(df, spec)
    return {
        "kpis": A.kpis(df, spec),
        "segments": A.segment_profile(df, spec),
        "segment_prices": A.price_by_segment(df, spec),
        "price_points": V.vw_points(df, spec),
        "top_rules": B.top_rules(rules, 8).select(
            F.substring("antecedents_text", 1, 38).alias("antecedents"),
            F.substring("consequents_text", 1, 32).alias("consequents"),
            "support", "confidence", "lift"),
        "rule_kpis": B.rule_kpis(rules),
        "model_metrics": M.model_metrics(scored),
    }
