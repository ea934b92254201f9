"""Physical-plan properties that matter at scale."""
from conftest import SF_SMALL


def _executed(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_survey_derivation_hash_aggregates_and_prunes(spark):
    from surveykit.sources.fixture import survey_frame
    df = survey_frame(spark, SF_SMALL)
    plan = _executed(df)
    assert "SortAggregate" not in plan
    assert "HashAggregate" in plan
    # line items: unused columns are never read
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan and "l_tax" not in plan


def test_pricing_histogram_is_partially_aggregated(spark):
    from surveykit.operators.pricing import vw_curves
    from surveykit.sources.fixture import survey_frame
    plan = vw_curves(survey_frame(spark, SF_SMALL))._jdf.queryExecution().optimizedPlan().toString()
    # one aggregate over the exploded (series, key) pairs, windows only above it
    assert plan.count("Aggregate") >= 1
    first_window = plan.find("Window")
    first_agg = plan.find("Aggregate")
    assert first_window < first_agg   # printed top-down: windows sit above the histogram


def test_standardisation_is_a_literal_projection(spark, survey_small):
    from surveykit.operators.cluster import standardize
    from surveykit.spec import KMEANS_FEATURES
    plan = standardize(survey_small, KMEANS_FEATURES)._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" not in plan.lower() and "Subquery" not in plan
