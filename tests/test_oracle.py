"""Every SQL-checkable contract query equals its DuckDB twin (sf0.001)."""
import pytest

from surveykit.plans.contract import QUERIES, ROWS_ONLY
from surveykit.plans.contract_sql import SQL
from surveykit.plans.schemas import load, wrap_rounding

from conftest import SF_SMALL

CHECKED = [n for n in QUERIES if n in SQL and n not in ROWS_ONLY]


def test_every_query_has_a_twin_or_is_rows_only():
    missing = [n for n in QUERIES if n not in SQL and n not in ROWS_ONLY]
    assert missing == []


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_twin(spark, duck_small, name):
    from surveykit.plans.check import compare
    df = QUERIES[name](spark, SF_SMALL)
    stored = load().get(name)
    assert stored == [[f.name, f.dataType.simpleString()] for f in df.schema.fields]
    res = compare(df, wrap_rounding(name, SQL[name]), duck_small)
    assert res["match"], res


@pytest.mark.parametrize("name", ["vw_curves", "vw_points", "rules", "silhouette_fixed", "roc_points",
                                  "auc", "assign_fixed_centroids", "order_rules", "event_rules"])
def test_plans_stay_in_the_jvm(spark, name):
    """No Python UDF in any plan; the pricing histogram never windows raw rows."""
    df = QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
