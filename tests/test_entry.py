"""Driver contract: entry runs, every query has a stored schema."""
import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_and_contract(spark):
    m = load_entry()
    df = m.entry(spark)
    rows = df.collect()
    assert [r["point"] for r in rows] and set(df.columns) == {"point", "standard_name", "grid_idx", "price"}
    q, sql = m.queries(), m.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 60


def test_streaming_scoring(spark, survey_small, tmp_path):
    from surveykit.operators import classify as C
    from surveykit.streaming.scoring import start_scoring
    model = C.fit_tree(C.feature_vectors(survey_small))
    src = str(tmp_path / "in")
    survey_small.limit(40).write.parquet(src)
    q = start_scoring(model, spark, src, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 40
    assert set(out.columns) >= {"respondent_id", "score", "prediction", "intent_band"}
