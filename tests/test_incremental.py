"""Checks made in the pass of the write, and price curves that grow batch by batch."""
import pytest
from pyspark.sql import functions as F

from surveykit.operators import describe as A
from surveykit.operators import pricing as V
from surveykit.plans.contract import S
from surveykit.sources.fixture import with_gaps
from surveykit.streaming.curves import CurveState, maintain_curves

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("kind", ["whole", "empty", "columns missing"])
def test_write_checked_equals_separate_passes(spark, tmp_path, kind):
    df = with_gaps(S(spark, SF)).withColumn("Q8_Price_Too_Cheap", F.when(F.col("respondent_id") % 7 == 0, -1.0).otherwise(F.col("Q8_Price_Too_Cheap")))
    df = df.limit(0) if kind == "empty" else df.drop("Segment", "Q4_Friction_Wobble") if kind == "columns missing" else df
    path = str(tmp_path / "out")
    rules, profile = A.write_checked(df, path)
    assert rows_of(rules) == rows_of(A.validate_survey(df))
    key = lambda r: r["pos"]
    for got, want in zip(sorted(profile.collect(), key=key), sorted(A.profile_survey(df).collect(), key=key), strict=True):
        for a, b in zip(got, want, strict=True):
            assert a == (pytest.approx(b, rel=1e-9) if isinstance(b, float) else b)
    assert rows_of(spark.read.parquet(path)) == rows_of(df)


def test_curves_of_batches_equal_the_whole(spark, tmp_path):
    df = with_gaps(S(spark, SF))
    for by in ([], ["Segment"]):
        state = CurveState(spark, str(tmp_path / f"state{len(by)}"), by=by)
        with pytest.raises(ValueError):
            state.curves()
        for i in range(4):
            state.update(df.where(F.col("respondent_id") % 4 == i), i)
        state.update(df.where("respondent_id % 4 = 2"), 2)   # a replay
        state.update(df.limit(0), 4)
        whole = rows_of(V.vw_curves(df, by=by))
        assert rows_of(state.curves()) == whole
        for upto in (1, 3):
            state.compact(upto)
            state.update(df, upto)   # a replay of what is folded in
            assert rows_of(state.curves()) == whole


def test_stream_resumes(spark, tmp_path):
    df = S(spark, SF)
    state = CurveState(spark, str(tmp_path / "state"))

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        maintain_curves(stream, state, str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()

    for half in (0, 1):
        df.where(F.col("respondent_id") % 2 == half).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    run()
    assert rows_of(state.curves()) == rows_of(V.vw_curves(df))
