"""Readers, literal rows, validation and sinks."""
from surveykit.operators import describe as A
from surveykit.sources.survey import read_survey, survey_rows
from surveykit.spec import SURVEY_COLUMNS, SurveySpec


def test_csv_round_trip_types_by_name_and_keeps_extra_columns(spark, survey_small, tmp_path):
    p = str(tmp_path / "survey_csv")
    survey_small.drop("respondent_id").withColumn("Trim", survey_small["Segment"]) \
        .write.option("header", True).csv(p)
    df = read_survey(spark, p, "csv")
    assert "Trim" in df.columns and "respondent_id" in df.columns
    types = dict(df.dtypes)
    assert types["Q9_Price_Bargain"] == "double" and types["Q5_Rattle_Severity_Scale"] == "int"
    assert df.count() == survey_small.count()
    bad = {(r["column_name"], r["rule"]): r["n_bad"] for r in A.validate_survey(df).collect()}
    assert bad[("Q5_Rattle_Severity_Scale", "range_1_5")] == 0


def test_csv_with_gaps_and_bad_cells(spark, tmp_path):
    from surveykit.sources.survey import rejected_cells
    p = tmp_path / "survey.csv"
    p.write_text("Segment,Q5_Rattle_Severity_Scale,Q9_Price_Bargain,Q6_Module_Tray\n"
                 "Elite_Enthusiast,3.0,NaN,1.0\nNA,NA,12.5,0.0\n,x,oops,1\nTech_Purist,2.5,,N/A\nTech_Purist,2.5,,N/A\n")
    df = read_survey(spark, str(p), "csv")
    rows = [(r["Segment"] or "", r["Q5_Rattle_Severity_Scale"], r["Q9_Price_Bargain"], r["Q6_Module_Tray"]) for r in df.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [("", None, 12.5, 0), ("", None, None, 1), ("Elite_Enthusiast", 3, None, 1),
                                                      ("Tech_Purist", None, None, None), ("Tech_Purist", None, None, None)]))
    ids = {r["respondent_id"] for r in df.collect()}
    assert len(ids) == 5 and ids == {r["respondent_id"] for r in read_survey(spark, str(p), "csv").repartition(3).collect()}
    bad = {r["column_name"]: r["n_rejected"] for r in rejected_cells(spark, str(p)).collect()}
    assert bad == {"Segment": 0, "Q5_Rattle_Severity_Scale": 3, "Q9_Price_Bargain": 1, "Q6_Module_Tray": 0}
    assert A.validate_survey(df).count() > 0


def test_validate_reports_missing_and_bad_values(spark):
    cols = ["respondent_id", "Segment", "Q5_Rattle_Severity_Scale", "Q9_Price_Bargain"]
    df = survey_rows(spark, [[1, "Elite_Enthusiast", 7, -3.0], [2, "Other", 3, 10.0]], cols)
    bad = {(r["column_name"], r["rule"]): r["n_bad"] for r in A.validate_survey(df, SurveySpec()).collect()}
    assert bad[("Q5_Rattle_Severity_Scale", "range_1_5")] == 1
    assert bad[("Q9_Price_Bargain", "positive")] == 1
    assert bad[("Segment", "known_key")] == 1
    assert bad[("Q12_Reserve_Slot_Intent", "present")] == -1


def test_mode_tie_takes_smallest_key(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "x string")
    r = A.mode(df, "x").first()
    assert r["x"] == "a" and r["n"] == 2


def test_write_results(spark, survey_small, tmp_path):
    from surveykit.sources.sinks import write_results
    out = write_results({"kpis": A.kpis(survey_small), "seg": A.segment_freq(survey_small)},
                        str(tmp_path / "report")).collect()
    assert {r["table"]: r["rows"] for r in out} == {"kpis": 1, "seg": 5}


def test_live_predictor(spark, survey_small):
    from surveykit.operators import classify as C
    model = C.fit_tree(C.feature_vectors(survey_small))
    spec = SurveySpec()
    profile = dict(zip(spec.model_features, [4, 1, 1, 0, 1, 1, 0, 0, 1, 0, 60.0, 140.0, 240.0, 380.0]))
    r = C.predict_profile(model, spark, profile).first()
    assert 0.0 <= r["score"] <= 1.0 and r["intent_band"] in ("high", "low")
    assert len(SURVEY_COLUMNS) == 21
