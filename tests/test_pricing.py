"""Van Westendorp operators on hand-written micro-frames, checked by brute force."""
import numpy as np
import pytest

from surveykit.operators import pricing as V
from surveykit.spec import SurveySpec

SPEC = SurveySpec()
COLS = list(SPEC.price_cols)


def frame(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLS))


def brute(rows, lo=5.0, hi=700.0, n=600):
    grid = [lo + i * ((hi - lo) / (n - 1)) for i in range(n)]
    out = {}
    for s, k, d in [("too_cheap", 0, "ge"), ("bargain", 1, "ge"), ("expensive", 2, "le"),
                    ("too_expensive", 3, "le")]:
        hits = []
        for g in grid:
            c = sum(1 for r in rows if r[k] is not None and ((r[k] >= g) if d == "ge" else (r[k] <= g)))
            hits.append(c)
        out[s] = hits
    return out, grid


def curves_of(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["series"], {})[r["grid_idx"]] = r["hits"]
    return {s: [v[i] for i in range(len(v))] for s, v in got.items()}


def test_price_grid_matches_linspace(spark):
    g = [r["price"] for r in V.price_grid(spark).orderBy("grid_idx").collect()]
    ref = np.linspace(5, 700, 600)
    assert len(g) == 600
    assert np.max(np.abs(np.array(g) - ref)) < 1e-9
    assert g[0] == 5.0


def test_curves_edge_values(spark):
    step = 695 / 599
    on_grid = 5 + 10 * step
    rows = [(on_grid, on_grid, on_grid, on_grid), (1.0, 2.0, 3.0, 4.0), (900.0, 800.0, 750.0, 701.0),
            (None, None, None, None), (5.0, 700.0, 5.0, 700.0), (100.0, 150.0, 200.0, 300.0)]
    df = frame(spark, rows)
    got = curves_of(V.vw_curves(df, SPEC))
    ref, _ = brute(rows)
    for s in ref:
        assert got[s] == ref[s], s
    n = {r["n"] for r in V.vw_curves(df, SPEC).collect()}
    assert n == {6}  # null prices stay in the denominator


def test_random_frame_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [tuple(float(x) for x in np.round(rng.lognormal(5, 0.6, 4), 2)) for _ in range(300)]
    df = frame(spark, rows)
    got = curves_of(V.vw_curves(df, SPEC))
    ref, _ = brute(rows)
    for s in ref:
        assert got[s] == ref[s]


def test_never_crossing_gives_null_and_null_range(spark):
    # too-cheap always above expensive -> opp never crosses
    rows = [(800.0, 800.0, 900.0, 900.0)] * 3
    pts = {r["point"]: r["price"] for r in V.vw_points(frame(spark, rows), SPEC).collect()}
    assert pts["opp"] is None
    rng = V.vw_range(V.vw_points(frame(spark, rows), SPEC)).first()
    if pts["pmc"] is None or pts["pme"] is None:
        assert rng["low"] is None and rng["high"] is None


def test_equal_at_start_returns_first_index(spark):
    # all-zero differences from the first grid point: d0*d1 = 0 -> index 0
    rows = [(1.0, 1.0, 1000.0, 1000.0)]
    pts = {r["point"]: r["grid_idx"] for r in V.vw_points(frame(spark, rows), SPEC).collect()}
    assert pts["opp"] == 0 and pts["pme"] == 0


def test_inverted_range_flag(spark):
    from pyspark.sql import functions as F
    pts = spark.createDataFrame([("pmc", 157.0), ("pme", 128.0)], "point string, price double")
    r = V.vw_range(pts).first()
    assert r["inverted"] is True and r["low"] == 128.0 and r["high"] == 157.0
    del F


def test_fixture_points_sf001(spark):
    from surveykit.sources.fixture import survey_frame
    pts = {r["point"]: r["price"] for r in V.vw_points(survey_frame(spark, "/root/testdata/sf0.01")).collect()}
    assert pts["opp"] == pytest.approx(160.475793, abs=1e-6)
    assert pts["iap"] == pytest.approx(279.983306, abs=1e-6)
    assert pts["pmc"] == pytest.approx(195.283806, abs=1e-6)
    assert pts["pme"] == pytest.approx(248.656093, abs=1e-6)


def test_crossing_of_two_series_equals_named_point(spark):
    from surveykit.sources.fixture import survey_frame
    df = survey_frame(spark, "/root/testdata/sf0.001")
    curves = V.vw_curves(df, SPEC)
    c = V.vw_crossing(curves, "too_cheap", "expensive").first()
    pts = {r["point"]: (r["grid_idx"], r["price"]) for r in V.vw_points(df, SPEC, curves=curves).collect()}
    assert (c["grid_idx"], c["price"]) == pts["opp"]


def test_curves_by_segment_sum_to_overall(spark):
    from pyspark.sql import functions as F
    from surveykit.sources.fixture import survey_frame
    df = survey_frame(spark, "/root/testdata/sf0.001")
    by = V.vw_curves(df, SPEC, by=["Segment"]).groupBy("series", "grid_idx").agg(F.sum("hits").alias("h"))
    allc = V.vw_curves(df, SPEC).select("series", "grid_idx", F.col("hits").alias("h"))
    assert by.exceptAll(allc).count() == 0 and allc.exceptAll(by).count() == 0
