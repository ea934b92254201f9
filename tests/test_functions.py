"""Column helpers."""
from pyspark.sql import functions as F

from surveykit.functions import columns as X


def test_recode_unknown_and_null_give_null(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    got = [r[0] for r in df.select(X.recode("k", {"a": "Alpha"})).collect()]
    assert got == ["Alpha", None, None]
    assert X.reverse_lookup({"a": "Alpha"}, "Alpha") == "a" and X.reverse_lookup({}, "x") is None


def test_band_membership_flag_and_texts(spark):
    df = spark.createDataFrame([(1.35, "Kia", 1, 0.5125), (1.1, "Audi", None, 0.1), (0.9, None, 0, 1.0)],
                               "lift double, brand string, f int, r double")
    rows = df.select(
        X.band("lift", [(1.3, "strong"), (1.1, "moderate")], "weak").alias("b"),
        X.membership_class("brand", ["Kia"], "budget", "premium").alias("m"),
        X.flag("f").alias("f0"), X.flag("f", null_as=True).alias("f1"),
        X.percent(F.col("r"), 1).alias("p"), X.percent_text(F.col("r") * 100).alias("pt"),
        X.money_text(F.col("lift") * 100).alias("mt"), X.count_text(F.lit(1234567)).alias("ct"),
        X.strip_prefix(F.lit("The Noise")).alias("sp"),
        X.items_text(F.array(F.lit("b"), F.lit("a"))).alias("it"),
        X.truncate_text(F.lit("abcdef"), 3).alias("tt")).collect()
    assert [r["b"] for r in rows] == ["strong", "moderate", "weak"]
    assert [r["m"] for r in rows] == ["budget", "premium", "premium"]
    assert [r["f0"] for r in rows] == [True, False, False] and [r["f1"] for r in rows] == [True, True, False]
    assert rows[0]["p"] == 51.2            # half-to-even, like pandas round
    assert rows[0]["pt"] == "51.2%"      # 0.5125 * 100 is 51.2499... in binary
    assert rows[0]["mt"] == "$135" and rows[0]["ct"] == "1,234,567"
    assert rows[0]["sp"] == "Noise" and rows[0]["it"] == "a + b" and rows[0]["tt"] == "abc"


def test_share_true_counts_nulls_in_denominator(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert df.agg(X.share_true(F.col("x") >= 2)).first()[0] == 1 / 3
