"""Streaming scoring (M13/D4 on Structured Streaming).

Scoring is a row-wise ``transform`` of a fitted pipeline, so the same operator runs
on a streaming DataFrame of new survey rows: file source → feature vector → model →
intent band → file sink, with a checkpoint in the shared checkpoint folder so a lost
executor or a restarted query resumes exactly once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.classify import feature_vectors, score
from ..spec import DEFAULT_SPEC, SurveySpec, survey_schema


def read_survey_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(survey_schema()).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def score_stream(model, stream: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    """New respondents → (respondent_id, score, prediction, intent_band, route)."""
    from ..operators.decide import intent_routing
    scored = score(model, feature_vectors(stream, spec))
    return intent_routing(scored).select(spec.id_col, "score", "prediction", "intent_band", "route")


def start_scoring(model, spark: SparkSession, in_path: str, out_path: str, checkpoint: str,
                  fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Run the scoring stream into a parquet sink (append, exactly-once via checkpoint)."""
    scored = score_stream(model, read_survey_stream(spark, in_path, fmt))
    w = scored.writeStream.format("parquet").option("path", out_path) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
