"""Survey readers (S1, S5): CSV with a header or Parquet, typed by name."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import survey_schema

# ---- fixed values: cell texts that spreadsheet exports and data-frame readers use for "missing" ----
MISSING = ("", "#N/A", "#NA", "-NaN", "-nan", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# ---- end of fixed values ---------------------------------------------------------------------------


def _present(c: Column) -> Column:
    """The cell, or null where its text stands for a missing value."""
    text = F.trim(c.cast("string"))
    return F.when(~text.isin(*MISSING), text)


def _typed(c: Column, kind: T.DataType) -> Column:
    """The cell as ``kind``; null where it cannot be read as such (``1.0`` is an integer)."""
    text = _present(c)
    if isinstance(kind, T.StringType):
        return text
    number = text.try_cast("double")
    number = F.when(~F.isnan(number), number)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        whole = F.coalesce(text.try_cast("bigint"), F.when(number == F.floor(number), number).try_cast("bigint"))
        return whole.try_cast(kind)
    return number.cast(kind)


def _raw(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", False).csv(path)
    return spark.read.format(fmt).load(path)


def read_survey(spark: SparkSession, path: str, fmt: str = "csv", key: Sequence[str] = ()) -> DataFrame:
    """Read a survey file and type the known columns by *name*.

    A cell that is missing (``NA``, ``NaN``, empty, ...) or cannot be read as its column's
    type is null; ``rejected_cells`` counts the latter. Extra columns are kept as read. A
    missing ``respondent_id`` is made from the ``key`` columns, or else the whole row, by
    hash; equal rows are numbered, so the id does not depend on how the file is split.
    Missing survey columns are reported by ``validate_survey``, not here.
    """
    return typed_survey(_raw(spark, path, fmt), key)


def typed_survey(raw: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Columns of text as ``read_survey`` types them."""
    schema = {f.name: f.dataType for f in survey_schema().fields}
    df = raw.select(*[_typed(F.col(f"`{c}`"), schema[c]).alias(c) if c in schema else F.col(f"`{c}`")
                      for c in raw.columns])
    if "respondent_id" not in df.columns:
        names = list(key) or raw.columns
        row = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in names])
        rest = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in raw.columns])
        df = df.withColumn("_hash", row).withColumn("_rest", rest)
        number = F.row_number().over(Window.partitionBy("_hash").orderBy("_rest"))
        df = df.withColumn("respondent_id", F.when(number == 1, F.col("_hash")).otherwise(
            F.xxhash64("_hash", number))).drop("_hash", "_rest")
    return df


def rejected_cells(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """(column_name, n_rejected): cells that hold a text their column's type cannot read."""
    raw = _raw(spark, path, fmt)
    schema = {f.name: f.dataType for f in survey_schema().fields}
    known = [c for c in raw.columns if c in schema]
    bad = raw.agg(*[F.count_if(_present(F.col(f"`{c}`")).isNotNull() & _typed(F.col(f"`{c}`"), schema[c]).isNull())
                    .cast("bigint").alias(c) for c in known])
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_rejected")) for c in known]
    return bad.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def survey_rows(spark: SparkSession, rows: Sequence[Sequence], columns: Sequence[str]) -> DataFrame:
    """Literal respondent rows (e.g. a live-predictor profile) typed like the survey."""
    known = {f.name: f.dataType for f in survey_schema().fields}
    schema = T.StructType([T.StructField(c, known.get(c, T.StringType()), True) for c in columns])
    conv = [(float if isinstance(f.dataType, T.DoubleType) else
             int if isinstance(f.dataType, (T.IntegerType, T.LongType)) else str) for f in schema.fields]
    typed = [tuple(None if v is None else cv(v) for v, cv in zip(r, conv)) for r in rows]
    return spark.createDataFrame(typed, schema)
