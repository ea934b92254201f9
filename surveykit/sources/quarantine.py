"""S1 with rejects kept: a CSV survey's lines are accepted or set aside with file, line and reason."""
from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .survey import typed_survey

REASONS = ("other header", "repeated header", "blank line", "open quote", "too few cells", "too many cells")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the split), at (order inside the split), text; one row per line."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))


def _plain(text: Column) -> Column:
    """A line without a byte-order mark and trailing white space."""
    return F.regexp_replace(text, r"^\uFEFF|\s+$", "")


def read_survey_checked(spark: SparkSession, path: str, key: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a CSV file or folder whose files share one header.

    accepted: typed as by ``read_survey``. rejected: file, line (from 1, the header's), reason (of
    ``REASONS``, the first that holds) and the line's text. Accepted rows, rejected rows and
    the header line of each file that begins with it make up all lines. The header is the first line of the first file by name; a
    file that begins otherwise is rejected whole. A cell can't span lines: its quote is open.
    An empty folder raises ValueError, as a header with a repeated or an empty name does.

    One row per split is written (its line count); line numbers are made for rejected rows only.
    """
    lines = _lines(spark, path)
    blocks = lines.groupBy("file", "start").agg(F.min("at").alias("first_at"), F.count("*").alias("n"),
                                                F.min_by("text", "at").alias("first"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(blocks.select("file", "start", "first_at", _plain(F.when(F.col("start") == 0, F.col("first"))).alias("first"),
                                   F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "blocks")
    top = blocks.where("start = 0").orderBy("file").select("first").first()
    if top is None:
        raise ValueError(f"no line in {path}")
    header = top["first"]
    names = next(csv.reader([header]), [])
    if not all(names) or len({n.lower() for n in names}) < len(names):
        raise ValueError("the header has a repeated or an empty name")

    broken = "_line"
    while broken in names:
        broken += "_"
    quoted = lambda n: "`" + n.replace("`", "``") + "`"
    schema = ", ".join(f"{quoted(n)} string" for n in [*names, broken])
    cells = F.from_csv("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken})
    others = blocks.where((F.col("start") == 0) & (F.col("first") != header)).select("file", F.lit(True).alias("other"))
    judged = lines.withColumn("cells", cells)
    judged = judged.withColumn("other", F.lit(None).cast("boolean")) if others.isEmpty() else judged.join(others, "file", "left")
    quotes = F.length(F.regexp_replace(F.regexp_replace("text", r"\\.", ""), '[^"]', ""))
    commas = F.length(F.regexp_replace(F.regexp_replace("text", r'"(?:[^"\\]|\\.)*"', ""), "[^,]", ""))
    judged = judged.withColumn("reason", F.when(F.col("other"), REASONS[0]).when(_plain(F.col("text")) == header, REASONS[1])
                               .when(F.trim("text") == "", REASONS[2]).when(quotes % 2 == 1, REASONS[3])
                               .when(F.col(f"cells.{quoted(broken)}").isNotNull(), F.when(commas < len(names) - 1, REASONS[4]).otherwise(REASONS[5])))
    accepted = judged.where("reason is null").select(*[F.col(f"cells.{quoted(n)}").alias(n) for n in names])
    rejected = judged.where("reason is not null").select("file", "start", "at", "text", "reason").join(blocks, ["file", "start"])
    rejected = rejected.select("file", (F.col("before") + F.col("at") - F.col("first_at") + 1).alias("line"), "reason", "text")
    return typed_survey(accepted, key), rejected.where((F.col("line") > 1) | (F.col("reason") != REASONS[1]))
