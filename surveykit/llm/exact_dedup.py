"""Exact deduplication by progressive refinement.

Rows are compared by length first, then by the hash of a short prefix, and only rows
that still share both with another row are compared by the digest of the full text.
What is shuffled is (id, length, prefix hash, digest), never a text; every grouping
pre-aggregates, so a text with a third of all copies is one row per task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, temp_name

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. The smallest id of equal texts stays (null when all ids
    are null); of repeated rows with that very id one stays. Extra columns are ignored.
    """
    text = normalised(F.col(f"`{text_col}`"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.length(text).alias("len"),
                     F.xxhash64(F.substring(text, 1, prefix_chars)).alias("head"),
                     F.sha2(text, 256).alias("digest"))
    several = lambda by, frame: frame.groupBy(*by).count().where("count > 1").select(*by)
    by_len = several(["len"], rows)
    by_head = several(["len", "head"], rows.join(by_len, "len", "left_semi"))
    groups = (rows.join(by_head, ["len", "head"], "left_semi")
              .groupBy("len", "head", "digest").agg(F.min("id").alias("keep"), F.count("*").alias("n")))
    # repeated (id, text) rows are told apart by their ordinal only
    same = rows.groupBy("len", "head", "digest", "id").agg(F.count("*").alias("copies"))
    joined = same.join(groups, ["len", "head", "digest"], "left")
    each = joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("ordinal"))
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return each.select(
        F.col("id").alias("doc_id"), keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(keep) & (F.col("ordinal") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; groups without any id keep one row."""
    own, keep_id, keep_sha = (temp_name(df, x) for x in ("sha", "keep_id", "keep_sha"))
    kept = exact_groups(df, id_col, text_col).where("kept").select(
        F.col("doc_id").alias(keep_id), F.col("text_sha256").alias(keep_sha))
    out = df.withColumn(own, F.sha2(normalised(F.col(f"`{text_col}`")), 256))
    out = out.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col(keep_id)) & (F.col(own) == F.col(keep_sha)), "left_semi")
    return out.dropDuplicates([id_col, own]).drop(own)
