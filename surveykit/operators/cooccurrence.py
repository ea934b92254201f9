"""Item co-occurrence of long baskets (J2, B6): a sparse XᵀX without a wide table.

A basket's distinct items are cut into segments of bounded size, and pairs are formed between
segments, so a basket that holds a third of all items is spread over many tasks like any other
rows. Segments are dealt by (basket, pair of segments); pair counts are summed map-side before
their shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Items of a segment (in the mean, for baskets that have several), and over how many keys the
#: rows of one basket are spread while its segments are made.
SEGMENT_ITEMS, SPREAD = 128, 64


def basket_items(df: DataFrame, basket_col: str, item_col: str) -> DataFrame:
    """Distinct (basket, item); rows without a basket or an item hold nothing."""
    rows = df.select(F.col(f"`{basket_col}`").alias("basket"), F.col(f"`{item_col}`").alias("item"))
    return rows.where(F.col("basket").isNotNull() & F.col("item").isNotNull()).distinct()


def basket_segments(items: DataFrame, segment_items: int = SEGMENT_ITEMS, spread: int = SPREAD) -> DataFrame:
    """(basket, segment, segments, items): each basket's items, dealt by hash into segments.

    Baskets with more than ``segment_items`` items have several. They are found by a count that
    is summed map-side, and meet their rows over ``spread`` keys each.
    """
    large = items.groupBy("basket").agg(F.count("*").alias("size")).where(F.col("size") > segment_items)
    large = large.select("basket", F.ceil(F.col("size") / segment_items).cast("int").alias("segments"),
                         F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("key"))
    keyed = items.select("basket", "item", F.pmod(F.xxhash64("item"), F.lit(spread)).cast("int").alias("key"))
    several = keyed.join(large, ["basket", "key"], "left").select(
        "basket", "item", F.coalesce("segments", F.lit(1)).alias("segments"))
    place = F.pmod(F.xxhash64(F.lit("segment"), "item"), F.col("segments")).cast("int")
    return several.groupBy("basket", "segments", place.alias("segment")).agg(F.collect_list("item").alias("items"))


def segment_pairs(segments: DataFrame) -> DataFrame:
    """(a, b): the item lists of two segments of one basket, each unordered pair of segments once."""
    one = segments.where("segments = 1").select(F.col("items").alias("a"), F.col("items").alias("b"), F.lit(True).alias("same"))
    several = segments.where("segments > 1")
    seats = F.sequence(F.lit(0), F.col("segments") - 1)
    # every segment goes to the pairs it is part of; each pair is a key of its own
    dealt = several.select("basket", "segment", "items", F.explode(seats).alias("other")).select(
        "basket", F.least("segment", "other").alias("low"), F.greatest("segment", "other").alias("high"),
        (F.col("segment") <= F.col("other")).alias("first"), "items")
    low = F.max(F.when(F.col("first"), F.col("items")))
    met = dealt.groupBy("basket", "low", "high").agg(
        low.alias("a"), F.max(F.when(~F.col("first") | (F.col("low") == F.col("high")), F.col("items"))).alias("b"))
    met = met.where(F.col("a").isNotNull() & F.col("b").isNotNull())  # a segment may have drawn no item
    return one.unionByName(met.select("a", "b", (F.col("low") == F.col("high")).alias("same")))


def pair_counts(items: DataFrame, segment_items: int = SEGMENT_ITEMS) -> DataFrame:
    """(item_a, item_b, n) with item_a < item_b: baskets that hold both."""
    pairs = segment_pairs(written(basket_segments(items, segment_items), "segments"))
    each = pairs.select(F.explode("a").alias("x"), "b", "same")
    each = each.select("x", "same", F.explode("b").alias("y"))
    each = each.where((~F.col("same") & (F.col("x") != F.col("y"))) | (F.col("x") < F.col("y")))
    return each.groupBy(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")).agg(F.count("*").alias("n"))


def long_cooccurrence(df: DataFrame, basket_col: str, item_col: str, segment_items: int = SEGMENT_ITEMS) -> DataFrame:
    """J2/B6 for long baskets: (item_a, item_b, n), both ways round, for the pairs that meet.

    What meets nowhere, and the diagonal, is zero and has no row. Repeated rows count once; rows
    without a basket or an item are ignored; an empty table gives an empty one.
    """
    half = pair_counts(basket_items(df, basket_col, item_col), segment_items)
    both = F.array(F.struct(F.col("item_a").alias("item_a"), F.col("item_b").alias("item_b")),
                   F.struct(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b")))
    return half.select(F.explode(both).alias("pair"), "n").select("pair.*", "n")
