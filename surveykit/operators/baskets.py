"""Market-basket analysis.

Three ways to count itemsets:

* flag columns (a handful of items): each respondent becomes a bitmask, respondents
  are pre-aggregated per (group, mask) with a partial/final count, and only the
  distinct masks (at most 2^m per group) are expanded into their sub-itemsets, so a
  hot group costs nothing extra.
* many flag columns: level by level, every group at its own threshold (``wide_itemsets``).
* array baskets of any width: Spark ML ``FPGrowth`` (parallel FP-growth); its result is
  re-filtered with exact integer arithmetic so support boundaries never depend on a
  rounding bit.

Rules are generated from *every* non-empty proper subset of each frequent itemset
(multi-item consequents included), joined to the itemset counts on sorted-array keys.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import band, flag
from ..session import written
from ..spec import DEFAULT_SPEC, LIFT_BAND_ELSE, LIFT_BANDS, MIN_LIFT, MIN_SUPPORT, SurveySpec
from .wide_itemsets import wide_itemsets

#: Flag columns up to which itemsets are counted by bitmask.
MASK_COLUMNS = 16
_SCALE = 1_000_000  # thresholds are compared as integers in millionths


def _ppm(x: float) -> int:
    return int(round(x * _SCALE))


def _dec(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def to_baskets(df: DataFrame, cols: Sequence[str], names: Sequence[str],
               id_col: str | None = None, null_as: bool = False) -> DataFrame:
    """B1: flag columns → (id, items) with items sorted; an all-zero row keeps ``[]``."""
    chosen = F.array(*[F.when(flag(c, null_as), F.lit(nm)) for c, nm in zip(cols, names)])
    items = F.array_sort(F.filter(chosen, lambda x: x.isNotNull()))
    keep = [id_col] if id_col else []
    return df.select(*keep, items.alias("items"))


def _mask(cols: Sequence[str], null_as: bool) -> Column:
    m = F.lit(0).cast("bigint")
    for i, c in enumerate(cols):
        m = m + F.when(flag(c, null_as), F.lit(1 << i)).otherwise(0).cast("bigint")
    return m


def _names_of(mask: Column, names: Sequence[str]) -> Column:
    catalog = F.array(*[F.struct(F.lit(1 << i).cast("bigint").alias("bit"), F.lit(nm).alias("name"))
                        for i, nm in enumerate(names)])
    picked = F.filter(catalog, lambda e: (mask.bitwiseAND(e["bit"])) != 0)
    return F.array_sort(F.transform(picked, lambda e: e["name"]))


def mask_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                null_as: bool = False) -> DataFrame:
    """(by..., mask, cnt): respondents pre-aggregated by their chosen-item bitmask."""
    return df.select(*by, _mask(cols, null_as).alias("mask")) \
        .groupBy(*by, "mask").agg(F.count(F.lit(1)).alias("cnt"))


def frequent_itemsets_flags(df: DataFrame, cols: Sequence[str], names: Sequence[str],
                            min_support: float = MIN_SUPPORT, by: Sequence[str] = (),
                            null_as: bool = False) -> DataFrame:
    """B2 on flag columns: (by..., items, size, freq, n, support) with support >= min.

    A few columns are counted by bitmask; many are mined level by level, each group at its
    own threshold.
    """
    by = list(by)
    if len(cols) > MASK_COLUMNS:
        return wide_itemsets(df, cols, names, min_support, by, null_as)
    return _itemsets_from_masks(mask_counts(df, cols, by, null_as), names, min_support, by)


def _itemsets_from_masks(mc: DataFrame, names: Sequence[str], min_support: float,
                         by: Sequence[str] = ()) -> DataFrame:
    """(by..., mask, cnt) → frequent itemsets: each distinct mask (≤ 2^m per group)
    expands into its non-empty sub-masks (of its set bits only), counts are summed per
    sub-mask."""
    by = list(by)
    bits = F.filter(F.lit([1 << i for i in range(len(names))]).cast("array<bigint>"),
                    lambda b: b.bitwiseAND(F.col("mask")) != 0)
    one = F.lit(1).cast("bigint")
    numbers = F.sequence(one, F.call_function("shiftleft", one, F.size(bits)) - 1)
    subs = F.when(F.col("mask") != 0, F.transform(numbers, lambda s: F.aggregate(
        F.transform(bits, lambda b, i: F.when(F.call_function("shiftright", s, i).bitwiseAND(one) != 0, b)
                    .otherwise(F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"), lambda a, b: a + b)))
    w = Window.partitionBy(*by)
    with_n = mc.select(*by, "mask", "cnt", F.sum("cnt").over(w).alias("n"))
    exploded = with_n.select(*by, "n", "cnt", F.explode(subs).alias("sub"))
    counted = exploded.groupBy(*by, "sub").agg(F.sum("cnt").alias("freq"), F.max("n").alias("n"))
    kept = counted.where(_dec(F.col("freq")) * _SCALE >= _dec(F.col("n")) * _ppm(min_support))
    return kept.select(*by, _names_of(F.col("sub"), names).alias("items"),
                       F.bit_count("sub").cast("int").alias("size"),
                       F.col("freq").cast("bigint").alias("freq"), F.col("n").cast("bigint").alias("n"),
                       (F.col("freq") / F.col("n")).alias("support"))


def frequent_itemsets(baskets: DataFrame, min_support: float = MIN_SUPPORT,
                      items_col: str = "items", num_partitions: int | None = None) -> DataFrame:
    """B2 for array baskets: FP-growth → (items, size, freq, n, support).

    Empty baskets count in ``n``; null items and repeats inside a basket do not count.
    FPGrowth runs a hair below the threshold and the exact integer test is applied
    afterwards. The baskets are held while they are counted and mined, and the itemsets
    are written once: rule assembly reads them three times.
    """
    from pyspark.ml.fpm import FPGrowth

    items = F.array_compact(F.array_distinct(F.coalesce(F.col(items_col), F.array().cast("array<string>"))))
    data = baskets.select(items.alias("items")).persist()
    try:
        n = data.count()
        fp = FPGrowth(itemsCol="items", minSupport=max(min_support - 1e-9, 0.0), minConfidence=0.0)
        if num_partitions:
            fp = fp.setNumPartitions(num_partitions)
        mined = written(fp.fit(data).freqItemsets.select(
            F.array_sort("items").alias("items"), F.col("freq").cast("bigint")), "itemsets")
    finally:
        data.unpersist()
    fi = mined.withColumn("n", F.lit(n).cast("bigint"))
    return fi.where(_dec(F.col("freq")) * _SCALE >= _dec(F.col("n")) * _ppm(min_support)).select(
        "items", F.size("items").cast("int").alias("size"), "freq", "n",
        (F.col("freq") / F.col("n")).alias("support"))


def association_rules(itemsets: DataFrame, min_lift: float = MIN_LIFT,
                      by: Sequence[str] = ()) -> DataFrame:
    """Rules from every non-empty proper subset split of each frequent itemset.

    Output: (by..., antecedents, consequents, antecedent_support, consequent_support,
    support, confidence, lift, leverage, conviction, freq, n); kept when
    lift >= ``min_lift`` (tested exactly as f(AC)·n >= min_lift·f(A)·f(C)).
    """
    by = list(by)
    big = itemsets.where(F.col("size") >= 2)
    one = F.lit(1).cast("bigint")
    bit = lambda i: F.call_function("shiftleft", one, i)
    splits = F.sequence(one, bit(F.col("size")) - 2)
    sp = big.select(*by, "items", "freq", "n", F.explode(splits).alias("split"))
    idx = F.sequence(F.lit(0), F.size("items") - 1)
    pick = lambda inside: F.transform(
        F.filter(idx, lambda i: (bit(i).bitwiseAND(F.col("split")) != 0) == inside),
        lambda i: F.element_at(F.col("items"), i + 1))
    sp = sp.select(*by, pick(True).alias("antecedents"), pick(False).alias("consequents"),
                   F.col("freq").alias("f_ac"), "n")
    lookup = itemsets.select(*by, "items", "freq")
    a = lookup.select(*by, F.col("items").alias("antecedents"), F.col("freq").alias("f_a"))
    c = lookup.select(*by, F.col("items").alias("consequents"), F.col("freq").alias("f_c"))
    j = sp.join(a, on=[*by, "antecedents"]).join(c, on=[*by, "consequents"])
    j = j.where(_dec(F.col("f_ac")) * _dec(F.col("n")) * _SCALE
                >= _dec(F.col("f_a")) * _dec(F.col("f_c")) * _ppm(min_lift))
    s_ac = F.col("f_ac") / F.col("n")
    s_a = F.col("f_a") / F.col("n")
    s_c = F.col("f_c") / F.col("n")
    conf = s_ac / s_a
    return j.select(
        *by, "antecedents", "consequents",
        s_a.alias("antecedent_support"), s_c.alias("consequent_support"),
        s_ac.alias("support"), conf.alias("confidence"), (conf / s_c).alias("lift"),
        (s_ac - s_a * s_c).alias("leverage"),
        F.when(conf < 1, (1 - s_c) / (1 - conf)).alias("conviction"),
        F.col("f_ac").cast("bigint").alias("freq"), F.col("n").cast("bigint").alias("n"))


def survey_rules(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC,
                 min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT,
                 by: Sequence[str] = (), null_as: bool = False) -> DataFrame:
    its = frequent_itemsets_flags(df, spec.module_cols, spec.module_names, min_support, by, null_as)
    return association_rules(its, min_lift, by)


def rules_by_segment(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC,
                     min_support: float = 0.08, min_lift: float = MIN_LIFT,
                     null_as: bool = False) -> DataFrame:
    """Every segment mined at its own threshold in one job (null keys dropped)."""
    seg = df.where(F.col(spec.segment_col).isNotNull())
    return survey_rules(seg, spec, min_support, min_lift, [spec.segment_col], null_as)


def filter_rules(rules: DataFrame, min_confidence: float = 0.45,
                 min_lift: float = MIN_LIFT) -> DataFrame:
    """Confidence >= c AND lift >= l (inclusive)."""
    return rules.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))


def rule_text(rules: DataFrame) -> DataFrame:
    """Add display text: items joined with ' + '."""
    return rules.withColumn("antecedents_text", F.array_join("antecedents", " + ")) \
        .withColumn("consequents_text", F.array_join("consequents", " + "))


def top_rules(rules: DataFrame, k: int = 12) -> DataFrame:
    """The k highest-lift rules; ties broken by the item texts."""
    return rule_text(rules).orderBy(F.desc("lift"), "antecedents_text", "consequents_text").limit(k)


def rule_kpis(rules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of rules, maximum lift, mean confidence (null when there are none)."""
    return rules.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rules"), F.max("lift").alias("max_lift"),
                                  F.avg("confidence").alias("mean_confidence"))


def rule_bands(rules: DataFrame) -> DataFrame:
    """Lift band (>= 1.3 strong, >= 1.1 moderate, else weak) + display texts."""
    return rule_text(rules).withColumn("lift_band", band("lift", LIFT_BANDS, LIFT_BAND_ELSE))


def cooccurrence(df: DataFrame, cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """XᵀX of the flag columns in one aggregation, zero diagonal, long form
    (item_a, item_b, n). Null flags contribute nothing."""
    m = len(cols)
    aggs = [F.sum(F.coalesce(F.col(cols[i]) * F.col(cols[j]), F.lit(0))).cast("bigint").alias(f"p{i}_{j}")
            for i in range(m) for j in range(i + 1, m)]
    wide = df.agg(*aggs)
    entries = []
    for i in range(m):
        for j in range(m):
            val = F.lit(0).cast("bigint") if i == j else F.col(f"p{min(i, j)}_{max(i, j)}")
            entries.append(F.struct(F.lit(names[i]).alias("item_a"), F.lit(names[j]).alias("item_b"),
                                    val.alias("n")))
    return wide.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def cooccurrence_matrix(co: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long co-occurrence → square view (item_a, one column per item)."""
    return co.groupBy("item_a").pivot("item_b", list(names)).agg(F.first("n"))


def rules_view(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC, segment_label: str | None = None,
               min_confidence: float = 0.45, min_lift: float = MIN_LIFT, k: int | None = 12,
               all_support: float = MIN_SUPPORT, segment_support: float = 0.08) -> DataFrame:
    """F4 + B5: the rule list a user browses. ``segment_label=None`` ("All Segments") mines
    every respondent at ``all_support``; a label is mapped back to its key (P4), its
    respondents are mined alone at ``segment_support``. Then confidence/lift filter and top-k."""
    from ..functions.columns import reverse_lookup
    if segment_label is None:
        rules = survey_rules(df, spec, all_support, MIN_LIFT)
    else:
        key = reverse_lookup(spec.segment_labels, segment_label)
        rules = survey_rules(df.where(F.col(spec.segment_col) == F.lit(key)), spec,
                             segment_support, MIN_LIFT)
    out = filter_rules(rules, min_confidence, min_lift)
    return top_rules(out, k) if k else rule_text(out)


def long_to_baskets(df: DataFrame, basket_col: str, item_col: str) -> DataFrame:
    """B1 (long form): (basket, item) rows → (basket_id, items sorted, distinct).

    Rows are de-duplicated per (basket, item) first (a partial aggregation), so a basket
    holding a third of all rows still reaches its task as at most one row per item."""
    pairs = df.where(F.col(item_col).isNotNull()).select(
        F.col(basket_col).alias("basket_id"), F.col(item_col).alias("item")).distinct()
    return pairs.groupBy("basket_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
