"""Descriptive aggregates (A1-A16), validation and profiling.

Every operator is one aggregation with map-side partial aggregation; group keys are
low-cardinality survey answers, and modes are computed as ``groupBy(value).count()``
followed by a global pick over the (small) distinct values, never by collecting a
group's raw rows.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import membership_class, recode, strip_prefix
from ..spec import (BRAND_CLASS_LABELS, BUDGET_BRANDS, CLASS_DIFF_POINTS, DEFAULT_SPEC,
                    SCORE_LABELS, SurveySpec)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- modes -----------------------------------------------------------------------
def _pick_mode(counts: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Highest count, then smallest key, among pre-counted (by, key, n) rows."""
    pick = F.min(F.struct((-F.col("n")).alias("neg_n"), F.col(key).alias("k")))
    return counts.groupBy(*by).agg(pick.alias("m")).select(
        *by, F.col("m.k").alias(key), (-F.col("m.neg_n")).alias("n"))


def mode(df: DataFrame, col: str) -> DataFrame:
    """Global mode (A4): one row (col, n). Null values are not candidates."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return _pick_mode(counts, col)


def group_mode(df: DataFrame, by: str | Sequence[str], col: str) -> DataFrame:
    """Mode of ``col`` within each group (A5): (by..., col, n); null keys dropped."""
    by = [by] if isinstance(by, str) else list(by)
    keyed = df.where(F.col(col).isNotNull())
    for b in by:
        keyed = keyed.where(F.col(b).isNotNull())
    counts = keyed.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    return _pick_mode(counts, col, by)


# ---- headline numbers --------------------------------------------------------------
def kpis(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    """A1: rows, intent %, mean score, top brand, top concern (without 'The ')."""
    top_brand = mode(df, spec.brand_col).select(spec.brand_col).scalar()
    top_concern = mode(df, spec.concern_col).select(strip_prefix(spec.concern_col)).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.avg(spec.target_col) * 100).alias("intent_pct"),
        F.avg(spec.score_col).cast("double").alias("avg_score"),
    ).select("*", top_brand.alias("top_brand"), top_concern.alias("top_concern"))


def freq(df: DataFrame, col: str, label_map: dict | None = None,
         label_col: str = "label") -> DataFrame:
    """A2: value counts, null keys dropped, with share of non-null rows; optional label."""
    keyed = df.where(F.col(col).isNotNull())
    counts = keyed.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = keyed.agg(F.count(F.lit(1))).scalar()   # one-row aggregate, no global window
    out = counts.select(col, "n", (F.col("n") / total).alias("share"))
    if label_map is not None:
        out = out.withColumn(label_col, recode(F.col(col), label_map))
    return out


def segment_freq(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    return freq(df, spec.segment_col, spec.segment_labels)


def brand_freq_typed(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    out = df.where(F.col(spec.brand_col).isNotNull()).groupBy(spec.brand_col) \
        .agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("brand_type", membership_class(
        spec.brand_col, BUDGET_BRANDS, BRAND_CLASS_LABELS[0], BRAND_CLASS_LABELS[1]))


def score_hist(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    out = df.where(F.col(spec.score_col).isNotNull()).groupBy(spec.score_col) \
        .agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("label", recode(spec.score_col, SCORE_LABELS))


def flag_rates(df: DataFrame, cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean of each flag ×100 (nulls skipped, as a column mean does), long form."""
    wide = df.agg(*[(F.avg(c) * 100).alias(c) for c in cols])
    entries = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column_name"),
                        F.lit(nm).alias("name"), F.col(c).cast("double").alias("rate_pct"))
               for i, (c, nm) in enumerate(zip(cols, names))]
    return wide.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def friction_rates(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    return flag_rates(df, spec.friction_cols, spec.friction_names)


def module_rates(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    return flag_rates(df, spec.module_cols, spec.module_names)


def group_rate(df: DataFrame, by: str, col: str) -> DataFrame:
    """Per group mean of ``col`` and its non-null count; null keys dropped."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.avg(col).cast("double").alias("rate"), F.count(col).alias("n"))


def year_rate(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    return group_rate(df, spec.year_col, spec.target_col)


def crosstab_rates(df: DataFrame, by: str | Column, cols: Sequence[str],
                   names: Sequence[str], by_name: str | None = None) -> DataFrame:
    """A8 + R1: per group mean ×100 of many columns, long (group, column, name, rate_pct)."""
    key = _c(by)
    by_name = by_name or (by if isinstance(by, str) else "group")
    wide = df.where(key.isNotNull()).groupBy(key.alias(by_name)).agg(
        *[(F.avg(c) * 100).alias(c) for c in cols])
    entries = [F.struct(F.lit(c).alias("column_name"), F.lit(nm).alias("name"),
                        F.col(c).cast("double").alias("rate_pct"))
               for c, nm in zip(cols, names)]
    return wide.select(by_name, F.explode(F.array(*entries)).alias("r")).select(by_name, "r.*")


def style_module_rates(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    return crosstab_rates(df, spec.style_col, spec.module_cols, spec.module_names)


def segment_profile(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC,
                    label: Column | None = None, label_name: str = "segment_label") -> DataFrame:
    """By segment *label* (two keys with one label merge): mean bargain price,
    mean too-expensive price, mean score, intent rate, n."""
    label = label if label is not None else recode(spec.segment_col, spec.segment_labels)
    return df.withColumn(label_name, label).where(F.col(label_name).isNotNull()) \
        .groupBy(label_name).agg(
            F.avg(spec.bargain).alias("bargain_price"),
            F.avg(spec.too_expensive).alias("max_price"),
            F.avg(spec.score_col).cast("double").alias("avg_score"),
            F.avg(spec.target_col).cast("double").alias("intent_rate"),
            F.count(F.lit(1)).alias("n"))


def segment_profile_text(profile: DataFrame, label_name: str = "segment_label") -> DataFrame:
    """Display form of A9 (P11): '$' + truncated 2-decimal mean, intent as '%.1f%%'."""
    r2 = lambda c: F.bround(F.col(c), 2)  # noqa: E731  pandas .round(2) is half-even
    return profile.select(
        label_name,
        F.concat(F.lit("$"), r2("bargain_price").cast("int").cast("string")).alias("bargain_text"),
        F.concat(F.lit("$"), r2("max_price").cast("int").cast("string")).alias("max_price_text"),
        r2("avg_score").alias("score_2dp"),
        F.concat(F.format_string("%.1f", F.bround(r2("intent_rate") * 100, 1)), F.lit("%"))
        .alias("intent_text"))


def price_by_segment(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC,
                     decimals: int | None = None) -> DataFrame:
    """A10: mean of the four prices per segment key (+label), bargain desc."""
    rnd = (lambda c: F.bround(c, decimals)) if decimals is not None else (lambda c: c)
    out = df.where(F.col(spec.segment_col).isNotNull()).groupBy(spec.segment_col).agg(
        *[rnd(F.avg(c)).alias(c) for c in spec.price_cols])
    return out.withColumn("label", recode(spec.segment_col, spec.segment_labels)) \
        .orderBy(F.desc(spec.bargain), spec.segment_col)


def segment_intent(df: DataFrame, segment_key: str, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    """Intent rate (×100) of one segment key: one row."""
    sel = F.col(spec.segment_col) == segment_key
    return df.agg(
        F.lit(segment_key).alias("segment"),
        (F.avg(F.when(sel, F.col(spec.target_col))) * 100).alias("intent_pct"),
        F.count_if(sel).alias("n"))


def top_item(df: DataFrame, cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The column with the largest sum; ties → first declared position."""
    sums = df.agg(*[F.sum(c).cast("bigint").alias(c) for c in cols])
    entries = [F.struct((-F.coalesce(F.col(c), F.lit(0))).alias("neg"), F.lit(i).alias("pos"),
                        F.lit(c).alias("column_name"), F.lit(nm).alias("name"),
                        F.col(c).alias("n_chosen")) for i, (c, nm) in enumerate(zip(cols, names))]
    return sums.select(F.array_min(F.array(*entries)).alias("t")).select(
        "t.column_name", "t.name", "t.n_chosen")


def class_distribution(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    """A3: share (%) of each target class among non-null targets."""
    keyed = df.where(F.col(spec.target_col).isNotNull())
    counts = keyed.groupBy(F.col(spec.target_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = keyed.agg(F.count(F.lit(1))).scalar()
    return counts.select("label", "n", (F.col("n") / total * 100).alias("pct"))


def class_balance(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC,
                  max_diff: float = CLASS_DIFF_POINTS) -> DataFrame:
    """Class-1 and class-0 shares, their ratio (null when class 0 is absent) and
    the balance verdict ``|pct1 - pct0| < max_diff`` (strict)."""
    y = F.col(spec.target_col)
    n = F.count(y)
    p1 = F.count_if(y == 1) / n * 100
    p0 = F.count_if(y == 0) / n * 100
    out = df.agg(p1.alias("pct_1"), p0.alias("pct_0"))
    return out.select("pct_1", "pct_0",
                      F.try_divide(F.col("pct_1"), F.when(F.col("pct_0") != 0, F.col("pct_0")))
                      .alias("ratio"),
                      F.abs(F.col("pct_1") - F.col("pct_0")).alias("abs_diff"),
                      (F.abs(F.col("pct_1") - F.col("pct_0")) < max_diff).alias("balanced"))


# ---- validation and profiling --------------------------------------------------------
def _validation(df: DataFrame, spec: SurveySpec) -> tuple[list[Column], list[Column]]:
    """S2 as aggregates over ``df`` and as the report's entries over their one row."""
    checks: list[tuple[str, str, Column]] = []
    flags = [*spec.friction_cols, *spec.module_cols, spec.target_col]
    for c in flags:
        checks.append((c, "flag_0_1", ~F.col(c).isin(0, 1)))
    checks.append((spec.score_col, "range_1_5", ~F.col(spec.score_col).between(1, 5)))
    for c in spec.price_cols:
        checks.append((c, "positive", F.col(c) <= 0))
    checks.append((spec.segment_col, "known_key",
                   ~F.col(spec.segment_col).isin(list(spec.segment_labels))))
    required = [spec.segment_col, spec.year_col, spec.brand_col, spec.style_col,
                *spec.friction_cols, spec.score_col, *spec.module_cols, spec.concern_col,
                *spec.price_cols, spec.target_col]
    for c in required:
        checks.append((c, "not_null", F.col(c).isNull()))
    present = set(df.columns)
    ok = [(c, r, e) for c, r, e in checks if c in present]
    missing = [(c, "present") for c in required if c not in present]
    aggs = [F.count_if(F.coalesce(e, F.lit(False))).alias(f"c{i}") for i, (_, _, e) in enumerate(ok)]
    entries = [F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("rule"),
                        F.col(f"c{i}").cast("bigint").alias("n_bad")) for i, (c, r, _) in enumerate(ok)]
    entries += [F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("rule"),
                         F.lit(-1).cast("bigint").alias("n_bad")) for c, r in missing]
    return aggs, entries


def _profile(df: DataFrame, numeric_cols: Sequence[str] | None) -> tuple[list[Column], list[Column]]:
    """S3 as aggregates over ``df`` and as the profile's entries over their one row."""
    if numeric_cols is None:
        numeric_cols = [f.name for f in df.schema.fields
                        if f.dataType.typeName() in ("integer", "long", "double", "float", "short")]
    aggs = []
    for i, c in enumerate(numeric_cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.count_if(x.isNull()).alias(f"m{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"mu{i}"),
                 F.stddev_samp(x).alias(f"sd{i}"), F.skewness(x).alias(f"sk{i}")]
    entries = []
    for i, c in enumerate(numeric_cols):
        n = F.col(f"n{i}").cast("double")
        adj = F.when((n > 2) & (F.col(f"sd{i}") > 0),
                     F.col(f"sk{i}") * F.sqrt(n * (n - 1)) / (n - 2))
        entries.append(F.struct(
            F.lit(i).alias("pos"), F.lit(c).alias("column_name"),
            F.col(f"n{i}").cast("bigint").alias("n"), F.col(f"m{i}").cast("bigint").alias("n_missing"),
            F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), F.col(f"mu{i}").alias("mean"),
            F.col(f"sd{i}").alias("stddev"), adj.alias("skewness")))
    return aggs, entries


def _report(wide: DataFrame, entries: list[Column]) -> DataFrame:
    return wide.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def validate_survey(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC) -> DataFrame:
    """(column, rule, n_bad) in one pass. A missing column reports n_bad = -1."""
    aggs, entries = _validation(df, spec)
    return _report(df.agg(*aggs) if aggs else df.agg(F.count(F.lit(1)).alias("_n")), entries)


def profile_survey(df: DataFrame, numeric_cols: Sequence[str] | None = None) -> DataFrame:
    """S3: per numeric column n, missing, min, max, mean, sample std and sample-adjusted
    skewness, one aggregation, long form."""
    aggs, entries = _profile(df, numeric_cols)
    return _report(df.agg(*aggs), entries)


def write_checked(df: DataFrame, path: str, spec: SurveySpec = DEFAULT_SPEC,
                  numeric_cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """S2 and S3 in the same pass as the write: (validation, profile) of the rows written.

    The checks are metrics observed while ``df`` is written as Parquet to ``path``, so
    reading, checking, profiling and writing cost one scan; what reaches the driver is one
    number per check. An existing path is an error.
    """
    checks, rules = _validation(df, spec)
    numbers, columns = _profile(df, numeric_cols)
    parts = [(aggs, entries) for aggs, entries in ((checks, rules), (numbers, columns)) if entries]
    seen = [Observation() for _ in parts]
    watched = df
    for observation, (aggs, _) in zip(seen, parts):
        watched = watched.observe(observation, *(aggs or [F.count(F.lit(1)).alias("_n")]))
    watched.write.parquet(path)
    reports = []
    for observation, (aggs, entries) in zip(seen, parts):
        schema = df.agg(*(aggs or [F.count(F.lit(1)).alias("_n")])).schema
        got = observation.get
        reports.append(_report(df.sparkSession.createDataFrame([tuple(got[f.name] for f in schema)], schema), entries))
    if len(reports) == 1:  # no numeric column
        reports.append(None)
    return reports[0], reports[1]


#: Rows between a rank's two bounds that are counted value by value.
BRACKET_ROWS = 100_000


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], error: float = 0.001,
                    bracket_rows: int = BRACKET_ROWS) -> list:
    """Exact interpolated quantiles (the ``percentile`` / ``quantile_cont`` definition).

    A mergeable quantile sketch (rank error ``error``) bounds the value of each rank from
    both sides; one aggregation counts the rows before and inside all bounds, which proves
    them right or sends that rank back to the whole range. Bounds with up to ``bracket_rows``
    rows inside are resolved by counting their values, wider ones are sketched again over
    their own rows. Nulls are left out, NaN is the greatest value, an empty column gives
    nulls. Nothing is shuffled but partial sketches, counts and the values inside the bounds.
    """
    x = F.col(col).cast("double")
    rows = df.select(x.alias("v")).where(F.col("v").isNotNull())
    real = rows.where(~F.isnan("v"))
    n, m, low, high = rows.agg(F.count("*"), F.count_if(~F.isnan("v")), F.min("v"),
                               F.max(F.when(~F.isnan("v"), F.col("v")))).first()
    if not n:
        return [None for _ in probs]
    places = [(p * (n - 1), int(p * (n - 1) // 1), int(-(-(p * (n - 1)) // 1))) for p in probs]
    wanted = sorted({r for _, lo, hi in places for r in (lo, hi)})
    value = {r: float("nan") for r in wanted if r >= m}
    # rank -> bounds, rows before the lower one, rows inside
    open_ranks = {r: (low, high, 0, m) for r in wanted if r < m}
    while open_ranks:
        for r, (lo, hi, _, _) in list(open_ranks.items()):
            if lo == hi:
                value[r] = lo
                del open_ranks[r]
        few = {r: b for r, b in open_ranks.items() if b[3] <= bracket_rows}
        if few:
            spans = sorted({(b[0], b[1]) for b in few.values()})
            inside = real.where(reduce(or_, [F.col("v").between(lo, hi) for lo, hi in spans]))
            counts = inside.groupBy("v").agg(F.count("*").alias("c")).collect()
            for r, (lo, hi, before, _) in few.items():
                for v, c in sorted((row["v"], row["c"]) for row in counts if lo <= row["v"] <= hi):
                    before += c
                    if before > r:
                        value[r] = v
                        break
                del open_ranks[r]
        if not open_ranks:
            break
        narrower = {}
        by_span: dict = {}
        for r, bounds in open_ranks.items():
            by_span.setdefault(bounds, []).append(r)
        for (lo, hi, before, size), ranks in by_span.items():
            at = [min(max((r - before) / size + side * 2 * error, 0.0), 1.0) for r in ranks for side in (-1, 1)]
            found = real.where(F.col("v").between(lo, hi)).approxQuantile("v", at, error)
            narrower.update({r: (found[2 * i], found[2 * i + 1]) for i, r in enumerate(ranks)})
        order = list(narrower)
        sums = real.agg(*[F.count_if(F.col("v") < narrower[r][0]) for r in order],
                        *[F.count_if(F.col("v") <= narrower[r][1]) for r in order]).first()
        for i, r in enumerate(order):
            before, upto = sums[i], sums[len(order) + i]
            old = open_ranks[r]
            if not before <= r < upto or upto - before >= old[3]:
                # the sketch missed, or one value fills the bounds: halve the range instead
                narrower[r] = _halved(real, r, old)
                continue
            narrower[r] = (*narrower[r], before, upto - before)
        open_ranks = narrower
    out = []
    for q, lo, hi in places:
        a, b = value[lo], value[hi]
        out.append(a if lo == hi else (hi - q) * a + (q - lo) * b)
    return out


def _halved(real: DataFrame, rank: int, bounds: tuple) -> tuple:
    """The side of the middle of ``bounds`` that holds ``rank``; both ends become values that occur."""
    lo, hi, _, _ = bounds
    middle = lo / 2 + hi / 2
    if not lo <= middle < hi:  # neighbouring numbers
        middle = lo
    v = F.col("v")
    left, before, upto, left_high, right_low = real.agg(
        F.count_if(v <= middle), F.count_if(v < lo), F.count_if(v <= hi),
        F.max(F.when(v.between(lo, middle), v)), F.min(F.when((v > middle) & (v <= hi), v))).first()
    if rank < left:
        return lo, left_high, before, left - before
    return right_low, hi, left, upto - left
