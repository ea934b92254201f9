"""Van Westendorp price sensitivity (V1-V5).

V1 replaces the reference's 4 × 600 full passes by one pass: every respondent price is
mapped to the number of grid points it passes, the four series are counted in one
partial/final aggregation (at most 4 × 601 groups per key), and the curves are prefix
or suffix sums over that small histogram. Raw rows never meet a window.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..spec import DEFAULT_SPEC, GRID_HI, GRID_LO, GRID_N, SurveySpec

# series name, spec attribute, direction: "ge" = share(price >= p), "le" = share(price <= p)
SERIES = (("too_cheap", "too_cheap", "ge"), ("bargain", "bargain", "ge"),
          ("expensive", "expensive", "le"), ("too_expensive", "too_expensive", "le"))

# (point, reference pairing, standard van Westendorp name of that pairing)
POINTS = (
    ("opp", ("too_cheap", "expensive"), "point_of_marginal_cheapness"),
    ("iap", ("bargain", "too_expensive"), "point_of_marginal_expensiveness"),
    ("pmc", ("bargain", "expensive"), "indifference_price_point"),
    ("pme", ("too_cheap", "too_expensive"), "optimal_price_point"),
)


def _step(lo: float, hi: float, n: int) -> float:
    return (hi - lo) / (n - 1)


def grid_value(idx: Column, lo: float = GRID_LO, hi: float = GRID_HI, n: int = GRID_N) -> Column:
    return F.lit(float(lo)) + idx.cast("double") * F.lit(_step(lo, hi, n))


def price_grid(spark: SparkSession, lo: float = GRID_LO, hi: float = GRID_HI,
               n: int = GRID_N) -> DataFrame:
    """``n`` evenly spaced prices from ``lo`` to ``hi``."""
    idx = F.col("id").cast("int")
    return spark.range(n).select(idx.alias("grid_idx"), grid_value(idx, lo, hi, n).alias("price"))


def _count_passed_sql(x: str, strict: bool, lo: float, hi: float, n: int) -> str:
    """SQL for the number of grid points g with g <= x (or g < x when ``strict``), exact.

    The arithmetic guess can be one off at a grid point; it is fixed against the exact
    grid value so equality behaves like an element-wise compare. Built as one SQL
    expression (one round trip to the JVM instead of dozens of Column calls)."""
    step = repr(_step(lo, hi, n))
    lo_s = repr(float(lo))
    guess = f"ceil(({x} - {lo_s}) / {step})" if strict else f"floor(({x} - {lo_s}) / {step}) + 1"
    c0 = f"CAST(least(greatest({guess}, 0), {n}) AS INT)"
    grid = lambda i: f"({lo_s} + CAST({i} AS DOUBLE) * {step})"
    below = (lambda g: f"{g} < {x}") if strict else (lambda g: f"{g} <= {x}")
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN CAST(NULL AS INT) "
            f"WHEN {c0} < {n} AND {below(grid(c0))} THEN {c0} + 1 "
            f"WHEN {c0} > 0 AND NOT ({below(grid(f'{c0} - 1'))}) THEN {c0} - 1 "
            f"ELSE {c0} END")


def vw_curves(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC, lo: float = GRID_LO,
              hi: float = GRID_HI, n: int = GRID_N, by: Sequence[str] = ()) -> DataFrame:
    """Four curves on the grid, long form: (*by, series, grid_idx, price, hits, n, pct).

    ``pct`` = share of *all* rows of the group (null prices count in the denominator
    only) meeting the series comparison at that grid price, ×100.
    """
    return curves_of_histogram(price_histogram(df, spec, lo, hi, n, by), lo, hi, n, by)


def price_histogram(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC, lo: float = GRID_LO,
                    hi: float = GRID_HI, n: int = GRID_N, by: Sequence[str] = ()) -> DataFrame:
    """(*by, series, key, cnt): the curves' state. Histograms of parts add up to that of the whole."""
    by = list(by)
    entries = []
    for name, attr, direction in SERIES:
        x = f"CAST(`{getattr(spec, attr)}` AS DOUBLE)"
        c = _count_passed_sql(x, strict=(direction == "le"), lo=lo, hi=hi, n=n)
        # ge: counted at grid_idx < c  -> key the last index c-1
        # le: counted at grid_idx >= c -> key the first index c
        key = f"({c}) - 1" if direction == "ge" else c
        entries.append(f"named_struct('series', '{name}', 'key', {key})")
    long = df.select(*by, F.expr(f"explode(array({', '.join(entries)}))").alias("e")) \
        .select(*by, "e.series", "e.key")
    return long.groupBy(*by, "series", "key").agg(F.count(F.lit(1)).alias("cnt"))


def curves_of_histogram(hist: DataFrame, lo: float = GRID_LO, hi: float = GRID_HI, n: int = GRID_N,
                        by: Sequence[str] = ()) -> DataFrame:
    """Dense curves from the (small) histogram without joining back to it.

    "ge" series are mirrored (m = n-1-key) so every series becomes a prefix sum:
    hits(i) = sum(cnt for m <= i). Each histogram row then emits the run of grid
    indices it covers, [m, next m - 1], and the first row of a group also emits the
    leading run of zeros. Windows see at most n+2 rows per (group, series).
    """
    ge = [s for s, _, d in SERIES if d == "ge"]
    is_ge = F.col("series").isin(ge)
    h = hist.withColumn("m", F.when(is_ge, F.lit(n - 1) - F.col("key")).otherwise(F.col("key")))
    w_all = Window.partitionBy(*by, "series")
    w_ord = w_all.orderBy(F.col("m").asc_nulls_last())
    h = h.select(
        *by, "series", "m", F.sum("cnt").over(w_all).alias("n"),
        F.sum(F.when(F.col("m").isNotNull(), F.col("cnt")).otherwise(0))
         .over(w_ord.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("cum"),
        F.lead("m").over(w_ord).alias("nxt"),
        F.row_number().over(w_ord).alias("rn"))
    gap_end = f"(coalesce(m, {n}) - 1)"
    own_end = f"(coalesce(nxt, {n}) - 1)"
    gap = (f"filter(transform(sequence(0, greatest({gap_end}, 0)), "
           f"i -> named_struct('i', i, 'hits', CAST(0 AS BIGINT))), "
           f"e -> rn = 1 AND e.i <= {gap_end})")
    own = (f"filter(transform(sequence(coalesce(m, 0), greatest({own_end}, coalesce(m, 0))), "
           f"i -> named_struct('i', i, 'hits', CAST(cum AS BIGINT))), "
           f"e -> m IS NOT NULL AND m <= {n - 1} AND e.i <= {own_end})")
    runs = h.select(*by, "series", "n", F.expr(f"explode(concat({gap}, {own}))").alias("e"))
    idx = F.when(is_ge, F.lit(n - 1) - F.col("e.i")).otherwise(F.col("e.i")).cast("int")
    return runs.select(
        *by, "series", idx.alias("grid_idx"), grid_value(idx, lo, hi, n).alias("price"),
        F.col("e.hits").alias("hits"), F.col("n").cast("bigint").alias("n"),
    ).withColumn("pct", F.col("hits").cast("double") / F.col("n") * 100)


def _wide(curves: DataFrame, by: Sequence[str]) -> DataFrame:
    names = [s for s, _, _ in SERIES]
    return curves.groupBy(*by, "grid_idx").agg(
        *[F.max(F.when(F.col("series") == s, F.col("hits"))).alias(s) for s in names])


def vw_points(df: DataFrame, spec: SurveySpec = DEFAULT_SPEC, lo: float = GRID_LO,
              hi: float = GRID_HI, n: int = GRID_N, by: Sequence[str] = (),
              curves: DataFrame | None = None) -> DataFrame:
    """The four named crossings (V2/V3): (*by, point, standard_name, grid_idx, price).

    A crossing is the left grid point of the first adjacent pair whose differences
    have product <= 0 (no interpolation); null when the curves never meet. The
    difference is taken on integer hit counts, so equal shares are exactly zero.
    """
    by = list(by)
    curves = curves if curves is not None else vw_curves(df, spec, lo, hi, n, by)
    wide = _wide(curves, by)
    w = Window.partitionBy(*by).orderBy("grid_idx") if by else Window.orderBy("grid_idx")
    flags = []
    for point, (a, b), _ in POINTS:
        d = F.signum(F.col(a) - F.col(b))
        flags.append((d * F.lead(d).over(w) <= 0).alias(f"x_{point}"))
    marked = wide.select(*by, "grid_idx", *flags)
    firsts = marked.groupBy(*by).agg(
        *[F.min(F.when(F.col(f"x_{p}"), F.col("grid_idx"))).alias(p) for p, _, _ in POINTS])
    rows = F.explode(F.array(*[
        F.struct(F.lit(p).alias("point"), F.lit(std).alias("standard_name"),
                 F.col(p).alias("grid_idx")) for p, _, std in POINTS]))
    return firsts.select(*by, rows.alias("r")).select(
        *by, "r.point", "r.standard_name", F.col("r.grid_idx").cast("int").alias("grid_idx"),
        grid_value(F.col("r.grid_idx"), lo, hi, n).alias("price"))


def vw_crossing(curves: DataFrame, s1: str, s2: str, by: Sequence[str] = ()) -> DataFrame:
    """First crossing of two named series (V2): (*by, grid_idx, price)."""
    by = list(by)
    wide = _wide(curves, by)
    w = Window.partitionBy(*by).orderBy("grid_idx") if by else Window.orderBy("grid_idx")
    d = F.signum(F.col(s1) - F.col(s2))
    marked = wide.select(*by, "grid_idx", (d * F.lead(d).over(w) <= 0).alias("x"))
    prices = curves.select(*by, "grid_idx", "price").distinct()
    first = marked.groupBy(*by).agg(F.min(F.when(F.col("x"), F.col("grid_idx"))).alias("grid_idx"))
    return first.join(prices, on=[*by, "grid_idx"], how="left").select(*by, "grid_idx", "price")


def vw_range(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Acceptable range pmc..pme (V4), ordered, with ``inverted`` when pmc > pme."""
    by = list(by)
    p = points.groupBy(*by).agg(
        F.max(F.when(F.col("point") == "pmc", F.col("price"))).alias("pmc"),
        F.max(F.when(F.col("point") == "pme", F.col("price"))).alias("pme"))
    both = F.col("pmc").isNotNull() & F.col("pme").isNotNull()
    return p.select(*by, "pmc", "pme",
                    F.when(both, F.least("pmc", "pme")).alias("low"),
                    F.when(both, F.greatest("pmc", "pme")).alias("high"),
                    (F.col("pmc") > F.col("pme")).alias("inverted"))
