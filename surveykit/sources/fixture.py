"""Survey-shaped inputs derived from the driver's TPC-H-like tables.

One respondent per customer that has at least one order with a line item. The plan
pre-aggregates line items per order (map-side partial counts), joins the order table
on its key (the aggregate is already hash-partitioned on ``l_orderkey``) and folds
orders into customers with a partial/final aggregation, so a customer holding a third
of all orders never reaches one task as raw rows. Prices are rounded half-up on exact
integer cents so every engine derives the same doubles.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import FRICTION_COLS, FRICTION_NAMES, MODULE_COLS, MODULE_NAMES, SURVEY_COLUMNS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# ---- fixed values: fixture derivation rules (see FIXTURES.md §2) --------------------
MKTSEGMENT_TO_SEGMENT = {   # FURNITURE stays unmapped on purpose (null label)
    "AUTOMOBILE": "Elite_Enthusiast",
    "BUILDING": "Family_WorkMom",
    "HOUSEHOLD": "Tech_Purist",
    "MACHINERY": "Practical_Upgrader",
}
FRICTION_RULES = [  # (column, line-item condition, minimum count)
    ("Q4_Friction_Wobble", "l_returnflag = 'R'", 13),
    ("Q4_Friction_Aesthetic", "l_linestatus = 'F'", 19),
    ("Q4_Friction_Block", "l_discount >= 0.08", 8),
    ("Q4_Friction_Degradation", "l_quantity >= 40", 9),
]
MODULE_RULES = [  # (column, part type, minimum count)
    ("Q6_Module_MagSafe", "PROMO", 6),
    ("Q6_Module_BeverageLock", "ECONOMY", 7),
    ("Q6_Module_BagHook", "LARGE", 7),
    ("Q6_Module_Telemetry", "MEDIUM", 8),
    ("Q6_Module_Tray", "SMALL", 7),
]
STYLE_RULES = [(2500.0, "Purist"), (6000.0, "Functionalist")]
STYLE_ELSE = "Enthusiast/Builder"
INTENT_AVG_CENTS = 24_000_000      # average order price >= 240,000
INTENT_URGENT = 3
NOISE_MODULUS = 33                 # intent flipped where custkey % 33 = 0
ORDER_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]  # TPC-H domain
# ---- end of fixed values ------------------------------------------------------------


_RELATIONS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a (lazy) relation, resolved once per session like a catalog
    table: the file listing and footer schema are not re-read for every query. Call
    ``refresh_tables()`` after replacing files (the analogue of REFRESH TABLE)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    df = _RELATIONS.get(key)
    if df is None:
        df = spark.read.parquet(path)
        _RELATIONS[key] = df
    return df


#: Survey tables derived and checkpointed in this session, by (application, folder).
SURVEYS: dict = {}


def refresh_tables() -> None:
    """Forget resolved tables and the surveys derived from them."""
    _RELATIONS.clear()
    SURVEYS.clear()


def _segment_key(c: Column) -> Column:
    expr = None
    for k, v in MKTSEGMENT_TO_SEGMENT.items():
        expr = (F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v)))
    return expr.otherwise(c)


_DEC = "decimal(38,0)"


def _top_order_key(cents: Column) -> Column:
    """One exact decimal(38,0) per order whose maximum identifies the customer's top order
    (highest price, then highest order key) and carries its year and priority:
    cents·10^20 + orderkey·10^5 + (year+1)·10 + priority position. ``max`` over a
    fixed-width decimal keeps the customer fold a hash aggregation."""
    year = F.coalesce(F.year(F.col("o_orderdate")) + 1, F.lit(0))
    code = F.array_position(F.array(*[F.lit(p) for p in ORDER_PRIORITIES]), F.col("o_orderpriority"))
    return (cents.cast(_DEC) * F.lit("100000000000000000000").cast(_DEC)
            + F.col("o_orderkey").cast(_DEC) * F.lit(100000).cast(_DEC)
            + year.cast(_DEC) * F.lit(10).cast(_DEC) + F.coalesce(code, F.lit(0)).cast(_DEC))


def survey_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Respondent table (survey schema) derived from customer/orders/lineitem/part/nation."""
    # Each line is reduced to byte flags (and each part to a byte type code) before the
    # join, so the two line-item-sized shuffles (by part key, then by order key) carry
    # narrow rows.
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey",
        *[F.coalesce(F.expr(cond), F.lit(False)).cast("byte").alias(f"f_{col}")
          for col, cond, _ in FRICTION_RULES])
    types = F.array(*[F.lit(t) for _, t, _ in MODULE_RULES])
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.coalesce(F.array_position(types, F.col("p_type")), F.lit(0)).cast("byte")
        .alias("p_code"))
    lines = li.join(part, li.l_partkey == part.p_partkey, "left")
    per_order = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        *[F.sum(F.col(f"f_{col}").cast("bigint")).alias(f"n_{col}") for col, _, _ in FRICTION_RULES],
        *[F.count_if(F.col("p_code") == i + 1).alias(f"n_{col}") for i, (col, _, _) in enumerate(MODULE_RULES)],
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    counted = [f"n_{c}" for c, _, _ in FRICTION_RULES] + [f"n_{c}" for c, _, _ in MODULE_RULES]
    per_cust = (
        orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left")
        .groupBy("o_custkey").agg(
            F.sum("n_lines").alias("n_lines"),
            *[F.sum(c).alias(c) for c in counted],
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urg"),
            F.count(F.lit(1)).alias("n_orders"),
            F.min(cents).alias("mn_c"),
            F.max(cents).alias("mx_c"),
            F.sum(cents).alias("sum_c"),
            F.max(_top_order_key(cents)).alias("top"),
        )
        .where(F.col("n_lines") > 0)
    )
    cust = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # nation has 25 rows by the TPC-H definition: a proven-size broadcast.
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    j = (per_cust.join(cust, per_cust.o_custkey == cust.c_custkey)
         .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"))

    n = F.col("n_orders")
    top_code = (F.col("top") % 10).cast("int")
    top_year = (F.floor(F.col("top") / 10) % 10000).cast("int")
    def half_up(num: Column, den: Column) -> Column:
        # round_half_up(num / den) for non-negative integers, exact in any engine
        return F.floor((num * 2 + den) / (den * 2)).cast("bigint")

    style = F.when(F.col("c_acctbal") < STYLE_RULES[0][0], STYLE_RULES[0][1]) \
        .when(F.col("c_acctbal") < STYLE_RULES[1][0], STYLE_RULES[1][1]).otherwise(STYLE_ELSE)
    cols = {
        "respondent_id": F.col("c_custkey").cast("bigint"),
        "Segment": _segment_key(F.col("c_mktsegment")),
        "Q1_Vehicle_Year": F.when(top_year > 0, top_year - 1).cast("int"),
        "Q2_Vehicle_Brand": F.col("n_name"),
        "Q3_Aesthetic_Style": style,
    }
    for col, _, k in FRICTION_RULES:
        cols[col] = (F.col(f"n_{col}") >= k).cast("int")
    cols["Q5_Rattle_Severity_Scale"] = (1 + F.least(F.lit(4), F.col("urg"))).cast("int")
    for col, _, k in MODULE_RULES:
        cols[col] = (F.col(f"n_{col}") >= k).cast("int")
    cols["Q7_Primary_Concern"] = F.concat(F.lit("The "), F.when(
        top_code > 0, F.element_at(F.array(*[F.lit(p) for p in ORDER_PRIORITIES]), top_code)))
    cols["Q8_Price_Too_Cheap"] = half_up(F.col("mn_c"), F.lit(1000)) / 100.0
    cols["Q9_Price_Bargain"] = half_up(F.col("mn_c") * n + F.col("sum_c"), n * 2000) / 100.0
    cols["Q10_Price_Expensive"] = half_up(F.col("sum_c"), n * 1000) / 100.0
    cols["Q11_Price_Too_Expensive"] = half_up(F.col("mx_c"), F.lit(1000)) / 100.0
    base = ((F.col("sum_c") >= n * INTENT_AVG_CENTS).cast("int")
            + (F.col("urg") >= INTENT_URGENT).cast("int")
            + cols[MODULE_RULES[0][0]]) >= 2
    cols["Q12_Reserve_Slot_Intent"] = F.when(
        F.col("c_custkey") % NOISE_MODULUS == 0, (~base).cast("int")).otherwise(base.cast("int"))
    return j.select(*[cols[c].alias(c) for c in SURVEY_COLUMNS])


def order_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One basket per order: the distinct part types of its lines; orders without
    lines are kept as empty baskets so they stay in the support denominator."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    items = (li.join(part, li.l_partkey == part.p_partkey)
             .groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_type")).alias("items")))
    return (orders.join(items, orders.o_orderkey == items.l_orderkey, "left")
            .select(F.col("o_orderkey").cast("bigint").alias("basket_id"),
                    F.coalesce(F.col("items"), F.array().cast("array<string>")).alias("items")))


def event_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form baskets from the events table: (basket_id = user, item = event type)."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type")
    return ev.select(F.col("user_id").cast("bigint").alias("basket_id"),
                     F.col("event_type").alias("item"))


# ---- fixed values: deterministic scores and centres for the metric/cluster checks ----
# Score A: (300·[Q10 >= 240] + 75·(Q5 − 1) + 300·MagSafe + 25·Tray) / 1000
# Score B: (250·[Q10 >= 240] + 250·[Q5 >= 4] + 250·MagSafe + 100·Wobble) / 1000
# Integer weights keep every score an exact multiple of 0.001 in any engine.
def rule_scores(survey: DataFrame) -> DataFrame:
    """(respondent_id, Segment, label, score_a, score_b) from fixed linear rules."""
    q10 = (F.col("Q10_Price_Expensive") >= 240).cast("int")
    a = (300 * q10 + 75 * (F.col("Q5_Rattle_Severity_Scale") - 1)
         + 300 * F.col("Q6_Module_MagSafe") + 25 * F.col("Q6_Module_Tray")) / 1000.0
    b = (250 * q10 + 250 * (F.col("Q5_Rattle_Severity_Scale") >= 4).cast("int")
         + 250 * F.col("Q6_Module_MagSafe") + 100 * F.col("Q4_Friction_Wobble")) / 1000.0
    return survey.select("respondent_id", "Segment",
                         F.col("Q12_Reserve_Slot_Intent").alias("label"),
                         a.alias("score_a"), b.alias("score_b"))


def fixed_centres(d: int = 14, k: int = 4) -> list[list[float]]:
    """k centres in standardised space: +1 on features i with i % k == c, −0.5 elsewhere."""
    return [[1.0 if i % k == c else -0.5 for i in range(d)] for c in range(k)]


#: Columns of the survey with gaps, in the order their gaps are dealt out.
GAP_COLUMNS = ("Segment", "Q2_Vehicle_Brand", "Q4_Friction_Wobble", "Q5_Rattle_Severity_Scale", "Q6_Module_MagSafe",
               "Q6_Module_Tray", "Q7_Primary_Concern", "Q8_Price_Too_Cheap", "Q9_Price_Bargain",
               "Q10_Price_Expensive", "Q11_Price_Too_Expensive", "Q12_Reserve_Slot_Intent")
GAP_EVERY = 11


def with_gaps(survey: DataFrame) -> DataFrame:
    """The survey with the cells of column j null where (7 * respondent_id + j) % 11 = 0."""
    return survey.withColumns({c: F.when((F.col("respondent_id") * 7 + j) % GAP_EVERY != 0, F.col(c))
                               for j, c in enumerate(GAP_COLUMNS)})


# ---- fixed values: twenty yes/no statements about a respondent, true in any SQL engine alike ----
WIDE_FLAGS: list[tuple[str, str]] = [
    *[(name, f"{col} = 1") for name, col in zip(FRICTION_NAMES + MODULE_NAMES, FRICTION_COLS + MODULE_COLS)],
    *[(f"Severity {k}+", f"Q5_Rattle_Severity_Scale >= {k}") for k in (2, 3, 4, 5)],
    *[(f"Style {s}", f"Q3_Aesthetic_Style = '{s}'") for s in (STYLE_RULES[0][1], STYLE_RULES[1][1], STYLE_ELSE)],
    ("Cheap above 15", "Q8_Price_Too_Cheap >= 15"), ("Bargain above 70", "Q9_Price_Bargain >= 70"),
    ("Expensive above 140", "Q10_Price_Expensive >= 140"), ("Too expensive above 300", "Q11_Price_Too_Expensive >= 300"),
]


def wide_flags(survey: DataFrame) -> DataFrame:
    """(respondent_id, Segment, f0..): the statements as 0/1 columns, null where one can't be told."""
    return survey.select("respondent_id", "Segment", *[
        F.expr(cond).cast("int").alias(f"f{j}") for j, (_, cond) in enumerate(WIDE_FLAGS)])


def order_lines(spark: SparkSession, sf_dir: str, item: str) -> DataFrame:
    """Long-form baskets of the orders: (basket_id = order, item = ``l_partkey`` or the part's type)."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket_id"), "l_partkey")
    if item == "l_partkey":
        return li.select("basket_id", F.col("l_partkey").alias("item"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(item).alias("item"))
    return li.join(part, li.l_partkey == part.p_partkey).select("basket_id", "item")


# ---- fixed values: a tree written by hand (feature = position among the model's features; rawCount and
# prediction are what it claims of its training rows) ----
FIXED_TREE: list[dict] = [
    {"id": 0, "prediction": 0.40, "rawCount": 1000, "leftChild": 1, "rightChild": 6, "feature": 12, "thr": [240.0]},
    {"id": 1, "prediction": 0.20, "rawCount": 600, "leftChild": 2, "rightChild": 3, "feature": 5, "thr": [0.5]},
    {"id": 2, "prediction": 0.10, "rawCount": 400, "leftChild": -1, "rightChild": -1, "feature": -1, "thr": []},
    {"id": 3, "prediction": 0.40, "rawCount": 200, "leftChild": 4, "rightChild": 5, "feature": 0, "thr": [2.5]},
    {"id": 4, "prediction": 0.25, "rawCount": 120, "leftChild": -1, "rightChild": -1, "feature": -1, "thr": []},
    {"id": 5, "prediction": 0.625, "rawCount": 80, "leftChild": -1, "rightChild": -1, "feature": -1, "thr": []},
    {"id": 6, "prediction": 0.70, "rawCount": 400, "leftChild": 7, "rightChild": 8, "feature": 1, "thr": [0.5]},
    {"id": 7, "prediction": 0.55, "rawCount": 200, "leftChild": -1, "rightChild": -1, "feature": -1, "thr": []},
    {"id": 8, "prediction": 0.85, "rawCount": 200, "leftChild": 9, "rightChild": 10, "feature": 10, "thr": [15.25]},
    {"id": 9, "prediction": 0.80, "rawCount": 150, "leftChild": -1, "rightChild": -1, "feature": -1, "thr": []},
    {"id": 10, "prediction": 1.00, "rawCount": 50, "leftChild": -1, "rightChild": -1, "feature": -1, "thr": []},
]
