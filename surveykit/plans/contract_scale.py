"""Contract queries on wide, long and changing inputs (registered with those of ``contract``)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cooccurrence as O
from ..operators import decide as D
from ..operators import describe as A
from ..operators import metrics as M
from ..operators import silhouette_index
from ..operators import baskets as B
from ..operators import classify as C
from ..operators.heavy_modes import heavy_mode
from ..operators.model_store import table_fingerprint
from ..sources.fixture import FIXED_TREE, WIDE_FLAGS, event_baskets, order_lines, table, wide_flags, with_gaps
from ..spec import DEFAULT_SPEC as SPEC
from ..session import scratch_path
from ..sources.quarantine import read_survey_checked
from ..sources.sinks import PublishedSet
from ..streaming.curves import CurveState, maintain_curves
from .contract import FEATS, S, _fixed, _scored, query

# ---- co-occurrence of long baskets --------------------------------------------------------


@query("order_cooccurrence")
def q_order_cooccurrence(spark, sf):
    """Part types that meet in an order."""
    return O.long_cooccurrence(order_lines(spark, sf, "p_type"), "basket_id", "item")


@query("part_cooccurrence")
def q_part_cooccurrence(spark, sf):
    """Parts that meet in an order: as many items as parts."""
    return O.long_cooccurrence(order_lines(spark, sf, "l_partkey"), "basket_id", "item")


@query("event_cooccurrence")
def q_event_cooccurrence(spark, sf):
    """Event types that meet in a user's history."""
    return O.long_cooccurrence(event_baskets(spark, sf), "basket_id", "item")


# ---- itemsets of wide groups ----------------------------------------------------------------
WIDE_SUPPORT = 0.3


def _wide_itemsets(spark, sf):
    flags = wide_flags(S(spark, sf)).where(F.col("Segment").isNotNull())
    return B.frequent_itemsets_flags(flags, [f"f{j}" for j in range(len(WIDE_FLAGS))], [n for n, _ in WIDE_FLAGS],
                                     WIDE_SUPPORT, ["Segment"])


@query("wide_itemsets_by_segment")
def q_wide_itemsets(spark, sf):
    """Twenty flags, every segment at its own threshold."""
    return _wide_itemsets(spark, sf).select("Segment", F.array_join("items", " + ").alias("items_text"), "size", "freq", "n", "support")


@query("wide_rule_kpis_by_segment")
def q_wide_rule_kpis(spark, sf):
    """The rules of those itemsets: how many, the largest lift, the mean confidence."""
    return B.rule_kpis(B.association_rules(_wide_itemsets(spark, sf), 1.0, ["Segment"]), ["Segment"])


# ---- a tree written by hand: rules, scores and importances with values that SQL can state --------
def _rule_view(rules):
    return rules.select("rule_id", F.array_join("conditions", " AND ").alias("conditions_text"), "prediction", "probability", "n")


@query("fixed_tree_rules")
def q_fixed_tree_rules(spark, sf):
    return _rule_view(C.rules_by_nodes(with_gaps(S(spark, sf)), FIXED_TREE))


@query("fixed_tree_first_rules")
def q_fixed_tree_first_rules(spark, sf):
    """The first two rules of each predicted class."""
    first = C.first_rules_per_class(C.rules_by_nodes(S(spark, sf), FIXED_TREE), 2)
    return _rule_view(first)


@query("fixed_tree_rules_for_class")
def q_fixed_tree_rules_for_class(spark, sf):
    return _rule_view(C.rules_for_class(C.rules_by_nodes(S(spark, sf), FIXED_TREE), 1))


@query("fixed_tree_scores")
def q_fixed_tree_scores(spark, sf):
    """Every respondent, cells missing here and there, scored by the tree."""
    return C.score_by_nodes(with_gaps(S(spark, sf)), FIXED_TREE).select(
        "respondent_id", "leaf", "score", "prediction", "intent_band")


@query("fixed_tree_profile")
def q_fixed_tree_profile(spark, sf):
    """The live predictor's path: the respondent of the middle id, entered as one literal row."""
    from ..sources.survey import survey_rows
    cols = [SPEC.id_col, *SPEC.model_features]
    row = S(spark, sf).select(*cols).where(F.col(SPEC.id_col) >= S(spark, sf).agg(F.avg(SPEC.id_col)).first()[0]).orderBy(SPEC.id_col).first()
    return C.score_by_nodes(survey_rows(spark, [list(row)] if row else [], cols), FIXED_TREE).select(
        "respondent_id", "score", "prediction", "intent_band")


@query("fixed_tree_importances")
def q_fixed_tree_importances(spark, sf):
    """Importances of the tree grown with its splits on this survey, ascending, with bands."""
    scored = C.score_by_nodes(S(spark, sf), FIXED_TREE)
    at = scored.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(SPEC.target_col).alias("y")).collect()
    found = {r["leaf"]: (r["n"], r["y"]) for r in at}
    numbers = iter(range(len(FIXED_TREE)))
    by_id, grown = {n["id"]: n for n in FIXED_TREE}, []

    def grow(i):
        node = by_id[i]
        if node["leftChild"] < 0:
            n, y = found.get(next(numbers), (0, 0))
        else:
            n, y = (a + b for a, b in zip(grow(node["leftChild"]), grow(node["rightChild"])))
        grown.append({**node, "rawCount": n, "prediction": y / n if n else 0.0})
        return n, y

    grow(0)
    table = C.importance_table(C.node_importances(grown, len(SPEC.model_features)))
    return C.tercile_band(table, "importance").select("feature", "label", "importance", "band")


@query("fingerprint_variants")
def q_fingerprint_variants(spark, sf):
    """Which changes of the survey leave the model store's key as it is."""
    df, cols = S(spark, sf), [*SPEC.model_features, SPEC.target_col]
    first = F.col("respondent_id") == df.agg(F.min("respondent_id")).first()[0]
    price = F.when(first, F.col(SPEC.model_features[-1]) + 0.01).otherwise(F.col(SPEC.model_features[-1]))
    variants = {"as it is": df, "other order": df.repartition(7, "Q2_Vehicle_Brand").sortWithinPartitions(F.desc("respondent_id")),
                "one cell changed": df.withColumn(SPEC.model_features[-1], price), "one row less": df.where(~first),
                "one row twice": df.unionAll(df.where(first))}
    own = table_fingerprint(df, cols)
    rows = [(name, v.count(), table_fingerprint(v, cols) == own) for name, v in variants.items()]
    return spark.createDataFrame(rows, "variant string, n_rows bigint, same boolean")


@query("silhouette_euclid", rows_only=True)
def q_silhouette_euclid(spark, sf):
    """Euclidean silhouette of the fixed clusters by the reference index, with its error."""
    return silhouette_index.silhouette_euclid_mean(_fixed(spark, sf), FEATS)


@query("published_report")
def q_published_report(spark, sf):
    """The report published twice, and what a reader of the current set finds in it: the cells of
    its tables of price points, rule figures and segment prices."""
    store = PublishedSet(spark, scratch_path(spark, f"published-{uuid.uuid4().hex}"))
    tables = D.report_tables(S(spark, sf), _scored(spark, sf))
    store.publish({k: v.limit(0) for k, v in tables.items()})
    store.publish(tables)
    cells = None
    for table, key in (("price_points", F.col("point")), ("rule_kpis", F.lit("")), ("segment_prices", F.col("Segment"))):
        df = store.read(table)
        numbers = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "bigint", "int")]
        own = df.select(F.lit(table).alias("table"), key.alias("key"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("cell"), F.col(c).cast("double").alias("value")) for c in numbers])).alias("c"))
        cells = own if cells is None else cells.unionByName(own)
    return cells.select("table", "key", "c.cell", "c.value")


# ---- rejected lines of a file ---------------------------------------------------------------
@query("csv_quarantine")
def q_csv_quarantine(spark, sf):
    """Four survey files with damaged lines, read back: every accepted row (its cells) and every
    rejected line, by reason."""
    names = ["respondent_id", "Segment", "Q1_Vehicle_Year", "Q5_Rattle_Severity_Scale"]
    header, whole = ",".join(names), F.concat_ws(",", *names)
    kind = F.col("respondent_id") % 50
    line = (F.when(kind == 1, F.concat_ws(",", *names[:3])).when(kind == 2, F.concat(whole, F.lit(",more")))
            .when(kind == 3, F.concat_ws(",", "respondent_id", F.concat(F.lit('"'), F.col("Segment")), *names[2:]))
            .when(kind == 4, header).when(kind == 5, "").otherwise(whole))
    lines = S(spark, sf).select((F.col("respondent_id") % 4).alias("part"), F.lit(1).alias("after"), line.alias("line"))
    heads = lines.select("part").distinct().select("part", F.lit(0).alias("after"), F.lit(header).alias("line"))
    path = scratch_path(spark, f"lines-{uuid.uuid4().hex}")
    (lines.unionByName(heads).repartition("part").sortWithinPartitions("part", "after")
     .select("part", "line").write.partitionBy("part").text(path))
    accepted, rejected = read_survey_checked(spark, path)
    return (accepted.select(F.lit("accepted").alias("reason"), F.concat_ws("|", *names).alias("text"))
            .unionByName(rejected.select("reason", "text")))


# ---- checks in the pass of the write, curves that grow ---------------------------------------
def _write_checked(spark, sf):
    numbers = [SPEC.year_col, *SPEC.friction_cols, SPEC.score_col, *SPEC.module_cols, *SPEC.price_cols, SPEC.target_col]
    return A.write_checked(with_gaps(S(spark, sf)), scratch_path(spark, f"checked-{uuid.uuid4().hex}"), numeric_cols=numbers)


@query("validate_on_write")
def q_validate_on_write(spark, sf):
    """The checks of a survey with missing cells, counted while it is written."""
    return _write_checked(spark, sf)[0]


@query("profile_on_write")
def q_profile_on_write(spark, sf):
    """The profile of a survey with missing cells, made while it is written."""
    return _write_checked(spark, sf)[1]


class _Twice:
    """A state whose every batch comes a second time, as after a restart between write and commit."""

    def __init__(self, state: CurveState):
        self.state = state

    def update(self, batch, batch_id):
        self.state.update(batch, batch_id)
        self.state.update(batch, batch_id)


@query("vw_curves_stream")
def q_vw_curves_stream(spark, sf):
    """The price curves by segment of answers that arrive as a stream of files, one a batch. Every
    batch comes twice; the first two are folded together, and the first then comes once more."""
    base = scratch_path(spark, f"answers-{uuid.uuid4().hex}")
    S(spark, sf).withColumn("part", F.pmod("respondent_id", F.lit(3))).repartition(3, "part").write.partitionBy("part").parquet(f"{base}/in")
    rows = spark.read.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    state = CurveState(spark, f"{base}/state", by=["Segment"])
    maintain_curves(stream, _Twice(state), f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    state.compact(1)
    state.update(rows, 0)
    return state.curves().select("Segment", "series", "grid_idx", "hits", "n", "pct")


# ---- modes of very many values ----------------------------------------------------------------
@query("customer_mode")
def q_customer_mode(spark, sf):
    """The customer with the most orders."""
    return heavy_mode(table(spark, sf, "orders"), "o_custkey")


@query("customer_mode_by_priority")
def q_customer_mode_by_priority(spark, sf):
    """The customer with the most orders of each priority."""
    return heavy_mode(table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


@query("part_mode_by_return_flag")
def q_part_mode(spark, sf):
    """The part that is ordered most often, by return flag."""
    return heavy_mode(table(spark, sf, "lineitem"), "l_partkey", "l_returnflag")
