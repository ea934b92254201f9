"""DuckDB twins of the queries in ``contract_scale``."""
from __future__ import annotations

from ..sources.fixture import GAP_COLUMNS, GAP_EVERY, WIDE_FLAGS
from ..spec import MODEL_FEATURE_LABELS, MODEL_FEATURES, SURVEY_COLUMNS
from .sql_twins import _q, with_survey

SQL: dict[str, str] = {}


def _cooccurrence(baskets: str) -> str:
    return f"""
WITH b AS (SELECT DISTINCT basket, item FROM ({baskets}) s WHERE basket IS NOT NULL AND item IS NOT NULL)
SELECT x.item AS item_a, y.item AS item_b, count(*) AS n
FROM b x JOIN b y ON x.basket = y.basket AND x.item <> y.item GROUP BY x.item, y.item"""


SQL["order_cooccurrence"] = _cooccurrence(
    "SELECT l_orderkey AS basket, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey")
SQL["part_cooccurrence"] = _cooccurrence("SELECT l_orderkey AS basket, l_partkey AS item FROM lineitem")
SQL["event_cooccurrence"] = _cooccurrence("SELECT user_id AS basket, event_type AS item FROM events")


def _wide_ctes(ppm: int) -> str:
    """Level after level: every set of the level before with every later item, counted over the rows."""
    own = " + ".join(f"CASE WHEN {cond} THEN {1 << j} ELSE 0 END" for j, (_, cond) in enumerate(WIDE_FLAGS))
    items = ", ".join(f"({j}, {1 << j}, {_q(name)})" for j, (name, _) in enumerate(WIDE_FLAGS))
    enough = f"CAST(sum(r.c) AS HUGEINT) * 1000000 >= CAST(min(r.n) AS HUGEINT) * {ppm}"
    ctes = [f"wr AS MATERIALIZED (SELECT *, CAST(sum(c) OVER (PARTITION BY Segment) AS BIGINT) AS n FROM (SELECT Segment, CAST({own} AS BIGINT) AS own, "
            f"count(*) AS c FROM survey WHERE Segment IS NOT NULL GROUP BY ALL) q)",
            f"wi AS (SELECT * FROM (VALUES {items}) v(j, bit, name))",
            f"w1 AS MATERIALIZED (SELECT r.Segment, i.j AS last, CAST(i.bit AS BIGINT) AS mask, CAST(sum(r.c) AS BIGINT) AS freq, min(r.n) AS n "
            f"FROM wr r JOIN wi i ON (r.own & i.bit) <> 0 GROUP BY ALL HAVING {enough})"]
    for k in range(2, len(WIDE_FLAGS) + 1):
        ctes.append(f"w{k} AS MATERIALIZED (SELECT f.Segment, i.j AS last, f.mask | i.bit AS mask, CAST(sum(r.c) AS BIGINT) AS freq, min(r.n) AS n "
                    f"FROM w{k - 1} f JOIN wi i ON i.j > f.last JOIN wr r ON r.Segment = f.Segment "
                    f"AND (r.own & (f.mask | i.bit)) = (f.mask | i.bit) GROUP BY f.Segment, i.j, f.mask | i.bit HAVING {enough})")
    every = " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(1, len(WIDE_FLAGS) + 1))
    ctes.append(f"wa AS MATERIALIZED ({every})")
    return ", " + ", ".join(ctes)


_WIDE = _wide_ctes(300000)
SQL["wide_itemsets_by_segment"] = with_survey(_WIDE + """
SELECT a.Segment, t.items_text, CAST(bit_count(a.mask) AS INTEGER) AS size, a.freq, a.n, CAST(a.freq AS DOUBLE) / a.n AS support
FROM wa a JOIN (SELECT mask, string_agg(name, ' + ' ORDER BY name) AS items_text
                FROM (SELECT DISTINCT mask FROM wa) m JOIN wi ON (mask & bit) <> 0 GROUP BY mask) t ON a.mask = t.mask""")
SQL["wide_rule_kpis_by_segment"] = with_survey(_WIDE + """
, wj AS (SELECT w.Segment, w.freq AS f, x.freq AS fa, y.freq AS fc, w.n FROM wa w
         JOIN wa x ON x.Segment = w.Segment AND (x.mask & w.mask) = x.mask AND x.mask <> w.mask
         JOIN wa y ON y.Segment = w.Segment AND y.mask = w.mask - x.mask)
SELECT Segment, count(*) AS n_rules, max((CAST(f AS DOUBLE) / n) / (CAST(fa AS DOUBLE) / n) / (CAST(fc AS DOUBLE) / n)) AS max_lift,
       avg((CAST(f AS DOUBLE) / n) / (CAST(fa AS DOUBLE) / n)) AS mean_confidence
FROM wj WHERE CAST(f AS HUGEINT) * n >= CAST(fa AS HUGEINT) * fc GROUP BY Segment""")


# ---- the tree written by hand, its paths spelled out -------------------------------------------
_GAPS = ", gaps AS (SELECT " + ", ".join(
    f"CASE WHEN (respondent_id * 7 + {GAP_COLUMNS.index(c)}) % {GAP_EVERY} <> 0 THEN {c} END AS {c}" if c in GAP_COLUMNS else c
    for c in SURVEY_COLUMNS) + " FROM survey)"
_LEAF = """CASE WHEN Q10_Price_Expensive > 240 THEN
    CASE WHEN Q4_Friction_Wobble > 0.5 THEN CASE WHEN Q8_Price_Too_Cheap > 15.25 THEN 5 ELSE 4 END ELSE 3 END
  ELSE CASE WHEN Q6_Module_MagSafe > 0.5 THEN CASE WHEN Q5_Rattle_Severity_Scale > 2.5 THEN 2 ELSE 1 END ELSE 0 END END"""
_LEAVES = """(VALUES
  (0, 'Expensive Price ($) <= 240.00 AND Wants MagSafe = No', 0, 0.10::DOUBLE),
  (1, 'Expensive Price ($) <= 240.00 AND Wants MagSafe = Yes AND Rattle Severity (1–5) <= 2.50', 0, 0.25),
  (2, 'Expensive Price ($) <= 240.00 AND Wants MagSafe = Yes AND Rattle Severity (1–5) > 2.50', 1, 0.625),
  (3, 'Expensive Price ($) > 240.00 AND Friction: Wobble = No', 1, 0.55),
  (4, 'Expensive Price ($) > 240.00 AND Friction: Wobble = Yes AND Too Cheap Price ($) <= 15.25', 1, 0.80),
  (5, 'Expensive Price ($) > 240.00 AND Friction: Wobble = Yes AND Too Cheap Price ($) > 15.25', 1, 1.00)
) v(rule_id, conditions_text, prediction, probability)"""


def _fixed_rules(src: str, where: str = "true") -> str:
    return with_survey(_GAPS + f""", lc AS (SELECT {_LEAF} AS leaf, count(*) AS n FROM {src} GROUP BY ALL)
SELECT rule_id, conditions_text, prediction, probability, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM {_LEAVES} LEFT JOIN lc ON leaf = rule_id WHERE {where}""")


SQL["fixed_tree_rules"] = _fixed_rules("gaps")
SQL["fixed_tree_first_rules"] = _fixed_rules("survey", "rule_id IN (0, 1, 2, 3)")
SQL["fixed_tree_rules_for_class"] = _fixed_rules("survey", "prediction = 1")
_SCORED = """SELECT respondent_id, leaf, probability AS score, prediction,
       CASE WHEN prediction = 1 THEN 'high' ELSE 'low' END AS intent_band FROM sc JOIN """ + _LEAVES + " ON leaf = rule_id"
SQL["fixed_tree_scores"] = with_survey(_GAPS + f", sc AS (SELECT respondent_id, {_LEAF} AS leaf FROM gaps)\n{_SCORED}")
SQL["fixed_tree_profile"] = with_survey(f""", sc AS (SELECT respondent_id, {_LEAF} AS leaf FROM survey
  WHERE respondent_id >= (SELECT avg(respondent_id) FROM survey) ORDER BY respondent_id LIMIT 1)
SELECT respondent_id, score, prediction, intent_band FROM ({_SCORED}) q""")
_FEATURE_ROWS = ", ".join(f"({_q(f)}, {_q(lab)})" for f, lab in zip(MODEL_FEATURES, MODEL_FEATURE_LABELS))
SQL["fixed_tree_importances"] = with_survey(f""", sc AS (SELECT {_LEAF} AS leaf, Q12_Reserve_Slot_Intent AS y FROM survey),
splits AS (SELECT * FROM (VALUES ('Q10_Price_Expensive', [0, 1, 2], [3, 4, 5]), ('Q6_Module_MagSafe', [0], [1, 2]),
  ('Q5_Rattle_Severity_Scale', [1], [2]), ('Q4_Friction_Wobble', [3], [4, 5]), ('Q8_Price_Too_Cheap', [4], [5])) v(feature, l, r)),
sides AS (SELECT feature, count(*) FILTER (list_contains(l, leaf)) AS nl, count(*) FILTER (list_contains(r, leaf)) AS nr,
  CAST(coalesce(sum(y) FILTER (list_contains(l, leaf)), 0) AS DOUBLE) AS yl, CAST(coalesce(sum(y) FILTER (list_contains(r, leaf)), 0) AS DOUBLE) AS yr
  FROM splits, sc GROUP BY feature),
gains AS (SELECT feature, coalesce((yl + yr) * (1 - (yl + yr) / nullif(nl + nr, 0)), 0) - coalesce(yl * (1 - yl / nullif(nl, 0)), 0)
  - coalesce(yr * (1 - yr / nullif(nr, 0)), 0) AS gain FROM sides),
imp AS (SELECT f.feature, f.label, 100 * coalesce(gain, 0) / (SELECT sum(gain) FROM gains) AS importance
  FROM (VALUES {_FEATURE_ROWS}) f(feature, label) LEFT JOIN gains USING (feature))
SELECT feature, label, importance, CASE WHEN importance > (SELECT quantile_cont(importance, 0.66) FROM imp) THEN 'high'
  WHEN importance > (SELECT quantile_cont(importance, 0.33) FROM imp) THEN 'mid' ELSE 'low' END AS band FROM imp""")
SQL["fingerprint_variants"] = with_survey("""
SELECT variant, CAST(count(*) + more AS BIGINT) AS n_rows, same FROM survey, (VALUES ('as it is', 0, true), ('other order', 0, true),
  ('one cell changed', 0, false), ('one row less', -1, false), ('one row twice', 1, false)) v(variant, more, same)
GROUP BY variant, more, same""")

SQL["csv_quarantine"] = with_survey("""
SELECT CASE respondent_id % 50 WHEN 1 THEN 'too few cells' WHEN 2 THEN 'too many cells' WHEN 3 THEN 'open quote'
    WHEN 4 THEN 'repeated header' WHEN 5 THEN 'blank line' ELSE 'accepted' END AS reason,
  CASE respondent_id % 50 WHEN 1 THEN concat_ws(',', respondent_id, Segment, Q1_Vehicle_Year)
    WHEN 2 THEN concat_ws(',', respondent_id, Segment, Q1_Vehicle_Year, Q5_Rattle_Severity_Scale, 'more')
    WHEN 3 THEN concat_ws(',', respondent_id, '"' || Segment, Q1_Vehicle_Year, Q5_Rattle_Severity_Scale)
    WHEN 4 THEN 'respondent_id,Segment,Q1_Vehicle_Year,Q5_Rattle_Severity_Scale' WHEN 5 THEN ''
    ELSE concat_ws('|', respondent_id, Segment, Q1_Vehicle_Year, Q5_Rattle_Severity_Scale) END AS text FROM survey""")


def _mode_of(table: str, col: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    over = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {keys}{col}, CAST(n AS BIGINT) AS n FROM (
  SELECT {keys}{col}, count(*) AS n FROM {table} WHERE {col} IS NOT NULL{f" AND {by} IS NOT NULL" if by else ""} GROUP BY {keys}{col}) c
QUALIFY row_number() OVER ({over}ORDER BY n DESC, {col}) = 1"""


SQL["customer_mode"] = _mode_of("orders", "o_custkey")
SQL["customer_mode_by_priority"] = _mode_of("orders", "o_custkey", "o_orderpriority")
SQL["part_mode_by_return_flag"] = _mode_of("lineitem", "l_partkey", "l_returnflag")


def published_report(sql: dict[str, str], prices: list[str]) -> str:
    """The published cells, from the twins of the queries that make the report's tables."""
    parts = [f"SELECT 'price_points' AS \"table\", point AS key, c.cell, c.value FROM ({sql['vw_points']}) q, "
             "LATERAL (VALUES ('grid_idx', CAST(grid_idx AS DOUBLE)), ('price', price)) c(cell, value)",
             f"SELECT 'rule_kpis', '', c.cell, c.value FROM ({sql['rule_kpis']}) q, LATERAL (VALUES ('n_rules', CAST(n_rules AS DOUBLE)), "
             "('max_lift', max_lift), ('mean_confidence', mean_confidence)) c(cell, value)",
             f"SELECT 'segment_prices', Segment, c.cell, c.value FROM ({sql['price_by_segment']}) q, LATERAL (VALUES "
             + ", ".join(f"('{c}', {c})" for c in prices) + ") c(cell, value)"]
    return " UNION ALL ".join(parts)
