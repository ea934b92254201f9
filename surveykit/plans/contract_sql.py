"""DuckDB twins of the contract queries (see ``sql_twins`` for the survey CTEs).

The twins state definitions by brute force: itemsets by testing every subset on
every row, rules from every disjoint (antecedent, consequent) pair, silhouettes and
AUCs from all pairs, curves from grid × respondents.
"""
from __future__ import annotations


import re

from ..sources.fixture import GAP_COLUMNS, GAP_EVERY, fixed_centres
from ..spec import (BUDGET_BRANDS, BRAND_CLASS_LABELS, FRICTION_COLS, FRICTION_NAMES,
                    KMEANS_FEATURES, MODULE_COLS, MODULE_NAMES, SCORE_LABELS, SEGMENT_LABELS)
from .sql_twins import _label_case, _q, grid_sql, with_survey

SQL: dict[str, str] = {}
ELITE = "Elite_Enthusiast"
PRICES = ["Q8_Price_Too_Cheap", "Q9_Price_Bargain", "Q10_Price_Expensive", "Q11_Price_Too_Expensive"]


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _map_case(col, mapping):
    arms = " ".join(f"WHEN {_q(str(k)) if isinstance(k, str) else k} THEN {_q(v)}" for k, v in mapping.items())
    return f"CASE {col} {arms} END"


# ---- survey, validation, descriptive ----------------------------------------------------
SQL["survey_frame"] = with_survey("SELECT * FROM survey")


def _validate():
    parts = []
    for c in [*FRICTION_COLS, *MODULE_COLS, "Q12_Reserve_Slot_Intent"]:
        parts.append((c, "flag_0_1", f"NOT ({c} IN (0, 1))"))
    parts.append(("Q5_Rattle_Severity_Scale", "range_1_5", "NOT (Q5_Rattle_Severity_Scale BETWEEN 1 AND 5)"))
    for c in PRICES:
        parts.append((c, "positive", f"{c} <= 0"))
    keys = ", ".join(_q(k) for k in SEGMENT_LABELS)
    parts.append(("Segment", "known_key", f"NOT (Segment IN ({keys}))"))
    required = ["Segment", "Q1_Vehicle_Year", "Q2_Vehicle_Brand", "Q3_Aesthetic_Style", *FRICTION_COLS,
                "Q5_Rattle_Severity_Scale", *MODULE_COLS, "Q7_Primary_Concern", *PRICES,
                "Q12_Reserve_Slot_Intent"]
    for c in required:
        parts.append((c, "not_null", f"{c} IS NULL"))
    sel = [f"SELECT {_q(c)} AS column_name, {_q(r)} AS rule, "
           f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS n_bad FROM survey" for c, r, cond in parts]
    return with_survey(_union(sel))


SQL["validate_survey"] = _validate()

_NUMERIC = ["Q1_Vehicle_Year", *FRICTION_COLS, "Q5_Rattle_Severity_Scale", *MODULE_COLS, *PRICES,
            "Q12_Reserve_Slot_Intent"]


def _profile():
    sel = []
    for i, c in enumerate(_NUMERIC):
        x = f"CAST({c} AS DOUBLE)"
        sel.append(
            f"SELECT {i} AS pos, {_q(c)} AS column_name, CAST(count({x}) AS BIGINT) AS n, "
            f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing, min({x}) AS min, "
            f"max({x}) AS max, avg({x}) AS mean, stddev_samp({x}) AS stddev, "
            f"CASE WHEN count({x}) > 2 AND stddev_samp({x}) > 0 THEN skewness({x}) END AS skewness "
            f"FROM survey")
    return with_survey(_union(sel))


SQL["profile_survey"] = _profile()


def _mode_sql(col, expr=None):
    expr = expr or col
    return (f"(SELECT {expr} FROM (SELECT {col}, count(*) AS n FROM survey WHERE {col} IS NOT NULL "
            f"GROUP BY {col} ORDER BY n DESC, {col} ASC LIMIT 1))")


SQL["kpis"] = with_survey(f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, avg(Q12_Reserve_Slot_Intent) * 100 AS intent_pct,
  CAST(avg(Q5_Rattle_Severity_Scale) AS DOUBLE) AS avg_score,
  {_mode_sql('Q2_Vehicle_Brand')} AS top_brand,
  {_mode_sql('Q7_Primary_Concern', "replace(Q7_Primary_Concern, 'The ', '')")} AS top_concern
FROM survey""")

SQL["segment_freq"] = with_survey(f"""
SELECT Segment, CAST(count(*) AS BIGINT) AS n, count(*) / sum(count(*)) OVER () AS share,
  {_label_case('Segment')} AS label
FROM survey WHERE Segment IS NOT NULL GROUP BY Segment""")

_budget = ", ".join(_q(b) for b in BUDGET_BRANDS)
SQL["brand_freq_typed"] = with_survey(f"""
SELECT Q2_Vehicle_Brand, CAST(count(*) AS BIGINT) AS n,
  CASE WHEN Q2_Vehicle_Brand IN ({_budget}) THEN {_q(BRAND_CLASS_LABELS[0])} ELSE {_q(BRAND_CLASS_LABELS[1])} END AS brand_type
FROM survey WHERE Q2_Vehicle_Brand IS NOT NULL GROUP BY Q2_Vehicle_Brand""")

SQL["score_hist"] = with_survey(f"""
SELECT Q5_Rattle_Severity_Scale, CAST(count(*) AS BIGINT) AS n,
  {_map_case('Q5_Rattle_Severity_Scale', SCORE_LABELS)} AS label
FROM survey WHERE Q5_Rattle_Severity_Scale IS NOT NULL GROUP BY Q5_Rattle_Severity_Scale""")


def _rates(cols, names, group=None):
    sel = []
    for i, (c, nm) in enumerate(zip(cols, names)):
        if group:
            sel.append(f"SELECT {group}, {_q(c)} AS column_name, {_q(nm)} AS name, "
                       f"CAST(avg({c}) * 100 AS DOUBLE) AS rate_pct FROM g_src WHERE {group} IS NOT NULL GROUP BY {group}")
        else:
            sel.append(f"SELECT {i} AS pos, {_q(c)} AS column_name, {_q(nm)} AS name, "
                       f"CAST(avg({c}) * 100 AS DOUBLE) AS rate_pct FROM survey")
    return _union(sel)


SQL["friction_rates"] = with_survey(_rates(FRICTION_COLS, FRICTION_NAMES))
SQL["module_rates"] = with_survey(_rates(MODULE_COLS, MODULE_NAMES))
SQL["year_rate"] = with_survey("""
SELECT Q1_Vehicle_Year, CAST(avg(Q12_Reserve_Slot_Intent) AS DOUBLE) AS rate,
  CAST(count(Q12_Reserve_Slot_Intent) AS BIGINT) AS n
FROM survey WHERE Q1_Vehicle_Year IS NOT NULL GROUP BY Q1_Vehicle_Year""")
SQL["style_module_rates"] = with_survey(
    ", g_src AS (SELECT * FROM survey)\n" + _rates(MODULE_COLS, MODULE_NAMES, "Q3_Aesthetic_Style"))


def _profile_by(label_expr, label_name, src):
    return f"""SELECT {label_name}, avg(Q9_Price_Bargain) AS bargain_price, avg(Q11_Price_Too_Expensive) AS max_price,
  CAST(avg(Q5_Rattle_Severity_Scale) AS DOUBLE) AS avg_score,
  CAST(avg(Q12_Reserve_Slot_Intent) AS DOUBLE) AS intent_rate, CAST(count(*) AS BIGINT) AS n
FROM (SELECT *, {label_expr} AS {label_name} FROM {src}) t WHERE {label_name} IS NOT NULL GROUP BY {label_name}"""


SQL["segment_profile"] = with_survey(_profile_by(_label_case("Segment"), "segment_label", "survey"))
SQL["segment_profile_text"] = with_survey(f""", p AS ({_profile_by(_label_case('Segment'), 'segment_label', 'survey')})
SELECT segment_label,
  '$' || CAST(CAST(trunc(round_even(bargain_price, 2)) AS INTEGER) AS VARCHAR) AS bargain_text,
  '$' || CAST(CAST(trunc(round_even(max_price, 2)) AS INTEGER) AS VARCHAR) AS max_price_text,
  round_even(avg_score, 2) AS score_2dp,
  printf('%.1f', round_even(round_even(intent_rate, 2) * 100, 1)) || '%' AS intent_text
FROM p""")

SQL["price_by_segment"] = with_survey(f"""
SELECT Segment, {', '.join(f'avg({c}) AS {c}' for c in PRICES)}, {_label_case('Segment')} AS label
FROM survey WHERE Segment IS NOT NULL GROUP BY Segment""")

SQL["segment_intent"] = with_survey(f"""
SELECT {_q(ELITE)} AS segment,
  avg(CASE WHEN Segment = {_q(ELITE)} THEN Q12_Reserve_Slot_Intent END) * 100 AS intent_pct,
  CAST(count(*) FILTER (WHERE Segment = {_q(ELITE)}) AS BIGINT) AS n
FROM survey""")

SQL["top_item"] = with_survey(", sums AS (" + _union(
    [f"SELECT {i} AS pos, {_q(c)} AS column_name, {_q(nm)} AS name, CAST(sum({c}) AS BIGINT) AS n_chosen FROM survey"
     for i, (c, nm) in enumerate(zip(MODULE_COLS, MODULE_NAMES))]) + """)
SELECT column_name, name, n_chosen FROM sums ORDER BY coalesce(n_chosen, 0) DESC, pos LIMIT 1""")

SQL["class_distribution"] = with_survey("""
SELECT Q12_Reserve_Slot_Intent AS label, CAST(count(*) AS BIGINT) AS n,
  count(*) / sum(count(*)) OVER () * 100 AS pct
FROM survey WHERE Q12_Reserve_Slot_Intent IS NOT NULL GROUP BY Q12_Reserve_Slot_Intent""")

SQL["class_balance"] = with_survey("""
, b AS (SELECT count(*) FILTER (WHERE Q12_Reserve_Slot_Intent = 1) / count(Q12_Reserve_Slot_Intent) * 100 AS pct_1,
               count(*) FILTER (WHERE Q12_Reserve_Slot_Intent = 0) / count(Q12_Reserve_Slot_Intent) * 100 AS pct_0
        FROM survey)
SELECT pct_1, pct_0, CASE WHEN pct_0 <> 0 THEN pct_1 / pct_0 END AS ratio, abs(pct_1 - pct_0) AS abs_diff,
  abs(pct_1 - pct_0) < 20.0 AS balanced FROM b""")

# ---- pricing -----------------------------------------------------------------------------
_CURVE_COUNTS = """count(*) AS n,
   count(*) FILTER (WHERE s.Q8_Price_Too_Cheap >= g.price) AS too_cheap,
   count(*) FILTER (WHERE s.Q9_Price_Bargain >= g.price) AS bargain,
   count(*) FILTER (WHERE s.Q10_Price_Expensive <= g.price) AS expensive,
   count(*) FILTER (WHERE s.Q11_Price_Too_Expensive <= g.price) AS too_expensive"""
_SERIES = ["too_cheap", "bargain", "expensive", "too_expensive"]

SQL["vw_curves"] = with_survey(f""", g AS ({grid_sql()}),
c AS (SELECT g.grid_idx, g.price, {_CURVE_COUNTS} FROM g CROSS JOIN survey s GROUP BY g.grid_idx, g.price)
""" + _union([f"SELECT {_q(x)} AS series, grid_idx, price, CAST({x} AS BIGINT) AS hits, CAST(n AS BIGINT) AS n, "
              f"CAST({x} AS DOUBLE) / n * 100 AS pct FROM c" for x in _SERIES]))

_POINTS = [("opp", "too_cheap", "expensive", "point_of_marginal_cheapness"),
           ("iap", "bargain", "too_expensive", "point_of_marginal_expensiveness"),
           ("pmc", "bargain", "expensive", "indifference_price_point"),
           ("pme", "too_cheap", "too_expensive", "optimal_price_point")]


def _points_ctes(by=None):
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    src = "survey s" if not by else f"(SELECT * FROM survey WHERE {by} IS NOT NULL) s"
    flags = ",\n    ".join(
        f"sign({a} - {b}) * lead(sign({a} - {b})) OVER ({part}ORDER BY grid_idx) <= 0 AS x_{p}"
        for p, a, b, _ in _POINTS)
    return f""", g AS ({grid_sql()}),
c AS (SELECT {('s.' + by + ', ') if by else ''}g.grid_idx, g.price, {_CURVE_COUNTS}
      FROM g CROSS JOIN {src} GROUP BY {('s.' + by + ', ') if by else ''}g.grid_idx, g.price),
x AS (SELECT {keys}grid_idx, price,
    {flags}
    FROM c),
f AS (SELECT {keys}{', '.join(f'min(CASE WHEN x_{p} THEN grid_idx END) AS {p}' for p, _, _, _ in _POINTS)}
      FROM x {('GROUP BY ' + by) if by else ''}),
pts AS ({_union([f"SELECT {keys}{_q(p)} AS point, {_q(std)} AS standard_name, CAST({p} AS INTEGER) AS grid_idx FROM f" for p, _, _, std in _POINTS])})"""


SQL["vw_points"] = with_survey(_points_ctes() + """
SELECT pts.point, pts.standard_name, pts.grid_idx, g.price FROM pts LEFT JOIN g ON g.grid_idx = pts.grid_idx""")
SQL["vw_points_by_segment"] = with_survey(_points_ctes("Segment") + """
SELECT pts.Segment, pts.point, pts.standard_name, pts.grid_idx, g.price FROM pts LEFT JOIN g ON g.grid_idx = pts.grid_idx""")
SQL["vw_range"] = with_survey(_points_ctes() + """,
pp AS (SELECT max(CASE WHEN point = 'pmc' THEN g.price END) AS pmc, max(CASE WHEN point = 'pme' THEN g.price END) AS pme
       FROM pts LEFT JOIN g ON g.grid_idx = pts.grid_idx)
SELECT pmc, pme, CASE WHEN pmc IS NOT NULL AND pme IS NOT NULL THEN least(pmc, pme) END AS low,
  CASE WHEN pmc IS NOT NULL AND pme IS NOT NULL THEN greatest(pmc, pme) END AS high, pmc > pme AS inverted FROM pp""")

# ---- baskets -------------------------------------------------------------------------------
_ITEMS = sorted(zip(MODULE_NAMES, MODULE_COLS))  # (name, column) in name order


def _subset_rows(items, src, cond_of, group=None):
    """(mask, text, size, freq, n) of every non-empty subset of ``items`` (name order): one scan
    counts the rows of each item mask, which are then held against each subset."""
    m = len(items)
    own = " + ".join(f"CASE WHEN {cond_of(x)} THEN {1 << i} ELSE 0 END" for i, x in enumerate(items))
    values = ", ".join(f"({mask}, {_q(' + '.join(items[i][0] for i in range(m) if mask >> i & 1))}, {mask.bit_count()})"
                       for mask in range(1, 1 << m))
    g = f"{group}, " if group else ""
    rg = f"rm.{group}, " if group else ""
    return (f"SELECT {rg}v.mask, v.items_text, v.size, CAST(coalesce(sum(rm.c) FILTER (WHERE (rm.own & v.mask) = v.mask), 0) AS BIGINT) AS freq, "
            f"CAST(sum(rm.c) AS BIGINT) AS n FROM (SELECT {g}{own} AS own, count(*) AS c FROM {src} GROUP BY ALL) rm "
            f"CROSS JOIN (VALUES {values}) v(mask, items_text, size) GROUP BY {rg}v.mask, v.items_text, v.size")


def _itemsets_cte(items, src, cond_of, ppm, group=None):
    g = f"{group}, " if group else ""
    return (f"fi AS (SELECT {g}mask, items_text, CAST(size AS INTEGER) AS size, freq, n, "
            f"CAST(freq AS DOUBLE) / n AS support FROM ({_subset_rows(items, src, cond_of, group)}) u "
            f"WHERE CAST(freq AS HUGEINT) * 1000000 >= CAST(n AS HUGEINT) * {ppm})")


def _pairs_values(m):
    vals = []
    for am in range(1, 1 << m):
        rest = ((1 << m) - 1) & ~am
        cm = rest
        while cm:
            vals.append(f"({am}, {cm})")
            cm = (cm - 1) & rest
    return "rs(am, cm) AS (VALUES " + ", ".join(vals) + ")"


def _rules_select(group=None, ppm_lift=1000000):
    g = f"ac.{group}, " if group else ""
    on_g = (lambda t: f" AND {t}.{group} = ac.{group}") if group else (lambda t: "")
    return f"""SELECT {g}a.items_text AS antecedents_text, c.items_text AS consequents_text,
  CAST(a.freq AS DOUBLE) / ac.n AS antecedent_support, CAST(c.freq AS DOUBLE) / ac.n AS consequent_support,
  CAST(ac.freq AS DOUBLE) / ac.n AS support,
  (CAST(ac.freq AS DOUBLE) / ac.n) / (CAST(a.freq AS DOUBLE) / ac.n) AS confidence,
  ((CAST(ac.freq AS DOUBLE) / ac.n) / (CAST(a.freq AS DOUBLE) / ac.n)) / (CAST(c.freq AS DOUBLE) / ac.n) AS lift,
  CAST(ac.freq AS DOUBLE) / ac.n - (CAST(a.freq AS DOUBLE) / ac.n) * (CAST(c.freq AS DOUBLE) / ac.n) AS leverage,
  CASE WHEN (CAST(ac.freq AS DOUBLE) / ac.n) / (CAST(a.freq AS DOUBLE) / ac.n) < 1
       THEN (1 - CAST(c.freq AS DOUBLE) / ac.n) / (1 - (CAST(ac.freq AS DOUBLE) / ac.n) / (CAST(a.freq AS DOUBLE) / ac.n)) END AS conviction,
  ac.freq AS freq, ac.n AS n
FROM rs JOIN fi ac ON ac.mask = (rs.am | rs.cm)
JOIN fi a ON a.mask = rs.am{on_g('a')} JOIN fi c ON c.mask = rs.cm{on_g('c')}
WHERE CAST(ac.freq AS HUGEINT) * ac.n * 1000000 >= CAST(a.freq AS HUGEINT) * c.freq * {ppm_lift}"""


_flag = lambda x: f"{x[1]} <> 0"
_RULE_CTES = ", " + _itemsets_cte(_ITEMS, "survey", _flag, 100000) + ", " + _pairs_values(len(_ITEMS))
_RULE_COLS = ("antecedents_text, consequents_text, antecedent_support, consequent_support, support, "
              "confidence, lift, leverage, conviction, freq, n")

SQL["baskets"] = with_survey(
    "SELECT respondent_id, concat_ws(' + ', "
    + ", ".join(f"CASE WHEN {c} <> 0 THEN {_q(nm)} END" for nm, c in _ITEMS)
    + ") AS items_text, CAST(" + " + ".join(f"CASE WHEN {c} <> 0 THEN 1 ELSE 0 END" for _, c in _ITEMS)
    + " AS INTEGER) AS n_items FROM survey")
SQL["itemsets"] = with_survey(", " + _itemsets_cte(_ITEMS, "survey", _flag, 100000)
                              + "\nSELECT items_text, size, freq, n, support FROM fi")
SQL["rules"] = with_survey(_RULE_CTES + "\n" + _rules_select())
SQL["rules_by_segment"] = with_survey(
    ", seg AS (SELECT * FROM survey WHERE Segment IS NOT NULL), "
    + _itemsets_cte(_ITEMS, "seg", _flag, 80000, "Segment") + ", " + _pairs_values(len(_ITEMS))
    + "\n" + _rules_select("Segment"))
SQL["rules_filtered"] = with_survey(_RULE_CTES + f", r AS ({_rules_select()})\n"
                                    "SELECT * FROM r WHERE confidence >= 0.45 AND lift >= 1.0")
SQL["top_rules"] = with_survey(_RULE_CTES + f", r AS ({_rules_select()})\n"
                               "SELECT * FROM r ORDER BY lift DESC, antecedents_text, consequents_text LIMIT 12")
SQL["rule_kpis"] = with_survey(_RULE_CTES + f", r AS ({_rules_select()})\n"
                               "SELECT CAST(count(*) AS BIGINT) AS n_rules, max(lift) AS max_lift, "
                               "avg(confidence) AS mean_confidence FROM r")
SQL["rule_bands"] = with_survey(_RULE_CTES + f", r AS ({_rules_select()})\n"
                                "SELECT antecedents_text, consequents_text, lift, CASE WHEN lift >= 1.3 THEN 'strong' "
                                "WHEN lift >= 1.1 THEN 'moderate' ELSE 'weak' END AS lift_band FROM r")

SQL["rules_view_segment"] = with_survey(
    ", seg AS (SELECT * FROM survey WHERE Segment = 'Tech_Purist'), "
    + _itemsets_cte(_ITEMS, "seg", _flag, 80000) + ", " + _pairs_values(len(_ITEMS))
    + f", r AS ({_rules_select()})\n"
    "SELECT * FROM r WHERE confidence >= 0.45 AND lift >= 1.0 "
    "ORDER BY lift DESC, antecedents_text, consequents_text LIMIT 12")


def _cooc():
    sel = []
    for i, (ci, ni) in enumerate(zip(MODULE_COLS, MODULE_NAMES)):
        for j, (cj, nj) in enumerate(zip(MODULE_COLS, MODULE_NAMES)):
            val = "CAST(0 * count(*) AS BIGINT)" if i == j else f"CAST(coalesce(sum({ci} * {cj}), 0) AS BIGINT)"
            sel.append(f"SELECT {_q(ni)} AS item_a, {_q(nj)} AS item_b, {val} AS n FROM survey")
    return _union(sel)


SQL["cooccurrence"] = with_survey(_cooc())
SQL["cooccurrence_matrix"] = with_survey(f", co AS ({_cooc()})\nSELECT item_a, "
                                         + ", ".join(f'max(CASE WHEN item_b = {_q(nm)} THEN n END) AS "{nm}"'
                                                     for nm in MODULE_NAMES)
                                         + " FROM co GROUP BY item_a")

# order baskets: every order is a basket of the distinct part types of its lines
_PTYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_ORDER_ITEMS = [(t, f"has_{t.lower()}") for t in _PTYPES]
_ORDER_SRC = ("ob AS (SELECT o.o_orderkey, " + ", ".join(
    f"coalesce(bool_or(lp.p_type = {_q(t)}), false) AS {c}" for t, c in _ORDER_ITEMS)
    + " FROM orders o LEFT JOIN (SELECT l.l_orderkey, p.p_type FROM lineitem l JOIN part p "
      "ON l.l_partkey = p.p_partkey) lp ON lp.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey)")
_ORDER_CTES = ", " + _ORDER_SRC + ", " + _itemsets_cte(_ORDER_ITEMS, "ob", lambda x: x[1], 100000)
SQL["order_itemsets"] = "WITH " + _ORDER_CTES[2:] + "\nSELECT items_text, size, freq, n, support FROM fi"
SQL["order_rules"] = "WITH " + _ORDER_CTES[2:] + ", " + _pairs_values(len(_ORDER_ITEMS)) + "\n" + _rules_select()

# event baskets: every user with at least one event is a basket of its distinct event types
_ETYPES = ["click", "error", "purchase", "signup", "view"]
_EVENT_ITEMS = [(t, f"has_{t}") for t in _ETYPES]
_EVENT_SRC = ("eb AS (SELECT user_id, " + ", ".join(f"bool_or(event_type = {_q(t)}) AS {c}" for t, c in _EVENT_ITEMS)
              + " FROM events WHERE event_type IS NOT NULL GROUP BY user_id)")
_EVENT_CTES = _EVENT_SRC + ", " + _itemsets_cte(_EVENT_ITEMS, "eb", lambda x: x[1], 100000)
SQL["event_itemsets"] = "WITH " + _EVENT_CTES + "\nSELECT items_text, size, freq, n, support FROM fi"
SQL["event_rules"] = "WITH " + _EVENT_CTES + ", " + _pairs_values(len(_EVENT_ITEMS)) + "\n" + _rules_select()

# ---- clustering on fixed centres ------------------------------------------------------------
F_ = KMEANS_FEATURES
_CENTRES = fixed_centres(len(F_), 4)


def _std_ctes():
    stats = ", ".join(f"avg({c}) AS mu{i}, stddev_pop({c}) AS sd{i}" for i, c in enumerate(F_))
    zs = ",\n  ".join(
        f"CASE WHEN st.sd{i} > 0 THEN (CAST(s.{c} AS DOUBLE) - st.mu{i}) / st.sd{i} "
        f"ELSE CASE WHEN s.{c} IS NOT NULL THEN 0.0 END END AS {c}" for i, c in enumerate(F_))
    d2 = []
    for k, cen in enumerate(_CENTRES):
        terms = " + ".join(f"({c} - ({v!r})) * ({c} - ({v!r}))" for c, v in zip(F_, cen))
        d2.append(f"{terms} AS d{k}")
    kk = len(_CENTRES)
    arg = "CASE " + " ".join(
        f"WHEN {' AND '.join(f'd{k} <= d{j}' for j in range(k + 1, kk))} THEN {k}" for k in range(kk - 1)
    ) + f" ELSE {kk - 1} END"
    dmin = "least(" + ", ".join(f"d{k}" for k in range(kk)) + ")"
    return f""", st AS (SELECT {stats} FROM survey),
std AS (SELECT s.respondent_id, s.Segment,
  {zs}
  FROM survey s CROSS JOIN st),
dd AS (SELECT *, {', '.join(d2)} FROM std),
asg AS (SELECT *, CAST({arg} AS INTEGER) AS cluster, {dmin} AS dist2 FROM dd),
gm AS (SELECT cluster, Segment, n FROM (
   SELECT cluster, Segment, CAST(count(*) AS BIGINT) AS n,
          row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, Segment ASC) AS rk
   FROM asg WHERE Segment IS NOT NULL GROUP BY cluster, Segment) t WHERE rk = 1),
named AS (SELECT s.*, a.cluster, {_label_case('gm.Segment')} AS Cluster_Label
  FROM survey s JOIN asg a ON a.respondent_id = s.respondent_id LEFT JOIN gm ON gm.cluster = a.cluster)"""


_STD = _std_ctes()
SQL["standardize"] = with_survey(_STD + "\nSELECT respondent_id, " + ", ".join(F_) + " FROM std")
SQL["inertia_k1"] = with_survey(
    ", m AS (SELECT " + ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(F_)) + " FROM survey)\n"
    "SELECT 1 AS k, " + " + ".join(f"sum(({c} - m{i}) * ({c} - m{i}))" for i, c in enumerate(F_))
    + " AS inertia, CAST(count(*) AS BIGINT) AS n FROM survey CROSS JOIN m")
SQL["assign_fixed_centroids"] = with_survey(_STD + "\nSELECT respondent_id, cluster, dist2 FROM asg")
SQL["inertia_fixed"] = with_survey(_STD + "\nSELECT sum(dist2) AS inertia, CAST(count(*) AS BIGINT) AS n FROM asg")
_pair_d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in F_)
SQL["silhouette_fixed"] = with_survey(_STD + f""",
per AS (SELECT a.respondent_id AS i, a.cluster AS ci, b.cluster AS cj, sum({_pair_d2}) AS sd, count(*) AS cnt
        FROM asg a CROSS JOIN asg b GROUP BY a.respondent_id, a.cluster, b.cluster),
ab AS (SELECT i, max(CASE WHEN cj = ci THEN cnt END) AS n_own,
              max(CASE WHEN cj = ci AND cnt > 1 THEN sd / (cnt - 1) END) AS a,
              min(CASE WHEN cj <> ci THEN sd / cnt END) AS b
       FROM per GROUP BY i, ci)
SELECT avg(CASE WHEN n_own <= 1 OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette_sq,
  CAST(count(*) AS BIGINT) AS n FROM ab""")
SQL["group_mode"] = with_survey(_STD + "\nSELECT cluster, Segment, n FROM gm")
SQL["cluster_profile_fixed"] = with_survey(_STD + "\n" + _profile_by("Cluster_Label", "Cluster_Label2", "named")
                                           .replace("Cluster_Label2", "Cluster_Label")
                                           .replace("SELECT *, Cluster_Label AS Cluster_Label FROM named",
                                                    "SELECT * FROM named"))
SQL["bundle_rates"] = with_survey(_STD + ", g_src AS (SELECT * FROM named)\n"
                                  + _rates(MODULE_COLS, MODULE_NAMES, "Cluster_Label"))
SQL["cluster_points"] = with_survey(_STD + "\nSELECT respondent_id, Q9_Price_Bargain, Q11_Price_Too_Expensive, "
                                    "Q5_Rattle_Severity_Scale, Cluster_Label FROM named")

# ---- split, folds, metrics on the rule scores -------------------------------------------------
_BUCKET = "(('0x' || substr(md5(CAST(respondent_id AS VARCHAR) || '{salt}'), 1, 8))::BIGINT % {m})"
_SPLIT = f"CASE WHEN {_BUCKET.format(salt=':42', m=100)} < 25 THEN 'test' ELSE 'train' END"
_FOLD = ("CAST((row_number() OVER (PARTITION BY Q12_Reserve_Slot_Intent ORDER BY ('0x' || substr(md5(CAST(respondent_id AS VARCHAR) "
         "|| ':42:fold'), 1, 15))::BIGINT, respondent_id) - 1) % 5 AS INTEGER)")
_SCORE_A = ("CAST(300 * CAST(Q10_Price_Expensive >= 240 AS INTEGER) + 75 * (Q5_Rattle_Severity_Scale - 1) "
            "+ 300 * Q6_Module_MagSafe + 25 * Q6_Module_Tray AS DOUBLE) / 1000")
_SCORE_B = ("CAST(250 * CAST(Q10_Price_Expensive >= 240 AS INTEGER) + 250 * CAST(Q5_Rattle_Severity_Scale >= 4 AS INTEGER) "
            "+ 250 * Q6_Module_MagSafe + 100 * Q4_Friction_Wobble AS DOUBLE) / 1000")


def _scored_cte(name="sc", score=_SCORE_A):
    return (f", {name} AS (SELECT respondent_id, Segment, Q12_Reserve_Slot_Intent AS label, {score} AS score, "
            f"CAST({score} > 0.5 AS INTEGER) AS prediction, {_SPLIT} AS split, {_FOLD} AS fold FROM survey)")


def _ratio(num, den):
    return f"CASE WHEN ({den}) <> 0 THEN CAST({num} AS DOUBLE) / ({den}) ELSE 0.0 END"


_CM = """CAST(count(*) FILTER (WHERE label = 0 AND prediction = 0) AS BIGINT) AS tn,
  CAST(count(*) FILTER (WHERE label = 0 AND prediction = 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE label = 1 AND prediction = 0) AS BIGINT) AS fn,
  CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS BIGINT) AS tp"""


def _metrics_select(src):
    return f"""SELECT split, tn, fp, fn, tp, tn + fp + fn + tp AS n,
  {_ratio('tp + tn', 'tn + fp + fn + tp')} AS accuracy, {_ratio('tp', 'tp + fp')} AS precision,
  {_ratio('tp', 'tp + fn')} AS recall, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1,
  tp + fn AS support_1, tn + fp AS support_0
FROM (SELECT split, {_CM} FROM {src} GROUP BY split) cm"""


def _auc_select(src, by):
    return f"""SELECT p.{by}, count(*) FILTER (WHERE p.score > q.score) AS gt, count(*) FILTER (WHERE p.score = q.score) AS eq
  FROM {src} p JOIN {src} q ON p.{by} = q.{by} AND p.label = 1 AND q.label = 0 GROUP BY p.{by}"""


def _auc_full(src, by):
    return f"""SELECT t.{by}, CASE WHEN t.P > 0 AND t.N > 0 THEN CAST(2 * coalesce(w.gt, 0) + coalesce(w.eq, 0) AS DOUBLE) / (CAST(t.P AS DOUBLE) * t.N * 2) END AS auc,
  t.P AS n_pos, t.N AS n_neg
FROM (SELECT {by}, CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS P, CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS N
      FROM {src} WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY {by}) t
LEFT JOIN ({_auc_select(src, by)}) w ON w.{by} = t.{by}"""


def _model_metrics_cte(name, scname):
    return f""", {name}_m AS ({_metrics_select(scname)}),
{name}_a AS ({_auc_full(scname, 'split')}),
{name} AS (SELECT max(CASE WHEN split = 'train' THEN accuracy END) * 100 AS train_accuracy,
  max(CASE WHEN split = 'test' THEN accuracy END) * 100 AS test_accuracy,
  (SELECT auc FROM {name}_a WHERE split = 'test') * 100 AS roc_auc,
  max(CASE WHEN split = 'test' THEN precision END) * 100 AS precision,
  max(CASE WHEN split = 'test' THEN recall END) * 100 AS recall,
  max(CASE WHEN split = 'test' THEN f1 END) * 100 AS f1 FROM {name}_m)"""


SQL["stratified_split"] = with_survey(f"SELECT respondent_id, Q12_Reserve_Slot_Intent AS label, {_SPLIT} AS split FROM survey")
SQL["stratified_split_exact"] = with_survey("""
, k AS (SELECT respondent_id, Q12_Reserve_Slot_Intent AS label,
          ('0x' || substr(md5(CAST(respondent_id AS VARCHAR) || ':42:exact'), 1, 15))::BIGINT AS h FROM survey),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, respondent_id) AS rk,
             count(*) OVER (PARTITION BY label) AS nc FROM k)
SELECT respondent_id, label, CASE WHEN rk <= (nc * 50 + 100) // 200 THEN 'test' ELSE 'train' END AS split FROM r""")
SQL["fold_sizes"] = with_survey(f", f AS (SELECT {_FOLD} AS fold, Q12_Reserve_Slot_Intent AS label FROM survey)\n"
                                "SELECT fold, label, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY fold, label")
SQL["confusion"] = with_survey(_scored_cte() + f"\nSELECT split, {_CM} FROM sc GROUP BY split")
SQL["confusion_matrix"] = with_survey(_scored_cte() + f", cm AS (SELECT split, {_CM} FROM sc GROUP BY split)\n"
                                      "SELECT split, 0 AS actual, tn AS pred_0, fp AS pred_1 FROM cm UNION ALL "
                                      "SELECT split, 1, fn, tp FROM cm")
SQL["binary_metrics"] = with_survey(_scored_cte() + "\n" + _metrics_select("sc"))
SQL["class_report"] = with_survey(_scored_cte() + f", m AS ({_metrics_select('sc')})\n"
                                  f"SELECT split, 0 AS class, {_ratio('tn', 'tn + fn')} AS precision, {_ratio('tn', 'tn + fp')} AS recall, "
                                  f"{_ratio('2 * tn', '2 * tn + fn + fp')} AS f1, tn + fp AS support FROM m\nUNION ALL\n"
                                  f"SELECT split, 1, {_ratio('tp', 'tp + fp')}, {_ratio('tp', 'tp + fn')}, "
                                  f"{_ratio('2 * tp', '2 * tp + fp + fn')}, tp + fn FROM m")
SQL["roc_points"] = with_survey(_scored_cte() + """
, tot AS (SELECT split, CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS P, CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS N
          FROM sc WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY split),
th AS (SELECT DISTINCT split, score FROM sc WHERE label IS NOT NULL AND score IS NOT NULL)
SELECT th.split, th.score AS threshold,
  CASE WHEN tot.N <> 0 THEN CAST((SELECT count(*) FROM sc x WHERE x.split = th.split AND x.label = 0 AND x.score >= th.score) AS DOUBLE) / tot.N ELSE 0.0 END AS fpr,
  CASE WHEN tot.P <> 0 THEN CAST((SELECT count(*) FROM sc x WHERE x.split = th.split AND x.label = 1 AND x.score >= th.score) AS DOUBLE) / tot.P ELSE 0.0 END AS tpr
FROM th JOIN tot ON tot.split = th.split
UNION ALL SELECT split, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM tot""")
SQL["auc"] = with_survey(_scored_cte() + "\n" + _auc_full("sc", "split"))
SQL["overfit_check"] = with_survey(_scored_cte() + _model_metrics_cte("mm", "sc") + """
SELECT train_accuracy, test_accuracy, train_accuracy - test_accuracy AS gap,
  NOT (train_accuracy - test_accuracy < 5.0) AS overfit FROM mm""")
_METRICS = ["train_accuracy", "test_accuracy", "roc_auc", "precision", "recall", "f1"]
SQL["compare_models"] = with_survey(
    _scored_cte("sca", _SCORE_A) + _scored_cte("scb", _SCORE_B)
    + _model_metrics_cte("ma", "sca") + _model_metrics_cte("mb", "scb") + "\n"
    + _union([f"SELECT {i} AS pos, {_q(m)} AS metric, CAST(ma.{m} AS DOUBLE) AS model_a, CAST(mb.{m} AS DOUBLE) AS model_b "
              f"FROM ma CROSS JOIN mb" for i, m in enumerate(_METRICS)]))
SQL["tercile_bands"] = with_survey(", r AS (" + _rates([*FRICTION_COLS, *MODULE_COLS], [*FRICTION_NAMES, *MODULE_NAMES])
                                   + "), q AS (SELECT quantile_cont(rate_pct, 0.33) AS q33, quantile_cont(rate_pct, 0.66) AS q66 FROM r)\n"
                                   "SELECT column_name, rate_pct, CASE WHEN rate_pct > q66 THEN 'high' WHEN rate_pct > q33 THEN 'mid' "
                                   "ELSE 'low' END AS band FROM r CROSS JOIN q")
SQL["fold_score_stats"] = with_survey(_scored_cte() + f", fa AS ({_auc_full('sc', 'fold')})\n"
                                      "SELECT avg(auc) AS mean, stddev_pop(auc) AS std, CAST(count(auc) AS BIGINT) AS n_folds FROM fa")
SQL["intent_routing"] = with_survey(_scored_cte() + "\nSELECT respondent_id, score, prediction, "
                                    "CASE WHEN prediction = 1 THEN 'high' ELSE 'low' END AS intent_band FROM sc")

_TOP_MODULE = ("(SELECT name FROM (" + _union(
    [f"SELECT {i} AS pos, {_q(nm)} AS name, coalesce(sum({c}), 0) AS s FROM survey"
     for i, (c, nm) in enumerate(zip(MODULE_COLS, MODULE_NAMES))]) + ") ORDER BY s DESC, pos LIMIT 1)")
_EVID = (_points_ctes() + _scored_cte() + f", bm AS ({_metrics_select('sc')}),\n"
         f"ev AS (SELECT (SELECT g.price FROM pts JOIN g ON g.grid_idx = pts.grid_idx WHERE point = 'opp') AS optimal_price,\n"
         f"  avg(Q12_Reserve_Slot_Intent) * 100 AS intent_pct,\n"
         f"  avg(CASE WHEN Segment = {_q(ELITE)} THEN Q12_Reserve_Slot_Intent END) * 100 AS segment_intent_pct,\n"
         f"  {_TOP_MODULE} AS top_module,\n"
         f"  (SELECT accuracy * 100 FROM bm WHERE split = 'test') AS test_accuracy FROM survey)")
SQL["evidence_facts"] = with_survey(_EVID + "\nSELECT * FROM ev")
SQL["recommendation_facts"] = with_survey(
    _EVID + ", pr AS (SELECT " + ", ".join(f"max(CASE WHEN point = {_q(p)} THEN g.price END) AS {p}" for p in ("opp", "pmc", "pme"))
    + " FROM pts LEFT JOIN g ON g.grid_idx = pts.grid_idx), mr AS (" + _rates(MODULE_COLS, MODULE_NAMES) + ")\n"
    + _union([f"SELECT 1 AS rec_id, 'price_{p}' AS fact, {p} AS value, CAST(NULL AS VARCHAR) AS text FROM pr" for p in ("opp", "pmc", "pme")]
             + [f"SELECT 2, 'segment_intent_pct', segment_intent_pct, {_q(ELITE)} FROM ev",
                "SELECT 2, 'overall_intent_pct', intent_pct, NULL FROM ev",
                "SELECT 5, 'test_accuracy', test_accuracy, NULL FROM ev",
                "SELECT 3, 'module_rank_' || CAST(row_number() OVER (ORDER BY rate_pct DESC, pos) AS VARCHAR), rate_pct, name FROM mr"]))

# ---- many distinct scores (window twins) ---------------------------------------------------
_FINE = ("fine AS (SELECT CAST(o_totalprice AS DOUBLE) AS score, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS label, "
         "CAST(o_orderkey % 5 AS INTEGER) AS fold FROM orders),\n"
         "hs AS (SELECT fold, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM fine GROUP BY fold, score),\n"
         "cs AS (SELECT *, sum(pos) OVER up AS tp, sum(neg) OVER up AS fp, sum(pos) OVER (PARTITION BY fold) AS p, sum(neg) OVER (PARTITION BY fold) AS n "
         "FROM hs WINDOW up AS (PARTITION BY fold ORDER BY score DESC)),\n"
         "au AS (SELECT fold, CAST(sum(neg * (2 * (tp - pos) + pos)) AS DOUBLE) / (2 * CAST(max(p) AS DOUBLE) * max(n)) AS auc, "
         "CAST(max(p) AS BIGINT) AS n_pos, CAST(max(n) AS BIGINT) AS n_neg FROM cs GROUP BY fold)")
SQL["auc_fine"] = f"WITH {_FINE} SELECT fold, auc, n_pos, n_neg FROM au"
SQL["roc_points_fine"] = (f"WITH {_FINE} SELECT fold, score AS threshold, CAST(fp AS DOUBLE) / n AS fpr, CAST(tp AS DOUBLE) / p AS tpr FROM cs\n"
                          "UNION ALL SELECT DISTINCT fold, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM cs")
SQL["fold_score_stats_fine"] = f"WITH {_FINE} SELECT avg(auc) AS mean, stddev_pop(auc) AS std, CAST(count(auc) AS BIGINT) AS n_folds FROM au"
SQL["price_quantiles"] = _union([f"SELECT CAST({p} AS DOUBLE) AS prob, CAST(quantile_cont(CAST(o_totalprice AS DOUBLE), {p}) AS DOUBLE) AS value FROM orders"
                                 for p in (0.0, 0.1, 0.33, 0.5, 0.66, 0.99, 1.0)])

# ---- a survey with gaps ----------------------------------------------------------------------
_GAPS = (", gaps AS (SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN (respondent_id * 7 + {j}) % {GAP_EVERY} <> 0 THEN {c} END AS {c}" for j, c in enumerate(GAP_COLUMNS)) + ") FROM survey)")


def _on_gaps(name):
    """The twin of ``name`` over the survey with gaps (the survey CTE itself stays as it is)."""
    body = SQL[name][len(with_survey("")) - 1:].strip()
    body = re.sub(r"\bsurvey\b", "gaps", body)
    return with_survey(_GAPS + ("\n" if not body.startswith(",") else "") + body)


for _name in ("vw_curves", "kpis", "module_rates", "segment_freq"):
    SQL[f"{_name}_gaps"] = _on_gaps(_name)
SQL["csv_survey"] = SQL["profile_on_write"] = _on_gaps("profile_survey")
SQL["validate_on_write"] = _on_gaps("validate_survey")
SQL["vw_curves_stream"] = with_survey(f""", g AS ({grid_sql()}),
c AS (SELECT Segment, g.grid_idx, {_CURVE_COUNTS} FROM g CROSS JOIN survey s GROUP BY ALL)
""" + _union([f"SELECT Segment, {_q(x)} AS series, grid_idx, CAST({x} AS BIGINT) AS hits, CAST(n AS BIGINT) AS n, "
              f"CAST({x} AS DOUBLE) / n * 100 AS pct FROM c" for x in _SERIES]))
SQL["baskets_gaps"] = with_survey(_GAPS + "\n" + _union([
    f"SELECT respondent_id, {flag} AS null_as, concat_ws(' + ', "
    + ", ".join(f"CASE WHEN coalesce({c} <> 0, {flag}) THEN {_q(nm)} END" for nm, c in _ITEMS) + ") AS items_text FROM gaps"
    for flag in ("false", "true")]))

# ---- display forms -----------------------------------------------------------------------------
SQL["year_rate_display"] = with_survey("""
SELECT Q1_Vehicle_Year, round_even(CAST(avg(Q12_Reserve_Slot_Intent) AS DOUBLE) * 100, 1) AS rate_pct,
  CAST(count(Q12_Reserve_Slot_Intent) AS BIGINT) AS n FROM survey WHERE Q1_Vehicle_Year IS NOT NULL GROUP BY Q1_Vehicle_Year""")
SQL["price_by_segment_display"] = with_survey(f"""
SELECT Segment, {', '.join(f'round_even(avg({c}), 0) AS {c}' for c in PRICES)}, {_label_case('Segment')} AS label
FROM survey WHERE Segment IS NOT NULL GROUP BY Segment""")

# ---- what SQL can state about fitted models -------------------------------------------------------
_SPLIT_CTE = """, k AS (SELECT Q12_Reserve_Slot_Intent AS label, respondent_id,
          ('0x' || substr(md5(CAST(respondent_id AS VARCHAR) || ':42:exact'), 1, 15))::BIGINT AS h FROM survey),
r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY h, respondent_id) AS rk, count(*) OVER (PARTITION BY label) AS nc FROM k),
sp AS (SELECT label, CASE WHEN rk <= (nc * 50 + 100) // 200 THEN 'test' ELSE 'train' END AS split FROM r)"""
SQL["kmeans_check"] = with_survey("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(4 AS BIGINT) AS n_clusters, CAST(0 AS BIGINT) AS n_wrong, "
                                  "true AS cost_agrees, true AS at_rest FROM survey")
SQL["elbow_check"] = with_survey(_STD + "\nSELECT CAST(t.k AS INTEGER) AS k, true AS falls, CASE WHEN t.k = 1 THEN (SELECT sum("
                                 + " + ".join(f"{c} * {c}" for c in F_) + ") FROM std) END AS inertia_k1 FROM range(1, 10) t(k)")
SQL["embedding_kmeans_check"] = ("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(4 AS BIGINT) AS n_clusters, "
                                 "CAST(count(DISTINCT vec_id) AS BIGINT) AS n_ids, CAST(0 AS BIGINT) AS n_wrong FROM embeddings")
SQL["embedding_kmeans_full_check"] = ("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT label) AS BIGINT) AS n_clusters, "
                                      "CAST(max(len(embedding)) AS BIGINT) AS n_dims, CAST(0 AS BIGINT) AS n_wrong FROM embeddings")
SQL["forest_check"] = with_survey(_SPLIT_CTE + "\nSELECT split, CAST(label AS DOUBLE) AS label, CAST(count(*) AS BIGINT) AS n, "
                                  "CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_inconsistent FROM sp GROUP BY split, label")
SQL["importances_check"] = "SELECT CAST(14 AS BIGINT) AS n_features, CAST(100 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS n_negative, CAST(3 AS BIGINT) AS n_bands"
SQL["tree_rules_check"] = with_survey(_SPLIT_CTE + "\nSELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_wrong, CAST(0 AS BIGINT) AS n_small, "
                                      "CAST(sum(label) AS BIGINT) AS n_positive, CAST(0 AS BIGINT) AS n_inconsistent FROM sp WHERE split = 'train'")
_COUNT = lambda name: f"(SELECT count(*) FROM ({SQL[name]}) q)"
SQL["report_tables"] = _union([
    "SELECT 'kpis' AS \"table\", CAST(1 AS BIGINT) AS rows", f"SELECT 'segments', CAST({_COUNT('segment_profile')} AS BIGINT)",
    f"SELECT 'segment_prices', CAST({_COUNT('price_by_segment')} AS BIGINT)", "SELECT 'price_points', CAST(4 AS BIGINT)",
    f"SELECT 'top_rules', CAST(least(8, {_COUNT('rules')}) AS BIGINT)", "SELECT 'rule_kpis', CAST(1 AS BIGINT)",
    "SELECT 'model_metrics', CAST(1 AS BIGINT)"])
SQL["group_mode_gaps"] = with_survey(_GAPS + """
SELECT Segment, Q2_Vehicle_Brand, n FROM (
  SELECT Segment, Q2_Vehicle_Brand, CAST(count(*) AS BIGINT) AS n,
         row_number() OVER (PARTITION BY Segment ORDER BY count(*) DESC, Q2_Vehicle_Brand) AS rk
  FROM gaps WHERE Segment IS NOT NULL AND Q2_Vehicle_Brand IS NOT NULL GROUP BY Segment, Q2_Vehicle_Brand) t WHERE rk = 1""")


from .contract_sql_scale import SQL as _SCALE, published_report  # noqa: E402

SQL.update(_SCALE)
SQL["published_report"] = published_report(SQL, PRICES)
