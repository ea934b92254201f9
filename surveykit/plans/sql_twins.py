"""DuckDB/ANSI SQL twins of the contract queries.

These are the brute-force definitions the Spark plans are checked against: where the
Spark operator uses a histogram, prefix sums or closed forms, the twin states the
definition directly (cross products against a 600-point grid, pairwise sums, ...),
so agreement is evidence, not a restatement.
"""
from __future__ import annotations

from ..sources.fixture import (FRICTION_RULES, INTENT_AVG_CENTS, INTENT_URGENT,
                               MKTSEGMENT_TO_SEGMENT, MODULE_RULES, NOISE_MODULUS,
                               STYLE_ELSE, STYLE_RULES)
from ..spec import GRID_HI, GRID_LO, GRID_N, SEGMENT_LABELS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _seg_case(col: str) -> str:
    arms = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in MKTSEGMENT_TO_SEGMENT.items())
    return f"CASE {col} {arms} ELSE {col} END"


def _label_case(col: str) -> str:
    arms = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in SEGMENT_LABELS.items())
    return f"CASE {col} {arms} END"


def _survey_ctes() -> str:
    fric = ",\n      ".join(f"count(*) FILTER (WHERE {cond}) AS n_{col}" for col, cond, _ in FRICTION_RULES)
    mods = ",\n      ".join(f"count(*) FILTER (WHERE p.p_type = {_q(t)}) AS n_{col}" for col, t, _ in MODULE_RULES)
    sums = ",\n      ".join(f"CAST(sum(lp.n_{c}) AS BIGINT) AS n_{c}"
                            for c in [r[0] for r in FRICTION_RULES] + [r[0] for r in MODULE_RULES])
    fric_cols = ",\n    ".join(f"CAST(n_{col} >= {k} AS INTEGER) AS {col}" for col, _, k in FRICTION_RULES)
    mod_cols = ",\n    ".join(f"CAST(n_{col} >= {k} AS INTEGER) AS {col}" for col, _, k in MODULE_RULES)
    promo_col, _, promo_k = MODULE_RULES[0]
    return f"""sk_lines AS (
    SELECT l.l_orderkey,
      count(*) AS n_lines,
      {fric},
      {mods}
    FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
    GROUP BY l.l_orderkey),
  sk_cust AS (
    SELECT o.o_custkey,
      CAST(sum(lp.n_lines) AS BIGINT) AS n_lines,
      {sums},
      CAST(count(*) FILTER (WHERE o.o_orderpriority = '1-URGENT') AS BIGINT) AS urg,
      CAST(count(*) AS BIGINT) AS n_orders,
      min(CAST(round(o.o_totalprice * 100) AS BIGINT)) AS mn_c,
      max(CAST(round(o.o_totalprice * 100) AS BIGINT)) AS mx_c,
      CAST(sum(CAST(round(o.o_totalprice * 100) AS BIGINT)) AS BIGINT) AS sum_c,
      max({{'c': CAST(round(o.o_totalprice * 100) AS BIGINT), 'k': o.o_orderkey,
           'd': o.o_orderdate, 'p': o.o_orderpriority}}) AS top
    FROM orders o LEFT JOIN sk_lines lp ON o.o_orderkey = lp.l_orderkey
    GROUP BY o.o_custkey
    HAVING sum(lp.n_lines) > 0),
  survey AS (
    SELECT
    CAST(c.c_custkey AS BIGINT) AS respondent_id,
    {_seg_case('c.c_mktsegment')} AS Segment,
    CAST(year(s.top.d) AS INTEGER) AS Q1_Vehicle_Year,
    n.n_name AS Q2_Vehicle_Brand,
    CASE WHEN c.c_acctbal < {STYLE_RULES[0][0]} THEN {_q(STYLE_RULES[0][1])}
         WHEN c.c_acctbal < {STYLE_RULES[1][0]} THEN {_q(STYLE_RULES[1][1])}
         ELSE {_q(STYLE_ELSE)} END AS Q3_Aesthetic_Style,
    {fric_cols},
    CAST(1 + least(4, s.urg) AS INTEGER) AS Q5_Rattle_Severity_Scale,
    {mod_cols},
    'The ' || s.top.p AS Q7_Primary_Concern,
    CAST((mn_c * 2 + 1000) // 2000 AS DOUBLE) / 100 AS Q8_Price_Too_Cheap,
    CAST(((mn_c * n_orders + sum_c) * 2 + n_orders * 2000) // (n_orders * 4000) AS DOUBLE) / 100 AS Q9_Price_Bargain,
    CAST((sum_c * 2 + n_orders * 1000) // (n_orders * 2000) AS DOUBLE) / 100 AS Q10_Price_Expensive,
    CAST((mx_c * 2 + 1000) // 2000 AS DOUBLE) / 100 AS Q11_Price_Too_Expensive,
    CAST(CASE WHEN c.c_custkey % {NOISE_MODULUS} = 0 THEN NOT b.base ELSE b.base END AS INTEGER)
      AS Q12_Reserve_Slot_Intent
    FROM sk_cust s
    JOIN customer c ON s.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    CROSS JOIN LATERAL (SELECT (CAST(s.sum_c >= s.n_orders * {INTENT_AVG_CENTS} AS INTEGER)
        + CAST(s.urg >= {INTENT_URGENT} AS INTEGER)
        + CAST(s.n_{promo_col} >= {promo_k} AS INTEGER)) >= 2 AS base) b)"""


SURVEY_CTES = _survey_ctes()


def with_survey(body: str) -> str:
    """Prefix the survey CTEs; ``body`` may start with ``, more AS (...)`` CTEs."""
    body = body.strip()
    if body.startswith(","):
        return f"WITH {SURVEY_CTES}{body}"
    return f"WITH {SURVEY_CTES}\n{body}"


def grid_sql(lo: float = GRID_LO, hi: float = GRID_HI, n: int = GRID_N) -> str:
    return (f"SELECT CAST(i AS INTEGER) AS grid_idx, "
            f"CAST({lo} AS DOUBLE) + CAST(i AS DOUBLE) * (CAST({hi - lo} AS DOUBLE) / {n - 1}) AS price "
            f"FROM range({n}) t(i)")
