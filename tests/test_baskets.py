"""Itemsets and rules: two counting paths agree, rules match brute force, edge cases."""
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from surveykit.operators import baskets as B
from surveykit.spec import SurveySpec

SPEC = SurveySpec()


def flags_frame(spark, rows, cols=("a", "b", "c")):
    return spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))


def brute_rules(rows, names, min_support, min_lift):
    n = len(rows)
    def freq(s):
        return sum(1 for r in rows if all(r[i] == 1 for i in s))
    frequent = [s for k in range(1, len(names) + 1) for s in combinations(range(len(names)), k)
                if freq(s) * 1_000_000 >= round(min_support * 1e6) * n]
    fs = set(frequent)
    out = {}
    for s in fs:
        if len(s) < 2:
            continue
        for k in range(1, len(s)):
            for a in combinations(s, k):
                c = tuple(x for x in s if x not in a)
                fac, fa, fc = freq(s), freq(a), freq(c)
                if fac * n * 1_000_000 >= fa * fc * round(min_lift * 1e6):
                    out[(tuple(sorted(names[i] for i in a)), tuple(sorted(names[i] for i in c)))] = fac
    return out


def test_rules_match_brute_force_with_multi_item_consequents(spark):
    import random
    rnd = random.Random(3)
    rows = [tuple(int(rnd.random() < p) for p in (0.6, 0.5, 0.4, 0.55)) for _ in range(200)]
    names = ["w", "x", "y", "z"]
    df = flags_frame(spark, rows, ("a", "b", "c", "d"))
    its = B.frequent_itemsets_flags(df, ["a", "b", "c", "d"], names, 0.1)
    rules = B.association_rules(its, 1.0).collect()
    got = {(tuple(r["antecedents"]), tuple(r["consequents"])): r["freq"] for r in rules}
    assert got == brute_rules(rows, names, 0.1, 1.0)
    assert any(len(c) > 1 for _, c in got)


def test_lift_is_symmetric(spark, survey_small):
    rules = B.survey_rules(survey_small).collect()
    lift = {(tuple(r["antecedents"]), tuple(r["consequents"])): r["lift"] for r in rules}
    for (a, c), v in lift.items():
        if (c, a) in lift:
            assert lift[(c, a)] == pytest.approx(v, rel=1e-12)


def test_bitmask_path_equals_fpgrowth_path(spark, survey_small):
    cols, names = list(SPEC.module_cols), list(SPEC.module_names)
    a = B.frequent_itemsets_flags(survey_small, cols, names, 0.1)
    baskets = B.to_baskets(survey_small, cols, names)
    b = B.frequent_itemsets(baskets, 0.1)
    key = lambda df: sorted((tuple(r["items"]), r["freq"], r["n"]) for r in df.collect())
    assert key(a) == key(b)


def test_wide_flags_by_group_equal_bitmasks(spark, survey_small, monkeypatch):
    cols, names = list(SPEC.module_cols), list(SPEC.module_names)
    key = lambda df, by: sorted((*[str(r[c]) for c in by], tuple(r["items"]), r["size"], r["freq"], r["n"]) for r in df.collect())
    for by in ((), ("Segment",)):
        a = key(B.frequent_itemsets_flags(survey_small, cols, names, 0.08, by), by)
        monkeypatch.setattr(B, "MASK_COLUMNS", 2)
        b = key(B.frequent_itemsets_flags(survey_small, cols, names, 0.08, by), by)
        monkeypatch.undo()
        assert a == b
    wide = survey_small.selectExpr("respondent_id", *[f"cast(pmod(respondent_id, {i + 2}) = 0 as int) as f{i}" for i in range(24)])
    got = B.frequent_itemsets_flags(wide, [f"f{i}" for i in range(24)], [f"F{i:02d}" for i in range(24)], 0.2)
    assert {tuple(r["items"]) for r in got.collect()} >= {("F00",), ("F01",), ("F02",), ("F00", "F02")}


def test_items_are_kept_and_null_items_ignored(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", "zzz", None],), (["zzz", "zzz"],), (None,), ([],)], "items array<string>")
    got = {tuple(r["items"]): (r["freq"], r["n"]) for r in B.frequent_itemsets(df, 0.2).collect()}
    assert got == {("a",): (2, 5), ("b",): (1, 5), ("zzz",): (2, 5), ("a", "b"): (1, 5), ("a", "zzz"): (1, 5)}


def test_rules_of_a_long_itemset(spark):
    items = [f"i{k:02d}" for k in range(12)]
    rules = B.association_rules(B.frequent_itemsets(spark.createDataFrame([(items,)] * 3 + [(["x"],)], "items array<string>"), 0.5), 1.0)
    assert rules.where("size(antecedents) + size(consequents) = 12").count() == 2 ** 12 - 2


def test_support_boundary_inclusive_and_empty_baskets_count(spark):
    # 10 rows, item a chosen exactly once -> support 0.10 exactly: kept
    rows = [(1, 0, 0)] + [(0, 0, 0)] * 9
    its = B.frequent_itemsets_flags(flags_frame(spark, rows), ["a", "b", "c"], ["A", "B", "C"], 0.10)
    got = its.collect()
    assert [(r["items"], r["freq"], r["n"]) for r in got] == [(["A"], 1, 10)]


def test_no_frequent_itemsets_gives_empty_rules_with_schema(spark):
    rows = [(0, 0, 0)] * 5
    its = B.frequent_itemsets_flags(flags_frame(spark, rows), ["a", "b", "c"], ["A", "B", "C"], 0.1)
    rules = B.association_rules(its, 1.0)
    assert rules.count() == 0
    assert "lift" in rules.columns
    k = B.rule_kpis(rules).first()
    assert k["n_rules"] == 0 and k["max_lift"] is None


def test_null_flag_rule(spark):
    rows = [(None, 1, 0), (1, 1, 0)]
    df = flags_frame(spark, rows)
    default = B.to_baskets(df, ["a", "b", "c"], ["A", "B", "C"]).collect()
    parity = B.to_baskets(df, ["a", "b", "c"], ["A", "B", "C"], null_as=True).collect()
    assert default[0]["items"] == ["B"] and parity[0]["items"] == ["A", "B"]


def test_cooccurrence_zero_diagonal(spark, survey_small):
    co = B.cooccurrence(survey_small, SPEC.module_cols, SPEC.module_names).collect()
    assert len(co) == 25
    assert all(r["n"] == 0 for r in co if r["item_a"] == r["item_b"])
    d = {(r["item_a"], r["item_b"]): r["n"] for r in co}
    assert all(d[(a, b)] == d[(b, a)] for a, b in d)


def test_lift_exactly_one_is_kept(spark):
    # A and B independent: f(AB)·n == f(A)·f(B) -> lift exactly 1.0, kept by ">= 1.0"
    rows = [(1, 1, 0), (1, 0, 0), (0, 1, 0), (0, 0, 0)]
    its = B.frequent_itemsets_flags(flags_frame(spark, rows), ["a", "b", "c"], ["A", "B", "C"], 0.1)
    rules = B.association_rules(its, 1.0).collect()
    assert {(tuple(r["antecedents"]), tuple(r["consequents"])) for r in rules} == {(("A",), ("B",)), (("B",), ("A",))}
    assert all(r["lift"] == 1.0 for r in rules)
