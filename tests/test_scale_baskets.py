"""Long-basket co-occurrence and wide itemsets against brute force."""
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from surveykit.operators import cooccurrence as O
from surveykit.operators.wide_itemsets import wide_itemsets


def pairs_of(rows):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n = Counter(p for items in baskets.values() for p in combinations(sorted(items), 2))
    return {(a, b, k) for (a, b), k in n.items()} | {(b, a, k) for (a, b), k in n.items()}


@pytest.mark.parametrize("segment_items", [3, 128])
def test_cooccurrence(spark, segment_items):
    rng = random.Random(segment_items)
    rows = [(rng.randrange(40), f"i{rng.randrange(25)}") for _ in range(400)] + [(99, f"i{j}") for j in range(60)]
    rows += [(None, "i1"), (1, None), (98, "alone"), *rows[:30]]
    df = spark.createDataFrame(rows, "basket_id int, item string").selectExpr("*", "1 as basket", "2 as segment")
    got = O.long_cooccurrence(df, "basket_id", "item", segment_items).collect()
    assert len(got) == len(set(got)) and {(r.item_a, r.item_b, r.n) for r in got} == pairs_of(rows)
    assert O.long_cooccurrence(df.limit(0), "basket_id", "item").count() == 0


def test_hot_basket_is_spread(spark):
    """A third of all rows in one basket: no segment, pair or join key holds more than a small share."""
    hot = spark.range(6000).select(F.lit(1).alias("basket"), F.col("id").alias("item"))
    rest = spark.range(12_000).select((F.col("id") % 3000 + 2).cast("int").alias("basket"), (F.col("id") * 7919 % 9000).alias("item"))
    items = O.basket_items(hot.unionByName(rest), "basket", "item")
    segments = O.basket_segments(items)
    sizes = segments.where("basket = 1").select(F.size("items").alias("n")).collect()
    assert len(sizes) == 47 and sum(r.n for r in sizes) == 6000 and max(r.n for r in sizes) < 2.2 * O.SEGMENT_ITEMS
    met = O.segment_pairs(segments).where(F.size("a") > 10)
    assert met.count() >= 47 * 48 // 2
    keys = items.where("basket = 1").groupBy(F.pmod(F.xxhash64("item"), F.lit(O.SPREAD))).count().agg(F.max("count")).first()[0]
    assert keys < 2 * 6000 / O.SPREAD


def brute_itemsets(rows, m, support, null_as=False):
    groups = {}
    for g, flags in rows:
        groups.setdefault(g, []).append(frozenset(j for j, v in enumerate(flags) if (null_as if v is None else v != 0)))
    out = set()
    for g, sets in groups.items():
        level = [(j,) for j in range(m)]
        while level:
            kept = []
            for c in level:
                f = sum(1 for s in sets if s.issuperset(c))
                if f and f * 1_000_000 >= round(support * 1e6) * len(sets):
                    kept.append(c)
                    out.add((g, tuple(sorted(f"n{j}" for j in c)), f, len(sets)))
            level = [(*c, j) for c in kept for j in range(c[-1] + 1, m)]
    return out


@pytest.mark.parametrize("m, support, null_as", [(18, 0.4, False), (18, 0.4, True), (70, 0.5, False)])
def test_wide_itemsets(spark, m, support, null_as):
    rng = random.Random(m)
    rows = []
    for g, n in (("a", 60), ("b", 25), (None, 10)):
        p = [rng.random() * (0.9 if j % 5 == 0 else 0.5) for j in range(m)]
        rows += [(g, [rng.choice([1, 1, 1, 2]) if rng.random() < p[j] else rng.choice([0, 0, 0, 0, None]) for j in range(m)]) for _ in range(n)]
    rows.append(("one", [int(j in (0, 3, 17, m - 1)) for j in range(m)]))  # one respondent: only its own sets
    rows.append(("none", [0] * m))
    df = spark.createDataFrame([(g, *f) for g, f in rows], "seg string, " + ", ".join(f"c{j} int" for j in range(m)))
    out = wide_itemsets(df, [f"c{j}" for j in range(m)], [f"n{j}" for j in range(m)], support, ["seg"], null_as).collect()
    got = {(r.seg, tuple(r["items"]), r.freq, r.n) for r in out}
    assert len(out) == len(got) and got == brute_itemsets(rows, m, support, null_as)
    assert sum(r.seg == "one" for r in out) == 2 ** len({0, 3, 17, m - 1}) - 1
    assert all(r["size"] == len(r["items"]) and r.support == r.freq / r.n for r in out)


def test_wide_itemsets_without_groups_and_rows(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 1)], "a int, b int, c int")
    out = wide_itemsets(df, ["a", "b", "c"], ["x", "y", "z"], 0.6)
    assert {tuple(r["items"]) for r in out.collect()} == {("x",), ("z",), ("x", "z")}
    assert wide_itemsets(df.limit(0), ["a", "b", "c"], ["x", "y", "z"], 0.6).count() == 0
