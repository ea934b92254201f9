"""Frequent itemsets of wide flag rows (B2, B4), each group mined at its own threshold.

Level-wise: the rows are counted once per (group, flags), as bit words of up to 62 flags. A
level's candidates are made inside each group from that group's frequent sets of the level
before, so a small group whose every set is frequent adds no candidate to any other. A candidate
is counted by one test per bit word against the distinct rows of its group.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag
from ..session import written

#: Flags of one bit word (a signed 64-bit number), mean number of candidates of one row of the
#: candidate table.
WORD_BITS, CANDIDATE_BATCH = 62, 1024
_SCALE = 1_000_000


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.cast("int"))


def _words(flags: int) -> list[str]:
    return [f"w{i}" for i in range(-(-flags // WORD_BITS))]


def row_words(df: DataFrame, cols: Sequence[str], by: Sequence[str], null_as: bool) -> DataFrame:
    """(group key, w0.., cnt): respondents counted by group and flags."""
    words = []
    for i, name in enumerate(_words(len(cols))):
        bits = [F.when(flag(c, null_as), F.lit(1 << j)).otherwise(F.lit(0)).cast("long")
                for j, c in enumerate(cols[i * WORD_BITS:(i + 1) * WORD_BITS])]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits).alias(name))
    key = F.struct(*[F.col(f"`{c}`") for c in by]) if by else F.struct(F.lit(0).alias("all"))
    return df.select(key.alias("g"), *words).groupBy("g", *_words(len(cols))).agg(F.count("*").alias("cnt"))


def _holds(words: Sequence[str], candidate: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.col(w).bitwiseAND(candidate[w]) == candidate[w] for w in words])


def count_candidates(rows: DataFrame, candidates: DataFrame, words: Sequence[str], ppm: int) -> DataFrame:
    """The candidates (g, last, w0..) that enough of their group's rows hold, with freq and n."""
    batches = -(-candidates.count() // CANDIDATE_BATCH) or 1
    batch = F.pmod(F.xxhash64(*words), F.lit(batches)).alias("batch")
    packed = candidates.groupBy("g", batch).agg(F.collect_list(F.struct("last", *words)).alias("some"))
    hits = rows.join(packed, "g").select("g", "cnt", "n", F.explode(F.filter("some", lambda c: _holds(words, c))).alias("c"))
    counted = hits.groupBy("g", "c").agg(F.sum("cnt").alias("freq"), F.max("n").alias("n"))
    enough = F.col("freq").cast("decimal(38,0)") * _SCALE >= F.col("n").cast("decimal(38,0)") * ppm
    return counted.where(enough).select("g", "c.*", "freq", "n")


def next_candidates(frequent: DataFrame, words: Sequence[str]) -> DataFrame:
    """Sets of one level that differ in their last item only, joined: the next level's candidates."""
    def without_last(w: str, i: int) -> Column:
        inside = F.col("last") - i * WORD_BITS
        return F.when((inside >= 0) & (inside < WORD_BITS), F.col(w).bitwiseXOR(_bit(F.greatest(inside, F.lit(0))))).otherwise(F.col(w))

    head = frequent.select("g", "last", *words, *[without_last(w, i).alias(f"h{w}") for i, w in enumerate(words)])
    keys = ["g", *[f"h{w}" for w in words]]
    left = head.select(*keys, "last", *words)
    right = head.select(*keys, F.col("last").alias("more"), *[F.col(w).alias(f"r{w}") for w in words])
    joined = left.join(right, keys).where(F.col("last") < F.col("more"))
    return joined.select("g", F.col("more").alias("last"), *[F.col(w).bitwiseOR(F.col(f"r{w}")).alias(w) for w in words])


def wide_itemsets(df: DataFrame, cols: Sequence[str], names: Sequence[str], min_support: float,
                  by: Sequence[str] = (), null_as: bool = False) -> DataFrame:
    """(by..., items, size, freq, n, support) of every set with freq >= min_support * n in its group.

    A group is every distinct value of ``by``, null included. The threshold is tested on whole
    numbers. Every level is written before the next, and the levels end when none has candidates.
    """
    cols, by, words = list(cols), list(by), _words(len(cols))
    ppm = int(round(min_support * _SCALE))
    counted = written(row_words(df, cols, by, null_as), "flag-rows")
    sizes = counted.groupBy("g").agg(F.sum("cnt").alias("n"))
    rows = written(counted.join(sizes, "g"), "flag-rows-n")  # a struct key: its nulls compare as equal
    single = F.explode(F.array(*[F.struct(F.lit(j).alias("last"), *[
        F.lit(1 << (j - i * WORD_BITS) if i == j // WORD_BITS else 0).cast("long").alias(w)
        for i, w in enumerate(words)]) for j in range(len(cols))]))
    candidates = sizes.select("g", single.alias("c")).select("g", "c.*")
    levels = []
    while True:
        level = written(count_candidates(rows, candidates, words, ppm), "itemset-level")
        if levels and level.isEmpty():
            break
        levels.append(level)
        candidates = written(next_candidates(level, words), "itemset-candidates")
        if candidates.isEmpty():
            break
    catalog = F.array(*[F.struct(F.lit(j // WORD_BITS).alias("word"), F.lit(1 << (j % WORD_BITS)).cast("long").alias("bit"), F.lit(nm).alias("name"))
                        for j, nm in enumerate(names)])
    own = F.array(*[F.col(w) for w in words])
    items = F.array_sort(F.transform(F.filter(catalog, lambda e: own[e["word"]].bitwiseAND(e["bit"]) != 0), lambda e: e["name"]))
    every = reduce(DataFrame.unionByName, levels)
    return every.select(*[F.col(f"g.`{c}`").alias(c) for c in by], items.alias("items"), F.size(items).cast("int").alias("size"),
                        F.col("freq").cast("long").alias("freq"), F.col("n").cast("long").alias("n"),
                        (F.col("freq") / F.col("n")).alias("support"))
