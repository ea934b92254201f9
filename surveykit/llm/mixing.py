"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every source gets a target: its weight's share of ``total`` times all words, held at
   ``cap`` times its own size, the excess shared anew by weight (water filling).
2. A source's documents, in a pseudo-random order, form a stream of words that is cut
   into ``BLOCKS`` equal blocks; the target becomes an exact quota of block draws (whole
   passes over the source, then part of one).
3. A binary tree splits the quotas among the output shards: at each node the left half
   gets a multivariate-hypergeometric draw of the node's quotas, the right half the rest,
   so every quota is met exactly and shards have the mix's composition up to chance.
4. A shard draws its own range of the permuted blocks (disjoint by construction) and
   shuffles locally, by a pseudo-random key.

DataFrame functions only. What is shuffled is (source, place, size) per document; the
prefix sums run over hash buckets of a source first and inside one bucket then, so a
source with a third of all rows is many tasks. The plan has one row per source and at
most ``BLOCKS`` blocks for each.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, md5_number, temp_name, written

#: Blocks of a source; a quota is met within half a block, 1/8192 of the source.
BLOCKS = 4096
PLACE_BITS = 60


def place(id_col: Column, text: Column, seed: int) -> Column:
    """A row's pseudo-random place in its source: 60 bits of md5 of id and text."""
    return md5_number(F.concat(F.lit(f"{seed}|"), F.coalesce(id_col.cast("string"), F.lit("")),
                               F.lit("|"), F.coalesce(text, F.lit(""))))


def sized_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", seed: int = 0) -> DataFrame:
    """id, source, size (words; null text: 0) and place of every row."""
    text = F.col(f"`{text_col}`")
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                     F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                     place(F.col(f"`{id_col}`"), text, seed).alias("place"))


def source_targets(sized: DataFrame, weights=(3, 1, 2), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, idx, n, words, target: one row per source (code-point order, null last).

    Sources sorted by cap/weight fill up first; the level is the first at which the next
    source in that order stays under its cap, which is what resharing converges to.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sums.withColumn("idx", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(cycle, (F.col("idx") % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("words") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "idx")
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("words").over(whole) * F.lit(float(total)) - before) / after)
    ratio = F.col("most") / F.col("weight")
    fits = F.when(F.col("level") <= ratio, F.struct(ratio.alias("ratio"), "idx", "level"))
    s = s.withColumn("water", F.min(fits).over(whole).level)
    target = F.when(F.col("water").isNull(), F.col("most")).otherwise(
        F.least(F.col("most"), F.col("water") * F.col("weight")))
    return s.select("source", "idx", "n", "words", target.alias("target"))


def _ln_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 8, led back by the recurrence."""
    z = x + F.lit(8.0)
    product = F.lit(1.0)
    for k in range(1, 8):
        product = product * (x + F.lit(float(k)))
    series = (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * z) - 1 / (360 * z * z * z)
    return series - F.log(product)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hypergeometric(size: Column, good: Column, draws: Column, uniform: Column) -> Column:
    """A draw by inversion: how many of ``good`` among ``draws`` of ``size`` (8 deviations wide)."""
    def with_moments(v: Column) -> Column:
        sd = F.when(v.n > 1, F.sqrt(F.greatest(
            v.mean * (1 - v.g / v.n) * (v.n - v.d) / (v.n - 1), F.lit(0.0)))).otherwise(0.0)
        return _let(F.struct(v.n.alias("n"), v.g.alias("g"), v.d.alias("d"), v.mean.alias("mean"), sd.alias("sd")), with_range)

    def with_range(v: Column) -> Column:
        low = F.greatest(F.lit(0.0), v.d + v.g - v.n, F.floor(v.mean - 8 * v.sd - 2).cast("double")).cast("long")
        high = F.least(v.d, v.g, F.ceil(v.mean + 8 * v.sd + 2).cast("double")).cast("long")

        def ln_p(k: Column) -> Column:
            return -(_ln_factorial(k) + _ln_factorial(v.g - k) + _ln_factorial(v.d - k)
                     + _ln_factorial(v.n - v.g - v.d + k))

        def weigh(r: Column) -> Column:
            mid = F.least(F.greatest(F.round(v.mean).cast("long"), r.low), r.high).cast("double")
            return _let(ln_p(mid), lambda top: _let(
                F.transform(F.sequence(r.low, r.high), lambda k: F.exp(ln_p(k.cast("double")) - top)),
                lambda p: _let(uniform * F.aggregate(p, F.lit(0.0), lambda a, x: a + x),
                               lambda cut: F.least(r.low + passed(p, cut), r.high))))

        return _let(F.struct(low.alias("low"), high.alias("high")), weigh)

    def passed(p: Column, cut: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("k"))
        return F.aggregate(p, start, lambda a, x: F.struct(
            (a.sum + x).alias("sum"),
            (a.k + F.when(a.sum + x < cut, 1).otherwise(0)).cast("long").alias("k")), lambda a: a.k)

    n, g, d = (c.cast("double") for c in (size, good, draws))
    mean = F.when(n > 0, d * g / n).otherwise(0.0)
    return _let(F.struct(n.alias("n"), g.alias("g"), d.alias("d"), mean.alias("mean")), with_moments)


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(idx, quota) → (shard, idx, quota): the splitting tree, one level at a time.

    ``shards`` is a power of two. One row per node with the quotas of all sources; a node
    sends half of its blocks (rounded down) to its left child.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    tree = quotas.agg(F.sort_array(F.collect_list(F.struct("idx", "quota"))).alias("quotas")).select(
        F.lit(0).alias("node"), F.col("quotas.quota").alias("quotas"), F.col("quotas.idx").alias("idx"))
    for level in range(int(math.log2(shards))):
        whole = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(whole.alias("size"), F.floor(whole / 2).cast("long").alias("draws"),
                         F.array().cast("array<bigint>").alias("left"))

        def step(a, x):
            uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("level"), F.col("node"), F.size(a.left)),
                              F.lit(1 << 52)) + 0.5) / float(1 << 52)
            return _let(_hypergeometric(a.size, x, a.draws, uniform), lambda got: F.struct(
                (a.size - x).alias("size"), (a.draws - got).alias("draws"),
                F.concat(a.left, F.array(got)).alias("left")))

        left = F.aggregate("quotas", start, step, lambda a: a.left)
        tree = tree.withColumn("level", F.lit(level)).select("node", "idx", "quotas", left.alias("left"))
        tree = tree.select("idx", F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"),
                     F.zip_with("quotas", "left", lambda q, l: q - l).alias("quotas")))).alias("child"))
        tree = written(tree.select(F.col("child.node").alias("node"), F.col("child.quotas").alias("quotas"), "idx"), "split")
    return (tree.select("node", F.explode(F.arrays_zip("idx", "quotas")).alias("q"))
            .select(F.col("node").alias("shard"), F.col("q.idx").alias("idx"), F.col("q.quotas").alias("quota")))


def block_draws(targets: DataFrame, shards: int = 16, seed: int = 0, blocks: int = BLOCKS) -> DataFrame:
    """The drawn blocks: idx, block, pass, shard; one row per draw.

    Passes run through a source's stream, which is in pseudo-random order already, so the
    last pass ends inside one document at most. The draws are then permuted, and a shard
    takes the range that its quota gives it after the shards before.
    """
    words = F.col("words")
    width = F.greatest(F.ceil(words / F.lit(float(blocks))), F.lit(1)).cast("long")
    plan = targets.where("words > 0").select(
        "idx", "words", width.alias("width"), F.ceil(words / width).cast("long").alias("blocks"),
        F.floor(F.col("target") / words).cast("long").alias("passes"), "target")
    part = F.round((F.col("target") - F.col("passes") * words) / F.col("width")).cast("long")
    plan = plan.withColumn("quota", F.col("passes") * F.col("blocks") + F.least(part, F.col("blocks")))
    plan = plan.select("idx", "blocks", "quota")
    leaves = split_quotas(plan.select("idx", "quota"), shards, seed)
    ends = (leaves.withColumn("end", F.sum("quota").over(Window.partitionBy("idx").orderBy("shard")))
            .groupBy("idx").agg(F.sort_array(F.collect_list("end")).alias("ends")))
    every = plan.join(ends, "idx").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("blocks")))).alias("pass")).where("quota > 0")
    every = every.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    every = every.where(F.col("pass") * F.col("blocks") + F.col("block") < F.col("quota"))
    shuffle = md5_number(F.concat_ws("|", F.lit(str(seed)), "idx", "pass", "block"))
    rank = F.row_number().over(Window.partitionBy("idx").orderBy(shuffle, "pass", "block")) - 1
    every = every.withColumn("rank", rank)
    return every.select("idx", "block", "pass",
                        F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=(3, 1, 2), total: float = 1.5, cap: float = 2.0, shards: int = 16,
                seed: int = 0, blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """The mix as two tables.

    documents: one row per input row: id, place, source, size, source_size, target, taken
    (words taken, repeats counted, at most ``cap`` times the size).
    pieces: one row per piece of a document in a drawn block: id, place, first word, words,
    pass, shard, and ``rank``, the local shuffle key inside the shard.

    A null or wordless text has size 0 and nothing taken; a null source is a source of its
    own, last in order; repeated rows are separate rows; an empty table gives empty ones.
    """
    sized = written(sized_rows(df, id_col, text_col, source_col, seed), "sized")
    targets = written(source_targets(sized, weights, total, cap), "targets")
    most = targets.agg(F.max("n")).first()[0] or 0
    bits = math.ceil(math.log2(max(4, most)) / 2)  # as many buckets in a source as rows in a bucket
    bucket = F.shiftright(F.col("place"), PLACE_BITS - bits)
    # a bucket's words, and the words of the source's buckets before it
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("own"))
    sums = sums.withColumn("before", F.sum("own").over(
        Window.partitionBy("source").orderBy("bucket")) - F.col("own"))
    width = F.greatest(F.ceil(F.col("words") / F.lit(float(blocks))), F.lit(1)).cast("long")
    t = targets.select(F.col("source").alias("s"), "idx", "words", "target", width.alias("width"))
    sums = (sums.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s", "own")
            .withColumnRenamed("source", "s").withColumnRenamed("bucket", "b"))
    rows = sized.withColumn("bucket", bucket)
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inside = F.sum("size").over(Window.partitionBy("idx", "bucket").orderBy("place", "id", "size")
                                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = written(rows.select("id", "place", "source", "idx", "size", F.col("words").alias("source_size"), "target",
                               "width", (F.col("before") + inside - F.col("size")).alias("first")), "streams")
    draws = written(block_draws(targets, shards, seed, blocks), "draws")
    spans = rows.where("size > 0").select("id", "place", "idx", "first", "size", "width", F.explode(F.sequence(
        F.floor(F.col("first") / F.col("width")),
        F.floor((F.col("first") + F.col("size") - 1) / F.col("width")))).alias("block"))
    start = F.greatest(F.col("first"), F.col("block") * F.col("width"))
    end = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * F.col("width"))
    spans = spans.select("id", "place", "idx", "first", "block", (start - F.col("first")).alias("word"), (end - start).alias("words"))
    pieces = spans.join(draws, ["idx", "block"]).withColumn(
        "rank", F.xxhash64(F.lit(seed), "shard", "pass", "idx", "first", "word"))
    taken = pieces.groupBy("idx", "first").agg(F.sum("words").alias("got"))
    sized_docs = rows.where("size > 0").join(taken, ["idx", "first"], "left")
    documents = sized_docs.unionByName(rows.where("size = 0").withColumn("got", F.lit(0).cast("long")))
    documents = documents.select("id", "place", "source", "size", "source_size", "target",
                                 F.coalesce("got", F.lit(0)).cast("long").alias("taken"))
    return documents, pieces


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights=(3, 1, 2), total: float = 1.5, cap: float = 2.0, shards: int = 16, seed: int = 0,
                    runs: int = 16) -> DataFrame:
    """``df``'s rows as often as the mix takes them, all columns kept, laid out as drawn.

    Whole documents only: one that a pass cuts goes to the nearer side, so a source is off
    its target by half a document at most. Documents without words are not taken. A copy
    stands where its first piece of that pass was drawn: rows are spread by shard and one of
    ``runs`` parts of it, and lie in the order of the local shuffle there. Repeated rows
    share their draws. A null source is a source; an empty table gives an empty one.
    """
    taken, pieces = mix_sources(df, id_col, text_col, source_col, weights, total, cap, shards, seed)
    copies = (taken.where("size > 0").groupBy("place").agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("copies"))
              .where("copies > 0"))
    start = pieces.groupBy("place", "pass").agg(F.min(F.struct("first", "word", "shard", "rank")).alias("start"))
    homes = start.groupBy("place").agg(F.sort_array(F.collect_list(  # one for each pass
        F.struct("pass", "start.shard", "start.rank"))).alias("homes"))
    at, n, home = (temp_name(df, x) for x in ("place", "homes", "home"))
    plan = copies.join(homes, "place").select(F.col("place").alias(at), F.slice("homes", 1, F.col("copies")).alias(n))
    rows = df.withColumn(at, place(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed))
    rows = rows.join(plan, at).withColumn(home, F.explode(n))
    part, rank = F.col(home)["shard"], F.col(home)["rank"]
    rows = rows.repartition(part, F.pmod(rank, F.lit(runs))).sortWithinPartitions(part, rank)
    return rows.select(*[F.col(f"`{c}`") for c in df.columns])
