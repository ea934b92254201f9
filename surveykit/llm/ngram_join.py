"""Exact Jaccard self-join on word n-grams: size-banded tiles with hashed bitmap signatures.

1. A text becomes the set of its hashed word n-grams (64 bits); texts of equal sets are one
   node from here on.
2. A node's rarest n-grams, ``n - ceil(T * n) + 1`` of them, put it in one tile each: two
   sets at similarity T or more share a tile, in which the smaller one is by its
   ``n - ceil(2T / (1 + T) * n) + 1`` rarest. Rarity comes from a fixed-size frequency
   sketch of the whole corpus, so a line in a third of all texts makes no tile; any order
   would give the same links.
3. Inside a tile, sets meet only within their size band (smaller >= T * larger). Bit counts
   of hashed bitmaps, first of a quarter of the n-grams, then of all, bound the overlap from
   above; what may reach T is decided exactly on the sorted arrays.
4. Components: neighbours in a tile's size order are compared first, the near ones, then
   those farther off; then only pairs of still different components are, by full bitmaps
   inside the task, so a group of thousands of near copies isn't paired off in full. Tiles
   with the same members are compared once.
5. Links: every link lies inside a component, so all pairs of a component in their size band
   are counted exactly, also those that step 4 had no need of. A component is cut into
   blocks by size; each pair of blocks is a group of its own that gives counts, not pairs.

Shuffled are prefix n-grams (about a tenth of all at T = 0.9) as (n-gram, node, size); full
arrays are made only for nodes of a pair that the small bitmaps let through.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, temp_name, written
from .components import connected_components

#: Counters of the frequency sketch (a broadcast of 2 MB, whatever the corpus).
SKETCH_BITS = 18
#: Rows up to which a key list is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Distances in a tile's size order at which members are compared, round by round, before
#: all of what is still apart is.
LAGS = (tuple(range(1, 9)), tuple(range(9, 41)))
#: N-grams in a block of a component, and what a set counts for at least (so 1,024 sets at most, about).
BLOCK, LEAST = 1 << 21, 1 << 11
#: Columns of the dense matrix that overlaps are counted with, at a time.
COLUMNS = 4096

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def ngram_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams (A-Z lower-cased).

    A text of fewer words has its whole sequence as one n-gram, one without words none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1)
    s = np.full(n, len(h) if len(h) < width else 0, dtype=np.uint64)
    for j in range(min(width, len(h))):
        s = s * _A + h[j:j + n]
    return np.unique(mix(s))


def bitmap(grams: np.ndarray, each: int = 8) -> np.ndarray:
    """Hashed bitmap of at least ``each`` bits an n-gram (a power of two, 64 at least)."""
    bits = 64
    while bits < each * len(grams):
        bits *= 2
    at = (grams & np.uint64(bits - 1)).astype(np.int64)
    mask = np.zeros(bits, dtype=bool)
    mask[at] = True
    return np.packbits(mask, bitorder="little").view(np.uint64)


def quarter(grams: np.ndarray) -> np.ndarray:
    """A quarter of the n-grams, the same ones in every set."""
    return grams[((grams >> np.uint64(50)) & np.uint64(3)) == 0]


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap at a smaller size: the halves or-ed."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2:]
    return bits


def overlap_bound(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> int:
    words = min(len(a), len(b))
    a, b = fold(a, words), fold(b, words)
    return min(na - int(np.bitwise_count(a & ~b).sum()), nb - int(np.bitwise_count(b & ~a).sum()))


def frequency_sketch(texts: DataFrame, width: int) -> np.ndarray:
    """How many n-grams of all texts fall in each of the sketch's counters."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for frame in frames:
            held = [ngram_set(text, width) >> np.uint64(64 - SKETCH_BITS) for text in frame["text"]]
            total += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"counter": at, "n": total[at]})

    # as Arrow: a Python object for each counter would take the driver a hundred MB
    rows = texts.select("text").mapInPandas(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    sketch[rows["counter"].to_numpy()] = rows["n"].to_numpy()
    return sketch


def _features(texts: DataFrame, width: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """id, key (of the text), n, node (fingerprint of the set), prefix (tile keys), mini (bitmap of a quarter)."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequency = shared.value
        for frame in frames:
            sizes, nodes, prefixes, minis = [], [], [], []
            for text in frame["text"]:
                grams = ngram_set(text, width)
                n = len(grams)
                sizes.append(n)
                nodes.append(int(mix(grams + _B).sum(dtype=np.uint64).astype(np.int64)) if n else None)
                take = n - (percent * n + 99) // 100 + 1 if n else 0
                order = np.lexsort((grams, frequency[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[:take]
                prefixes.append(grams[order].view(np.int64))
                minis.append(bitmap(quarter(grams), 4).tobytes())
            yield pd.DataFrame({"id": frame["id"], "key": frame["key"], "n": sizes, "node": pd.Series(nodes, dtype="Int64"),
                                "prefix": prefixes, "mini": minis})

    return texts.mapInPandas(features, "id string, key long, n long, node long, prefix array<long>, mini binary")


def _arrays(texts: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """node, n, grams and bits (both as bytes) of one text for each wanted (key, node)."""
    def arrays(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # copies in one partition are made once
        for frame in frames:
            frame = frame[[not (k in seen or seen.add(k)) for k in frame["node"].tolist()]]
            sets = [ngram_set(t, width) for t in frame["text"]]
            yield pd.DataFrame({"node": frame["node"], "n": [len(s) for s in sets],
                                "grams": [s.tobytes() for s in sets], "bits": [bitmap(s).tobytes() for s in sets]})

    return (texts.join(_few(keys), "key").select("node", "text")
            .mapInPandas(arrays, "node long, n long, grams binary, bits binary").dropDuplicates(["node"]))


def _few(table: DataFrame) -> DataFrame:
    """The table as the smaller side of a join: broadcast only if its counted rows are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _reaching(pairs: DataFrame, sides: DataFrame, what: str, test) -> DataFrame:
    """The pairs (a, b) that pass ``test`` on column ``what`` of their two nodes."""
    side = lambda name: sides.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col(what).alias(f"x{name}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(test("na", "xa", "nb", "xb")).select("a", "b"))


def _tests(percent: int):
    @F.pandas_udf("boolean")
    def may_reach(na: pd.Series, xa: pd.Series, nb: pd.Series, xb: pd.Series) -> pd.Series:
        return pd.Series([(100 + percent) * overlap_bound(np.frombuffer(a, np.uint64), i, np.frombuffer(b, np.uint64), j) >= percent * (i + j)
                          for i, a, j, b in zip(na.tolist(), xa, nb.tolist(), xb)], dtype=bool)

    @F.pandas_udf("boolean")
    def reaches(na: pd.Series, xa: pd.Series, nb: pd.Series, xb: pd.Series) -> pd.Series:
        out = []
        for i, a, j, b in zip(na.tolist(), xa, nb.tolist(), xb):
            both = np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
            both.sort(kind="stable")  # merges the two sorted runs
            out.append((100 + percent) * int((both[1:] == both[:-1]).sum()) >= percent * (i + j))
        return pd.Series(out, dtype=bool)

    return may_reach, reaches


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of written pairs (a, b) those at the similarity or more: full bitmaps first, then exactly.

    The second table has the arrays of all nodes in the pairs.
    """
    may_reach, reaches = _tests(percent)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    arrays = written(_arrays(texts, nodes.join(ends, "node").select("key", "node"), width), "arrays")
    candidates = written(_reaching(pairs, arrays, "bits", may_reach), "candidates")
    found = written(_reaching(candidates, arrays, "grams", reaches), "links")
    discard(candidates)
    return found, arrays


def _tile_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that their bitmaps let reach the similarity, tile by tile.

    Tiles come sorted by size, so a member meets the rows before it as far back as the
    size band goes, and no more of a tile is held.
    """
    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, window = None, []  # window: (node, comp, n, bits) of the tile so far, within the band
        for frame in frames:
            out = set()
            for h, node, comp, n, short, bits in zip(*(frame[c].tolist() for c in ("h", "node", "comp", "n", "short", "bits"))):
                if h != tile:
                    tile, window = h, []
                mine = np.frombuffer(bits, np.uint64)
                low = 0
                while low < len(window) and 100 * window[low][2] < percent * n:
                    low += 1
                window = window[low:]
                for other, c, m, theirs in window:
                    if c != comp and (100 + percent) * overlap_bound(theirs, m, mine, n) >= percent * (m + n):
                        out.add((min(node, other), max(node, other)))
                if short:
                    window.append((node, comp, n, mine))
            yield pd.DataFrame(sorted(out), columns=["a", "b"])

    return (members.repartition("h").sortWithinPartitions("h", "n", "node")
            .mapInPandas(pairs, "a long, b long"))


def _several(members: DataFrame, comps: DataFrame) -> DataFrame:
    """The members, with their component, of tiles that hold several components."""
    at = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    apart = at.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("h")
    return at.join(apart, "h", "left_semi")


def links_of_sets(sets: list[np.ndarray], copies: np.ndarray, first: int, percent: int) -> np.ndarray:
    """For each sorted set, the summed copies of the other sets at the similarity or more.

    With ``first``, only pairs of one of the first so many sets and one of the others count.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    owner, grams = np.repeat(np.arange(m), sizes), np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    owner, grams = owner[order], grams[order]
    same = grams[1:] == grams[:-1]
    shared = np.append(same, False) | np.insert(same, 0, False)  # n-grams of one set meet nothing
    owner, grams = owner[shared], grams[shared]
    column = np.cumsum(np.append(0, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, dtype=np.int64)
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64  # whole numbers, exact up to here
    a, b = (slice(0, first), slice(first, m)) if first else (slice(0, m), slice(0, m))
    both = np.zeros((a.stop - a.start, b.stop - b.start), dtype=kind)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        dense = np.zeros((m, int(column[part][-1]) - low + 1), dtype=kind)
        dense[owner[part], column[part] - low] = 1
        both += dense[a] @ dense[b].T
    near = (100 + percent) * both.astype(np.int64) >= percent * (sizes[a][:, None] + sizes[b][None, :])
    if first:
        return np.concatenate([near @ copies[b], copies[a] @ near])
    np.fill_diagonal(near, False)
    return near @ copies


def _link_counts(comps: DataFrame, nodes: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """node, links: rows of other sets at the similarity or more, for the nodes that have any.

    ``arrays`` has each node of ``comps`` once at least.
    """
    at = written(comps.join(nodes.select("node", "n", "copies"), "node"), "classes")
    # components of several blocks: how many sets of each size, and the weight before them
    weight = F.greatest("n", F.lit(LEAST))
    each = Window.partitionBy("comp")
    cells = at.groupBy("comp", "n").agg(F.count("*").alias("many"))
    cells = cells.select("comp", "n", "many", F.sum(F.col("many") * weight).over(each).alias("total"),
                         (F.sum(F.col("many") * weight).over(each.orderBy("n")) - F.col("many") * weight).alias("before"))
    cells = written(cells.where(F.col("total") > BLOCK).drop("total"), "cells")
    place = F.floor((F.col("before") + F.pmod(F.xxhash64("node"), F.col("many")) * weight) / BLOCK)
    placed = written(at.join(_few(cells), ["comp", "n"], "left").select("node", "comp", "n", "copies", place.alias("mine")), "placed")
    blocks = written(placed.where("mine is not null").groupBy("comp", "mine").agg(
        F.min("n").alias("low"), F.max("n").alias("high")), "blocks")
    pairs = (blocks.select("comp", F.col("mine").alias("block"), "high")
             .join(blocks.select("comp", F.col("mine").alias("other"), "low"), "comp")
             .where((F.col("block") <= F.col("other")) & (100 * F.col("high") >= percent * F.col("low"))))
    pairs = written(pairs.select("comp", "block", "other", F.explode(F.array_distinct(F.array("block", "other"))).alias("mine")), "dealt")
    dealt = placed.join(_few(pairs), ["comp", "mine"], "left").na.fill(0, ["block", "other", "mine"])
    dealt = _few(written(dealt, "members")).join(arrays.select("node", "grams"), "node")

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []  # held: (node, copies, whether of the first of two blocks, grams)

        def done() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            first = sum(h[2] for h in held)
            if first == len(held):  # the other block has no row here
                return []
            links = links_of_sets([h[3] for h in held], np.array([h[1] for h in held], dtype=np.int64), first, percent)
            return [(h[0], k) for h, k in zip(held, links.tolist()) if k]

        for frame in frames:
            out = []
            for *now, mine, node, copies, grams in zip(*(frame[c].tolist() for c in ("comp", "block", "other", "mine", "node", "copies", "grams"))):
                if now != key:
                    out += done()
                    key, held = now, []
                if not held or held[-1][0] != node:  # a node may have come in several rounds
                    held.append((node, copies, now[1] != now[2] and mine == now[1], np.frombuffer(grams, np.uint64)))
            yield pd.DataFrame(out, columns=["node", "links"], dtype="int64")
        yield pd.DataFrame(done(), columns=["node", "links"], dtype="int64")

    return (dealt.select("comp", "block", "other", "mine", "node", "copies", "grams")
            .repartition("comp", "block", "other").sortWithinPartitions("comp", "block", "other", "mine", "node")
            .mapInPandas(counts, "node long, links long").groupBy("node").agg(F.sum("links").alias("links")))


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                       percent: int = 90, count_links: bool = False) -> DataFrame:
    """One row per input row: id (as text), key, n (set size), comp (null for an empty set).

    Rows of one component share ``comp``. Null and empty texts have an empty set and no
    component; equal texts are always linked; an empty table gives an empty one. With
    ``count_links`` there is also n_links: how many other rows are at the similarity or more.
    """
    texts = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"),
                      F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("key"))
    features = written(_features(texts, width, percent, frequency_sketch(texts, width)), "features")
    rows = written(features.select("id", "key", "n", "node"), "rows")
    nodes = written(features.where("n > 0").groupBy("node").agg(
        F.min("n").alias("n"), F.min("key").alias("key"), F.min("mini").alias("mini"), F.count("*").alias("copies")), "nodes")
    # tiles that hold two different nodes at least
    most = F.col("n") - F.floor((2 * percent * F.col("n") + (99 + percent)) / (100 + percent)) + 1
    by_tile = Window.partitionBy("h")
    tiles = features.where("n > 0").select("node", "n", F.posexplode("prefix").alias("pos", "h"))
    tiles = tiles.select("h", "node", "n", (F.col("pos") < most).alias("short"),
                         F.min("node").over(by_tile).alias("low"), F.max("node").over(by_tile).alias("high"))
    tiles = written(tiles.where("low <> high").select("h", "node", "n", "short").distinct(), "tiles")
    discard(features)
    # members with a partner in their size band, the smaller one by its short prefix
    order = Window.partitionBy("h").orderBy("n", "node")
    before = F.max(F.when(F.col("short"), F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.when(F.col("short"), F.lead("n").over(order))
    banded = written(tiles.select("*", before.alias("before"), after.alias("after"))
                     .where((100 * F.col("before") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("after")))
                     .drop("before", "after"), "banded")
    discard(tiles)
    # one tile for each distinct set of members
    sign = banded.groupBy("h").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node", "short")).alias("x"),
                                  F.bit_xor(F.xxhash64("node", "short", F.lit(1))).alias("y"))
    members = written(banded.join(sign.groupBy("m", "x", "y").agg(F.min("h").alias("h")).select("h"), "h", "left_semi"), "members")
    discard(banded)
    # first, neighbours in the size order of a tile, if they aren't in one component already
    may_reach, _ = _tests(percent)
    tried = links = comps = arrays = None
    for lags in LAGS:
        at = members.withColumn("comp", F.col("node")) if comps is None else _several(members, comps)
        near = F.array(*[F.struct(F.lag("node", k).over(order).alias("other"), F.lag("n", k).over(order).alias("m"),
                                  F.lag("short", k).over(order).alias("short"), F.lag("comp", k).over(order).alias("comp")) for k in lags])
        pairs = (at.select("node", "n", "comp", near.alias("near")).select("node", "n", "comp", F.explode("near").alias("o"))
                 .where(F.col("o.short") & (100 * F.col("o.m") >= percent * F.col("n")) & (F.col("o.comp") != F.col("comp")))
                 .select(F.least("node", "o.other").alias("a"), F.greatest("node", "o.other").alias("b")).distinct())
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(_reaching(pairs, nodes, "mini", may_reach), "pairs")
        found, made = _verified(pairs, nodes, texts, width, percent)
        tried, links, arrays = ((pairs, found, made) if tried is None else
                                (tried.unionByName(pairs), links.unionByName(found), arrays.unionByName(made)))
        comps = connected_components(links)
    # then, whatever is left between different components of a tile
    left = written(_several(members, comps), "left")
    full = written(_arrays(texts, nodes.join(left.select("node").distinct(), "node").select("key", "node"), width)
                   .select("node", "bits"), "bits")
    more = _tile_pairs(left.join(full, "node").select("h", "node", "n", "comp", "short", "bits"), percent).distinct()
    more = written(more.join(tried, ["a", "b"], "left_anti"), "pairs")
    discard(full, left)
    found, made = _verified(more, nodes, texts, width, percent)
    comps = connected_components(links.unionByName(found))
    if count_links:
        others = _link_counts(comps, nodes, arrays.unionByName(made), percent)
        linked = nodes.select("node", "copies").join(comps, "node", "left").join(others, "node", "left")
        linked = written(linked.select("node", "comp", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
                         .where("n_links > 0"), "linked")
        return rows.join(linked, "node", "left").select("id", "key", "n", F.coalesce("comp", "node").alias("comp"),
                                                        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows.join(comps, "node", "left").select("id", "key", "n", F.coalesce("comp", "node").alias("comp"))


def component_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                  percent: int = 90) -> DataFrame:
    """One row per input row: doc_id, n_shingles, n_links (other rows at the similarity or more,
    copies among them; half their sum is the number of links), component_id (smallest id of
    the component)."""
    kind = df.schema[id_col].dataType
    rows = similar_components(df, id_col, text_col, width, percent, count_links=True).select(
        F.col("id").cast(kind).alias("doc_id"), "n", "comp", "n_links")
    first = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "n_links", F.coalesce("first", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                percent: int = 80) -> DataFrame:
    """``df`` without near copies, all columns kept: of each component the smallest id stays.

    Rows without a word belong to no component and all stay; null ids come last; of
    repeated rows (same id and text) that stay, one does. What is joined back are the keys
    of the rows that go, broadcast up to ``BROADCAST_ROWS``.
    """
    rows = written(similar_components(df, id_col, text_col, width, percent).where("comp is not null")
                   .select(F.col("id").cast(df.schema[id_col].dataType).alias("id"), "key", "comp"), "components")
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best"))
    kept = best.select("best.id", "best.key")
    each = rows.groupBy("id", "key").agg(F.count("*").alias("times"))
    marks = each.join(kept.withColumnRenamed("id", "kid").withColumnRenamed("key", "kkey"),
                      F.col("id").eqNullSafe(F.col("kid")) & (F.col("key") == F.col("kkey")), "left")
    marks = written(marks.select("id", "key", F.col("kkey").isNotNull().alias("stays"), "times")
                    .where("not stays or times > 1").distinct(), "marks")
    i, k, s = (temp_name(df, x) for x in ("id", "key", "stays"))
    wanted = marks.select(F.col("id").alias(i), F.col("key").alias(k), F.col("stays").alias(s))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    text_key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    own = temp_name(df, "own")
    out = df.withColumn(own, text_key).join(wanted, F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.col(own) == F.col(k)), "left")
    names = [F.col(f"`{c}`") for c in df.columns]
    clean = out.where(F.col(s).isNull()).select(*names)
    if marks.where("stays").isEmpty():
        return clean
    once = out.where(F.col(s)).dropDuplicates([id_col, own]).select(*names)
    return clean.unionByName(once)
