"""Audit of how far the sources of a language differ in the terms they use.

1. In ``mapInArrow`` a batch's texts are lower-cased (``ascii_lower``), split
   (``split_pattern_regex``), their terms coded (``dictionary_encode``) and counted by hash
   ``group_by``: per document first, then per (lang, source, term) with the number of documents.
   A task keeps merging these tables and hands out few rows.
2. Spark merges the partial counts and keeps a language's terms that are in enough documents.
3. The kept counts are dealt into columnar shards by (lang, hash of term). A shard holds the
   non-zero counts of its terms and its language's sources; it computes the divergences of its
   terms exactly, in whole numbers, and hands out one partial sum per pair of sources and each
   source's largest terms.

A term that a source lacks has the same smoothed share whatever the term is, so a pair's sum over
all terms is that of two constants, plus corrections for the terms that one or both sources have.
Work follows the non-zero counts, not terms x sources x sources.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: What stands between terms; a term is ASCII letters and everything beyond ASCII.
BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCUMENTS, TOP_TERMS = 3, 200
#: Shares are whole numbers of a billionth.
UNIT = 1_000_000_000
#: Bytes of text counted at a time, rows that a task merges before it hands them out, rows of a
#: shard, and numbers held at a time inside a shard.
SLICE_BYTES, MERGED_ROWS, SHARD_ROWS, HELD = 4_000_000, 1 << 18, 1 << 17, 1 << 20
COUNTS = "lang string, source string, term string, n long, docs long"
VALUES = "lang string, source string, part string, item string, value decimal(38,0)"
_KEYS = ["lang", "source", "term"]


def count_terms(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """lang, source, term, n (occurrences), docs (texts that hold it) of some texts."""
    words = pc.split_pattern_regex(pc.ascii_lower(text), BREAK)
    flat, row = pc.list_flatten(words), pc.list_parent_indices(words)
    some = pc.greater(pc.binary_length(flat), 0)
    coded = pc.dictionary_encode(flat.filter(some))
    each = pa.table({"row": row.filter(some), "term": coded.indices}).group_by(["row", "term"]).aggregate([([], "count_all")])
    row = each["row"].combine_chunks()
    group = pa.table({"lang": lang.dictionary_encode().indices, "source": source.dictionary_encode().indices}).take(row)
    both = group.append_column("term", each["term"]).append_column("n", each["count_all"]).append_column("row", row)
    out = both.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("n", "count"), ("row", "min")])
    at = out["row_min"]
    return pa.table({"lang": lang.take(at.combine_chunks()), "source": source.take(at.combine_chunks()),
                     "term": coded.dictionary.take(out["term"].combine_chunks()), "n": out["n_sum"], "docs": out["n_count"]})


def merged(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(_KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns([*_KEYS, "n", "docs"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        lang, source, text = (batch[c].cast(pa.string()) for c in ("lang", "source", "text"))
        present = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"]).aggregate([])
        none = pa.array([0] * len(present), pa.int64())
        held.append(pa.table({"lang": present["lang"], "source": present["source"],
                              "term": pa.nulls(len(present), pa.string()), "n": none, "docs": none}))
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < len(text):
            base = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
            held.append(count_terms(*(x.slice(low, high - low) for x in (lang, source, text))))
            rows, low = rows + len(held[-1]), high
            if rows > 2 * MERGED_ROWS:
                held = [merged(held)]
                rows = len(held[0])
                if rows > MERGED_ROWS:
                    yield from held[0].combine_chunks().to_batches()
                    held, rows = [], 0
    if held:
        yield from merged(held).combine_chunks().to_batches()


def term_counts(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n, docs over all rows; each (lang, source) also has a row without a term."""
    rows = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(x)
                       for c, x in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    return rows.mapInArrow(_partial, COUNTS).groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: np.ndarray, total: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (total + size)), exactly."""
    if len(count) and int(count.max()) >= (1 << 62) // UNIT:
        exact = 1 + UNIT * (count.astype(object) + 1) // (total.astype(object) + size.astype(object))
        return exact.astype(np.int64)
    return 1 + UNIT * (count + 1) // (total + size)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _distinct(group: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct (group, share) pairs in order, with how often each occurs."""
    order = np.lexsort((share, group))
    group, share = group[order], share[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(group) != 0) | (np.diff(share) != 0)]))
    return group[first], share[first], np.diff(np.append(first, len(group)))


def pair_sums(term: np.ndarray, group: np.ndarray, share: np.ndarray, absent: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of rows (first group, sums): what a shard's terms add to each pair's sum of constants.

    ``absent`` is each group's share of a term that it lacks. Sums are exact as long as a pair's
    own sum is: they wrap around at 64 bits.
    """
    order = np.argsort(term, kind="stable")
    term, group, share = term[order], group[order], share[order]
    start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    size = np.diff(np.append(start, len(term)))
    low, many = np.repeat(start, size), np.repeat(size, size)  # of each row: its term's first row, number of rows
    by_group = np.argsort(group, kind="stable")
    own, own_share, own_times = _distinct(group, share)
    heads = np.flatnonzero(np.concatenate([[True], np.diff(own) != 0]))
    block = max(1, HELD // max(len(absent), len(own)))
    for first in range(0, len(absent), block):
        z = absent[first:first + block]
        both_absent = _divergence(z[:, None], absent[None, :])
        sums = np.zeros((len(z), len(absent)), dtype=np.int64)
        # terms that the row's source has, whatever the other has: by distinct shares
        at = np.flatnonzero((own >= first) & (own < first + block))
        for cut in range(0, len(at), block):
            some = at[cut:cut + block]
            g = own[some] - first
            more = (_divergence(own_share[some][:, None], absent[None, :]) - both_absent[g]) * own_times[some][:, None]
            np.add.at(sums, g, more)
        # terms that the other source has, whatever the row's has
        more = (_divergence(z[:, None], own_share[None, :]) - both_absent[:, own]) * own_times[None, :]
        sums[:, own[heads]] += np.add.reduceat(more, heads, axis=1)
        # terms that both have
        rows = by_group[np.searchsorted(group[by_group], first):np.searchsorted(group[by_group], first + block)]
        ends = np.cumsum(many[rows])
        cut = 0
        while cut < len(rows):
            base = int(ends[cut - 1]) if cut else 0
            to = max(cut + 1, int(np.searchsorted(ends, base + HELD, side="right")))
            some = rows[cut:to]
            n = many[some]
            i = np.repeat(some, n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[some], n)
            g, h = group[i], group[j]
            more = (_divergence(share[i], share[j]) - _divergence(share[i], absent[h])
                    - _divergence(absent[g], share[j]) + _divergence(absent[g], absent[h]))
            np.add.at(sums, (g - first, h), more)
            cut = to
        yield first, sums


def _shard(top: int):
    def shard(counts: pa.Table, sources: pa.Table) -> pa.Table:
        lang = sources["lang"][0].as_py()
        sources = sources.sort_by("source")
        names = sources["source"].combine_chunks()
        n, size = (sources[c].to_numpy() for c in ("total", "size"))
        absent = _share(np.zeros(len(n), np.int64), n, size)
        out = []

        def add(group: np.ndarray, part: str, items: pa.Array, values: np.ndarray):
            if len(group):
                out.append(pa.table({
                    "lang": pa.array([lang] * len(group), pa.string()), "source": names.take(pa.array(group)),
                    "part": pa.array([part] * len(group), pa.string()), "item": items,
                    "value": pa.array(values, pa.int64()).cast(pa.decimal128(38, 0))}))

        if len(counts):
            group = pc.index_in(counts["source"].combine_chunks(), names).to_numpy()
            coded = pc.dictionary_encode(counts["term"].combine_chunks())
            term, count, all_n = coded.indices.to_numpy(), counts["n"].to_numpy(), counts["lang_n"].to_numpy()
            p = _share(count, n[group], size[group])
            for first, sums in pair_sums(term, group, p, absent):
                g, h = np.nonzero(sums)
                apart = g + first != h
                g, h = g[apart], h[apart]
                add(g + first, "pair", names.take(pa.array(h)), sums[g, h])
            q = _share(all_n, np.broadcast_to(sources["lang_total"].to_numpy()[:1], len(all_n)), np.broadcast_to(size[:1], len(all_n)))
            over = np.flatnonzero(p > q)
            value = _divergence(p[over], q[over])
            place = pc.array_sort_indices(coded.dictionary)  # terms in UTF-8 order
            rank = np.empty(len(place), np.int64)
            rank[place.to_numpy()] = np.arange(len(place))
            order = np.lexsort((rank[term[over]], -value, group[over]))
            over, value = over[order], value[order]
            heads = np.flatnonzero(np.concatenate([[True], np.diff(group[over]) != 0])) if len(over) else np.zeros(0, np.int64)
            within = np.arange(len(over)) - np.repeat(heads, np.diff(np.append(heads, len(over))))
            kept = within < top
            over, value = over[kept], value[kept]
            add(group[over], "term", coded.dictionary.take(pa.array(term[over])), value)
        if not out:
            return pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()),
                              ("value", pa.decimal128(38, 0))]).empty_table()
        return pa.concat_tables(out)

    return shard


def source_divergence(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                      min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """lang, source, part, item, value, rank: every source against each other one of its language
    (part ``pair``), and the terms that set it apart from the language (part ``term``).

    A row is a document, repeated ones too; null lang, source and text count as empty strings.
    Ties in value rank by item, in UTF-8 order. A language without a kept term has pairs of value
    0 and no terms; an empty table gives an empty one. Extra columns are ignored. A text is
    counted whole; one of 2 GB or more does not fit an Arrow array.
    """
    counts = written(term_counts(df, lang_col, source_col, text_col), "term-counts")
    by_term = Window.partitionBy("lang", "term")
    kept = (counts.where(F.col("term").isNotNull())
            .select("lang", "source", "term", "n", F.sum("n").over(by_term).alias("lang_n"), F.sum("docs").over(by_term).alias("lang_docs"),
                    (F.row_number().over(by_term.orderBy("source")) == 1).alias("head"))
            .where(F.col("lang_docs") >= min_documents))
    kept = written(kept, "kept-terms")
    sizes = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("head").alias("size"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    sources = (counts.where(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left")
               .join(sizes, "lang", "left")
               .select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("total", "lang_total", "size"))))
    sources = written(sources, "sources")
    shards = -(-kept.count() // shard_rows) or 1
    dealt = kept.select("lang", "source", "term", "n", "lang_n", F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard"))
    seats = sources.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    values = dealt.groupBy("lang", "shard").cogroup(seats.groupBy("lang", "shard")).applyInArrow(_shard(top_terms), VALUES)
    values = written(values, "shard-values")
    absent = F.expr(f"1 + ({UNIT}L div (total + size))")
    a = sources.where("size > 0").select("lang", "source", "size", absent.alias("p"))
    flat = F.col("size").cast("decimal(20,0)") * F.expr("((p - q) * (p - q)) div q")
    empty = sources.where("size = 0").select("lang", "source")
    other = lambda df, *more: df.select("lang", F.col("source").alias("item"), *more)
    base = a.join(other(a, F.col("p").alias("q")), "lang").where("source <> item").select("lang", "source", "item", flat.alias("value"))
    base = base.unionByName(empty.join(other(empty), "lang").where("source <> item").withColumn("value", none))
    pairs = (base.select("lang", "source", F.lit("pair").alias("part"), "item", F.col("value").cast("decimal(38,0)").alias("value"))
             .unionByName(values.where("part = 'pair'"))
             .groupBy("lang", "source", "part", "item").agg(F.sum("value").cast("long").alias("value")))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(place)
    terms = values.where("part = 'term'").withColumn("value", F.col("value").cast("long")).withColumn("rank", rank)
    return pairs.withColumn("rank", rank).unionByName(terms.where(F.col("rank") <= top_terms))
