"""Benchmark decontamination by q-gram lemma filtering.

Texts are bytes, A-Z lower-cased, white space collapsed. A passage within ``k`` edits of a
benchmark item of length ``m`` shares at least ``m - q + 1 - k * q`` q-grams with it, on
diagonals (text position minus item position) that spread over at most ``k + 1``. So
shared q-grams are counted in bands of ``2 * (k + 1)`` diagonals that overlap by half;
bands that meet the bound are verified by a banded alignment, all bands of an item at once.

An item uses the longest q-gram with a bound of one at least, so its edits are never cut. A
q-gram that an item repeats many times (a line of dashes) is not counted place by place: the
diagonals that it covers go straight to the alignment. Long texts are searched in windows that
overlap by more than a passage. All of this changes the work, not the result: an end of a passage
is found if and only if some passage that ends there is within the item's edits.

The benchmark is taken in blocks of at most ``BLOCK_BYTES``, one broadcast at a time; every
document is read whole, one scan per block.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Bytes of a q-gram, the longest that fits an item first; eight fill one unsigned 64-bit number.
QS = (8, 5, 3, 2, 1)
#: Items of fewer bytes are searched as whole words, without edits.
Q = 8
#: Edits allowed, as a share of the item's length.
EDITS = 0.1
BLOCK_BYTES = 8_000_000
#: Bytes of a text searched at a time, hits held at a time, and how often an item may repeat a
#: q-gram whose places are counted.
WINDOW, HITS, REPEATS = 1 << 18, 1 << 21, 8
_FILTER_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal_bytes(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def grams(data: bytes, q: int = Q) -> np.ndarray:
    """All q-grams as numbers, by position."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, dtype="<u8")
    code = np.ndarray(shape=(n,), dtype="<u8", buffer=data + bytes(8 - q), strides=(1,))
    return code & np.uint64((1 << (8 * q)) - 1) if q < 8 else code


def expanded(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... times[0] numbers, then those of first[1], ..."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers, sorted."""
    numbers = np.sort(numbers)
    keep = np.ones(len(numbers), dtype=bool)
    np.not_equal(numbers[1:], numbers[:-1], out=keep[1:])
    return numbers[keep]


class GramTable:
    """Sorted q-grams of some items with their (item, offset) postings, and the repeated ones apart."""

    def __init__(self, q: int, items: list[int], data: list[bytes], edits: np.ndarray, bound: np.ndarray):
        self.q, self.edits, self.bound = q, edits, bound
        codes = [grams(data[i], q) for i in items]
        flat = np.concatenate(codes) if codes else np.zeros(0, dtype="<u8")
        item = np.repeat(np.array(items, dtype=np.int64), [len(c) for c in codes])
        offset = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, dtype=np.int64)
        order = np.lexsort((offset, item, flat))
        flat, item, offset = flat[order], item[order], offset[order]
        head = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (item[1:] != item[:-1])])) if len(flat) else np.zeros(0, np.int64)
        many = np.diff(np.append(head, len(flat)))
        often = many > REPEATS
        last = np.append(head[1:], len(flat)) - 1
        self.dense = self.table(flat[head[often]], item[head[often]], offset[head[often]], offset[last[often]])
        some = np.repeat(~often, many)
        self.rare = self.table(flat[some], item[some], offset[some], offset[some])
        self.least = int(bound[items].min()) if items else 1
        self.reach = int(offset.max()) + 1 if len(offset) else 1
        self.maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.maybe[(flat * _MIX) >> np.uint64(64 - _FILTER_BITS)] = True

    @staticmethod
    def table(code: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
        codes, first, times = np.unique(code, return_index=True, return_counts=True)
        return codes, first, times, item, low, high

    @staticmethod
    def hits(table: tuple, code: np.ndarray, pos: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(position, item, first offset, last offset) of the q-grams found, some at a time."""
        codes, first, times, item, low, high = table
        if not len(codes) or not len(pos):
            return
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        same = codes[at] == code
        pos, at = pos[same], at[same]
        ends = np.cumsum(times[at])
        cut = 0
        while cut < len(pos):
            to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + HITS, side="right")))
            post = expanded(first[at[cut:to]], times[at[cut:to]])
            yield np.repeat(pos[cut:to], times[at[cut:to]]), item[post], low[post], high[post]
            cut = to

    def bands(self, data: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, first band, last band) of the runs of bands that may hold a passage."""
        code = grams(data, self.q)
        pos = np.flatnonzero(self.maybe[(code * _MIX) >> np.uint64(64 - _FILTER_BITS)])
        code = code[pos]
        runs = []
        for p, item, low, high in self.hits(self.dense, code, pos):
            step = self.edits[item] + 1
            runs.append((item, (p - high) // step - 1, (p - low) // step))
        # an item position counts once in a band; each hit lies in two overlapping bands
        most = int(self.edits.max()) + 1 if len(self.edits) else 1
        base, size = -self.reach - most, len(data) + self.reach + 2 * most
        seen = []
        for p, item, offset, _ in self.hits(self.rare, code, pos):
            band = (p - offset) // (self.edits[item] + 1)
            keys = (np.concatenate([item, item]) * size + np.concatenate([band, band - 1]) - base) * self.reach + np.tile(offset, 2)
            seen.append(distinct(keys))
        if seen:
            of = (seen[0] if len(seen) == 1 else distinct(np.concatenate(seen))) // self.reach
            head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            count, of = np.diff(np.append(head, len(of))), of[head]
            enough = count >= self.least
            of, count = of[enough], count[enough]
            item, band = of // size, of % size + base
            enough = count >= self.bound[item]
            if enough.any():
                runs.append((item[enough], band[enough], band[enough]))
        if not runs:
            return
        item, low, high = (np.concatenate(x) for x in zip(*runs))
        order = np.lexsort((low, item))
        item, low, high = item[order], low[order], high[order]
        for i in np.unique(item).tolist():
            mine = slice(*np.searchsorted(item, [i, i + 1]))
            yield i, low[mine], np.maximum.accumulate(high[mine])


class BenchmarkIndex:
    """Items of a benchmark, ready to be searched for in texts."""

    def __init__(self, items: Iterable[tuple[int, str | None]], edits: float = EDITS):
        items = [(i, normal_bytes(t)) for i, t in items]
        self.short = [(i, b) for i, b in items if 0 < len(b) < Q]
        items = [(i, b) for i, b in items if len(b) >= Q]
        self.ids = [i for i, _ in items]
        self.bytes = [np.frombuffer(b, dtype=np.uint8) for _, b in items]
        length = np.array([len(b) for _, b in items], dtype=np.int64)
        self.edits = (length * edits).astype(np.int64)
        q = np.array([next(q for q in QS if m - q + 1 - k * q >= 1 or q == QS[-1]) for m, k in zip(length.tolist(), self.edits.tolist())], dtype=np.int64)
        bound = np.maximum(length - q + 1 - self.edits * q, 1)
        self.tables = [GramTable(x, np.flatnonzero(q == x).tolist(), [b for _, b in items], self.edits, bound) for x in QS if (q == x).any()]
        #: More than the longest passage, so every passage lies in one window.
        self.overlap = int((length + self.edits).max()) + 2 if len(length) else 0

    def search(self, text: str | None) -> list[tuple]:
        """(item id, end of the passage in the normalised bytes, edits), one per passage found.

        Places where passages of an item end, no farther apart than its edits, are one passage;
        it has the least edits of them and the first end with these.
        """
        data = normal_bytes(text)
        found = []
        for i, b in self.short:
            at = (b" " + data + b" ").find(b" " + b + b" ")
            if at >= 0:
                found.append((i, at + len(b), 0))
        ends: dict[int, list[np.ndarray]] = {}
        window = max(WINDOW, 4 * self.overlap)
        for at in range(0, max(1, len(data) - self.overlap), window - self.overlap):
            part = data[at:at + window]
            body = np.frombuffer(part, dtype=np.uint8)
            for table in self.tables:
                for i, low, high in table.bands(part):
                    end, least = self.align(self.bytes[i], body, int(self.edits[i]), low, high)
                    if len(end):
                        ends.setdefault(i, []).append(np.stack([end + at, least]))
        for i in sorted(ends):
            end, least = np.concatenate(ends[i], axis=1)
            order = np.lexsort((least, end))
            end, least = end[order], least[order]
            for group in np.split(np.arange(len(end)), np.flatnonzero(np.diff(end) > max(1, self.edits[i])) + 1):
                best = group[np.argmin(least[group])]
                found.append((self.ids[i], int(end[best]), int(least[best])))
        return found

    @staticmethod
    def align(item: np.ndarray, body: np.ndarray, k: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ends, edits) of the passages within ``k`` edits of the whole item, on the diagonals of
        the runs of bands low..high. Passing from one run to the next costs every byte between."""
        first = np.maximum(low * (k + 1) - k, -len(item))
        last = np.minimum((high + 2) * (k + 1) + k, len(body))
        apart = np.concatenate([[True], first[1:] > np.maximum.accumulate(last)[:-1]])
        heads = np.flatnonzero(apart)
        first, last = first[heads], np.maximum.reduceat(last, heads)
        real = last >= first
        first, last = first[real], last[real]
        start = expanded(first, last - first + 1) if len(first) else np.zeros(0, np.int64)
        next_to = np.diff(start) == 1
        inf = len(item) + 1
        row = np.where((start >= 0) & (start <= len(body)), 0, inf)  # a passage may begin anywhere on a band
        if not len(start):
            return start, row
        m = len(item)
        padded = np.concatenate([np.zeros(m, np.uint8), body, np.zeros(m, np.uint8)])
        edge = start[0] < 1 or start[-1] + m > len(body)
        for r in range(1, m + 1):  # r + start bytes of the text are consumed
            new = row + (padded[start + (m + r - 1)] != item[r - 1])
            if edge:
                new[(start < 1 - r) | (start > len(body) - r)] = inf
            new[:-1] = np.where(next_to, np.minimum(new[:-1], row[1:] + 1), new[:-1])
            if edge:
                new[(start < -r) | (start > len(body) - r)] = inf
            row = np.minimum(np.minimum.accumulate(new - start) + start, inf)
            if edge:
                row[(start < -r) | (start > len(body) - r)] = inf
        near = row <= k
        return (start + len(item))[near], row[near]


def index_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 edits: float = EDITS) -> Iterator[BenchmarkIndex]:
    """The benchmark's items in blocks of bounded size; null and empty items are left out."""
    block, size = [], 0
    items = benchmark.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).orderBy(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    for i, t in items.toLocalIterator():
        block.append((i, t))
        size += len(t or "")
        if size >= BLOCK_BYTES:
            yield BenchmarkIndex(block, edits)
            block, size = [], 0
    if block:
        yield BenchmarkIndex(block, edits)


def passages_column(shared, text: Column, id_type: str) -> Column:
    @F.pandas_udf(f"array<struct<item_id:{id_type},end:int,edits:int>>")
    def passages(texts: pd.Series) -> pd.Series:
        search = shared.value.search
        return pd.Series([[dict(zip(("item_id", "end", "edits"), p)) for p in search(t)] for t in texts], dtype=object)

    return passages(text)


def find_passages(df: DataFrame, benchmark: DataFrame, out_col: str, text_col: str = "text",
                  edits: float = EDITS) -> DataFrame:
    """``df`` and the benchmark passages of each row's text: array of (item_id, end, edits).

    Null and empty texts and an empty benchmark give empty arrays; no row is lost, repeated rows
    have the same passages, texts of any length are searched whole; equal items are found each.
    Item ids may be of any type. Between blocks of the benchmark the rows are written, so one
    block's broadcast is alive at a time.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    out, before, shared = df.withColumn(out_col, F.array().cast(f"array<struct<item_id:{kind},end:int,edits:int>>")), None, None
    for index in index_blocks(benchmark, edits=edits):
        if shared is not None:
            out = written(out, "passages")
            shared.unpersist()
            if before is not None:
                discard(before)
            before = out
        shared = df.sparkSession.sparkContext.broadcast(index)
        out = out.withColumn(out_col, F.concat(F.col(f"`{out_col}`"), passages_column(shared, F.col(f"`{text_col}`"), kind)))
    return out


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, contaminated, item_ids (sorted), least edits, n_passages.

    As ``find_passages``; a row without passages has null edits. Extra columns are ignored.
    """
    rows = find_passages(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")),
                         benchmark, "passages")
    return rows.select(
        "doc_id", (F.size("passages") > 0).alias("contaminated"),
        F.sort_array(F.array_distinct("passages.item_id")).alias("item_ids"),
        F.array_min("passages.edits").alias("edits"), F.size("passages").alias("n_passages"))
