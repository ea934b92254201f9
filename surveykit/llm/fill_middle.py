"""Fill-in-middle transformation over a Roaring-style set of unit boundaries.

The byte offsets at which a text's units (code points, words or lines) begin, and the text's
end, form a set of n + 1 numbers. They are kept in containers of 65,536 offsets: a sorted array,
a bitmap or a list of runs, whichever is smallest. Containers carry cumulative cardinalities, so
the k-th boundary is found by a search over the containers and a select inside one of them. Both
cuts come from such selects; Spark then slices the text's bytes and assembles the output.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: offsets of one container, and the most that an array holds.
CONTAINER, ARRAY_MOST = 1 << 16, 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
CUTS = "n long, first long, second long"


def _characters(data: np.ndarray, before: int) -> np.ndarray:
    return (data & 0xC0) != 0x80


def _words(data: np.ndarray, before: int) -> np.ndarray:
    space = (data == 32) | ((data >= 9) & (data <= 13))
    after = np.concatenate([[before < 0 or before == 32 or 9 <= before <= 13], space[:-1]])
    start = after & ~space
    if before < 0:
        start[0] = True
    return start


def _lines(data: np.ndarray, before: int) -> np.ndarray:
    return np.concatenate([[before < 0 or before == 10], data[:-1] == 10])


#: Where a unit starts, given a piece of a text's bytes and the byte before it (-1 at the start).
#: A word takes the white space after it along; white space at a text's start is a unit of its own.
UNITS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"char": _characters, "word": _words, "line": _lines}


class ArrayContainer:
    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, i: int) -> int:
        return int(self.low[i])


class BitmapContainer:
    def __init__(self, low: np.ndarray):
        bits = np.zeros(CONTAINER, dtype=np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, i: int) -> int:
        word = int(np.searchsorted(self.before, i, side="right")) - 1
        bits = int(self.words[word])
        for _ in range(i - int(self.before[word])):
            bits &= bits - 1
        return 64 * word + (bits & -bits).bit_length() - 1


class RunContainer:
    def __init__(self, low: np.ndarray, first: np.ndarray):
        self.start = low[first].astype(np.uint16)
        self.before = np.append(first, len(low))

    def select(self, i: int) -> int:
        run = int(np.searchsorted(self.before, i, side="right")) - 1
        return int(self.start[run]) + i - int(self.before[run])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest form of ascending offsets below 65,536."""
    first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    runs = 4 * len(first) + 2
    if runs < min(2 * len(low), CONTAINER // 8):
        return RunContainer(low, first)
    return ArrayContainer(low) if len(low) <= ARRAY_MOST else BitmapContainer(low)


class BoundarySet:
    """The boundaries of one text; ``len()`` counts them, ``select(k)`` is the k-th one's offset."""

    def __init__(self, data: np.ndarray, starts: Callable[[np.ndarray, int], np.ndarray] = _characters):
        self.keys, self.containers, before = [], [], [0]
        size = len(data)
        for key in range(size // CONTAINER + 1):
            at = key * CONTAINER
            piece = data[at:at + CONTAINER]
            low = np.flatnonzero(starts(piece, int(data[at - 1]) if at else -1)) if len(piece) else np.zeros(0, np.int64)
            if size < at + CONTAINER:
                low = np.append(low, size - at)  # the text's end
            if len(low):
                self.keys.append(key)
                self.containers.append(container(low))
                before.append(before[-1] + len(low))
        self.before = np.array(before, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return CONTAINER * self.keys[at] + self.containers[at].select(k - int(self.before[at]))


def cuts(text: Column, a: Column, b: Column, unit: str = "char") -> Column:
    """struct(n, first, second): a text's number of units, and the byte offsets of its boundaries
    number a mod (n + 1) and b mod (n + 1), the smaller first."""
    starts = UNITS[unit]

    @F.arrow_udf(CUTS)
    def find(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        out = np.empty((3, len(texts)), dtype=np.int64)
        for i, (low, high, x, y) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), a.to_pylist(), b.to_pylist())):
            bounds = BoundarySet(data[low:high], starts)
            m = len(bounds)
            x, y = x % m, y % m
            out[:, i] = m - 1, bounds.select(min(x, y)), bounds.select(max(x, y))
        return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n", "first", "second"])

    return find(text, a, b)


def _number(digest: Column, group: int) -> Column:
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: str = "1",
                   plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Every row of ``df`` with n, form, prefix_chars, middle_chars (units; null if plain) and output.

    The id's sha256 (with ``seed``) draws the cuts and the form, so reruns and lost tasks agree
    and equal ids are cut alike, relative to their own lengths. A null text counts as empty, a
    null id as empty text. Empty texts and those that hold one of the three marks stay plain. An
    empty table gives an empty one; columns of ``df`` that bear one of the new names (in any case)
    are replaced, others are kept.
    """
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [_number(digest, i) for i in range(4)]
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = (F.when((text == "") | marked | (h[2] % 100 >= 100 - plain_percent), "plain")
            .when(h[3] % 100 < spm_percent, "spm").otherwise("psm"))
    others = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]
    rows = df.select(F.struct(*others).alias("row"), text.alias("text"), form.alias("form"), h[0].alias("a"), h[1].alias("b"))
    rows = rows.select("row", "text", "form", "a", "b", cuts(F.col("text"), F.col("a"), F.col("b"), unit).alias("cut"))
    data, first, second = F.col("text").cast("binary"), F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix = F.substr(data, F.lit(1), first).cast("string")
    middle = F.substr(data, first + 1, second - first).cast("string")
    suffix = F.substr(data, second + 1, F.length(data) - second).cast("string")
    output = (F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
              .otherwise(F.col("text")))
    x, y = (F.pmod(F.col(c), F.col("cut.n") + 1) for c in "ab")
    units = lambda c: F.when(F.col("form") != "plain", c)
    return rows.select("row.*", F.col("cut.n").alias("n"), "form", units(F.least(x, y)).alias("prefix_chars"),
                       units(F.abs(x - y)).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from an output and its form alone."""
    mark = len(PREFIX)
    rest = F.substring(output, mark + 1, 2**31 - 1)
    before = lambda value, end: F.call_function("substring_index", value, end, F.lit(1))
    one = before(rest, F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)))
    rest = F.substr(rest, F.length(one) + mark + 1, F.lit(2**31 - 1))
    two = before(rest, F.lit(MIDDLE))
    three = F.substr(rest, F.length(two) + mark + 1, F.lit(2**31 - 1))
    return (F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one))
            .otherwise(output))
