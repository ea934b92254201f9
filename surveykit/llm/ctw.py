"""Language-model scoring by context-tree weighting over bytes.

A text is the bytes of its lower-cased words, joined by single spaces and closed by a line
feed, so a score is the probability of the text's word sequence. A byte is eight binary
decisions, each in the tree node of the bits before it; for each such node, contexts are
the last 0 to ``DEPTH`` bytes. In every context a Krichevsky-Trofimov estimate competes
with the contexts one byte longer, at even prior odds; the posterior weights after
training mix the estimates of all depths. A context that training never saw adds nothing:
the mixture ends at the deepest one seen. The model is fixed after training.

What is counted are the (context, byte) grams of all training texts, with the grams that
other texts need at count 0:

1. ``requests``: a block of documents (rows of one input file) gives its distinct grams
   with counts, packed by the hash of their last two context bytes (and its words by hash).
2. A packed part holds whole context subtrees below depth 2; depths 0 and 1 are at most
   65,536 nodes and are summed over parts, then broadcast.
3. Each part answers every block with the log-probabilities of its grams.
4. Texts meet their block's answers; a text's score is a sum of table look-ups.

Nothing corpus-sized is broadcast or collected; parts and blocks are spread by hash.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, written

#: Longest context in bytes (at most 7: a gram is one 64-bit number).
DEPTH = 6
#: Bytes of text that make one block, about: a block is a range of rows of an input file, as many
#: as hold this much at the largest mean length of a file.
BLOCK_BYTES = 24_000_000
#: Bytes of text coded at a time inside a task, and of an Arrow batch: a worker holds these beside its block's
#: distinct grams and words, not the block's text.
CHUNK, BATCH_BYTES = 1_000_000, 2 << 20
PACKED = "kind string, part int, block string, keys binary, counts binary"
ANSWER = "block string, kind string, keys binary, vals binary"
_U8 = np.uint64(8)
_TABLE = 1 << 16


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def gram_chunks(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, text number) of all bytes of the texts, a chunk at a time.

    A gram is the seven bytes before (most recent first; those beyond ``DEPTH`` are 0) and
    the byte itself, most significant first. Line feeds stand before a text's first byte.
    """
    data = b"".join(b"\n" * 7 + b" ".join(words) + b"\n" for words in texts)
    lengths = np.array([sum(map(len, words)) + max(len(words) - 1, 0) + 8 for words in texts], dtype=np.int64)
    windows = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    inside = np.ones(len(data), dtype=bool)  # of windows, by their first byte: those that end inside their text
    inside[(np.cumsum(lengths)[:, None] - np.arange(1, 8)).ravel()] = False
    drop = np.uint64((1 << (8 * (8 - DEPTH))) - 1)  # context bytes beyond the depth, and the byte itself
    text = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    for low in range(0, len(windows), CHUNK):
        part = inside[low:low + CHUNK][:len(windows) - low]
        w = windows[low:low + CHUNK][part]
        codes = w << _U8
        codes &= ~drop
        w >>= np.uint64(56)
        codes |= w
        yield codes, text[low:low + CHUNK][:len(part)][part]


def pack(keys: np.ndarray) -> bytes:
    """Sorted numbers as byte planes of their differences, deflated."""
    step = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zlib.compress(step.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_logs(values: np.ndarray) -> bytes:
    """Log-probabilities at 16 bits of mantissa, as deflated byte planes."""
    bits = (values.astype("<f4").view("<u4") + np.uint32(0x40)) & np.uint32(0xFFFFFF80)
    return zlib.compress(bits.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_logs(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<f4").ravel()


def deflate(numbers: np.ndarray) -> bytes:
    return zlib.compress(numbers.tobytes(), 1)


class GramCounts:
    """Distinct grams with counts; what was added is merged once it is half of them."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.parts, self.size = [], 0

    def add(self, grams: np.ndarray, weight: int):
        if len(grams):
            keys, n = np.unique(grams, return_counts=True)
            self.parts.append((keys, n * weight))
            self.size += len(keys)
            if self.size > max(500_000, len(self.keys) // 2):
                self.merge()

    def merge(self):
        parts, self.parts, self.size = [(self.keys, self.counts), *self.parts], [], 0
        keys = np.concatenate([k for k, _ in parts])
        keys.sort(kind="stable")  # of sorted runs
        self.keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        del keys
        self.counts = np.zeros(len(self.keys), np.int64)
        while parts:
            k, n = parts.pop()
            self.counts[np.searchsorted(self.keys, k)] += n


def gram_part(keys: np.ndarray, parts: int) -> np.ndarray:
    pair = keys >> np.uint64(48)
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % parts


def _blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, training and block (file and row range, the same in every scan)."""
    try:
        df.select("_metadata.row_index").schema  # noqa: B018
    except Exception:  # not read from files yet
        df = written(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), "texts")
    size = F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) + 8
    mean = df.groupBy("_metadata.file_path").agg(F.avg(size).alias("mean")).agg(F.max("mean")).first()[0]
    block_rows = max(1, int(BLOCK_BYTES / (mean or BLOCK_BYTES)))
    block = F.concat_ws("#", "_metadata.file_path", F.floor(F.col("_metadata.row_index") / block_rows))
    return df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"),
                     (~held_out(F.col(f"`{id_col}`"))).alias("training"), block.alias("block"))


def _requests(parts: int):
    def requests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush() -> pd.DataFrame:
            grams.merge()
            where = gram_part(grams.keys, parts)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(parts + 1))
            rows = []
            for p in range(parts):
                i = order[cuts[p]:cuts[p + 1]]
                if len(i):
                    rows.append(("gram", p, block, pack(grams.keys[i]), deflate(grams.counts[i])))
            by_part: dict = {}
            for w in sorted(words):
                by_part.setdefault(xxhash.xxh3_64_intdigest(w) % parts, []).append(w)
            for p, ws in by_part.items():
                rows.append(("word", p, block, zlib.compress(b" ".join(ws), 1),
                             deflate(np.array([words[w] for w in ws], np.int64))))
            rows.append(("end", 0, block, None, deflate(np.array([docs], np.int64))))
            return pd.DataFrame(rows, columns=["kind", "part", "block", "keys", "counts"])

        block, grams, words, docs = None, GramCounts(), Counter(), 0
        for frame in frames:
            for name, rows in frame.groupby("block", sort=False):
                if name != block:
                    if block is not None:
                        yield flush()
                    block, grams, words, docs = name, GramCounts(), Counter(), 0
                for training, some in rows.groupby("training"):
                    held, size = [], 0
                    for text in [*some["text"], False]:
                        if text is False or size > CHUNK:
                            for codes, _ in gram_chunks(held) if held else ():
                                grams.add(codes, int(training))
                            held, size = [], 0
                        if text is not False:
                            ws = words_of(text)
                            if training:
                                words.update(ws)
                                docs += 1
                            else:
                                words.update(dict.fromkeys(ws, 0))
                            held.append(ws)
                            size += len(text or "")
        if block is not None:
            yield flush()

    return requests


def _word_answers(frame: pd.DataFrame) -> pd.DataFrame:
    """Every block's words of one part with their counts over all blocks; the part's totals."""
    lists = [zlib.decompress(k).split(b" ") for k in frame["keys"]]
    total: Counter = Counter()
    for ws, c in zip(lists, frame["counts"]):
        for w, n in zip(ws, np.frombuffer(zlib.decompress(c), np.int64).tolist()):
            total[w] += n
    rows = [(b, "word", k, deflate(np.array([total[w] for w in ws], np.int64)))
            for b, k, ws in zip(frame["block"], frame["keys"], lists)]
    sums = np.array([sum(total.values()), sum(n > 0 for n in total.values())], np.int64)
    rows.append((None, "total", None, sums.tobytes()))
    return pd.DataFrame(rows, columns=["block", "kind", "keys", "vals"])


_small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE - 1) + 0.5))])
_small_f = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, _TABLE)))])


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x)


def ln_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    def half(n):  # ln gamma(n + 1/2) - ln gamma(1/2)
        return np.where(n < _TABLE, _small[np.minimum(n, _TABLE - 1)], _stirling(np.maximum(n, 1) + 0.5) - 0.5 * np.log(np.pi))

    def factorial(n):
        return np.where(n < _TABLE, _small_f[np.minimum(n, _TABLE - 1)], _stirling(np.maximum(n, 1) + 1.0))

    return half(a) + half(b) - factorial(a + b)


class Subtrees:
    """The context nodes at depths 2 to ``DEPTH`` of one part's grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        sym, ctx = keys & np.uint64(255), keys >> np.uint64(8 * (8 - DEPTH))
        node, zeros, ones, self.bits = [], [], [], []
        for k in range(8):
            prefix = np.uint64(1 << k) | (sym >> np.uint64(8 - k))
            bit = ((sym >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
            node.append((ctx << _U8) | prefix)
            zeros.append(np.where(bit, 0, counts))
            ones.append(np.where(bit, counts, 0))
            self.bits.append(bit)
        node, a, b, self.leaf = self.gather(np.concatenate(node), np.concatenate(zeros), np.concatenate(ones))
        self.leaf = self.leaf.reshape(8, -1)
        value = ln_kt(a, b)
        self.levels = [(a, b, np.ones(len(a)))]
        self.parent = []
        for _ in range(DEPTH - 2):
            node, a, b, below, up = self.gather(((node >> np.uint64(16)) << _U8) | (node & np.uint64(255)), a, b, value)
            kt = ln_kt(a, b)
            self.levels.append((a, b, 1 / (1 + np.exp(np.clip(below - kt, -700, 700)))))
            self.parent.append(up)
            value = np.logaddexp(kt, below) - np.log(2)
        self.node, self.value = node, value  # at depth 2

    @staticmethod
    def gather(node: np.ndarray, *sums: np.ndarray) -> tuple:
        order = np.argsort(node, kind="stable")
        node = node[order]
        first = np.concatenate([[True], node[1:] != node[:-1]])
        inverse = np.empty(len(node), np.int64)
        inverse[order] = np.cumsum(first) - 1
        first = np.flatnonzero(first)
        return node[first], *(np.add.reduceat(s[order], first) for s in sums), inverse

    def top(self) -> tuple[np.ndarray, ...]:
        """Depth-1 nodes (b1 << 8 | bits): index, zeros, ones, sum of the values below."""
        a, b, _ = self.levels[-1]
        up = ((self.node >> np.uint64(16)) << _U8) | (self.node & np.uint64(255))
        node, a, b, below, _ = self.gather(up, a, b, self.value)
        return node.astype(np.int64), a, b, below

    def log10(self, top: np.ndarray) -> np.ndarray:
        """log10 probability of each gram. ``top``: for depths 1 and 0, rows of (P of a one, weight, seen)."""
        a, b, _ = self.levels[0]
        p, seen = (b + 0.5) / (a + b + 1.0), a + b > 0
        at = np.arange(len(a))
        for (a, b, w), up in zip(self.levels[1:], self.parent):
            at = up[at]
            kt = (b[at] + 0.5) / (a[at] + b[at] + 1.0)
            p = np.where(seen, w[at] * kt + (1 - w[at]) * p, kt)
            seen = a[at] + b[at] > 0
        node = self.node[at]
        for index in ((((node >> np.uint64(16)) << _U8) | (node & np.uint64(255))).astype(np.int64),
                      65536 + (node & np.uint64(255)).astype(np.int64)):
            kt, w, known = top[0][index], top[1][index], top[2][index] > 0
            p = np.where(seen, w * kt + (1 - w) * p, kt)
            seen = known
        p = np.clip(p, 1e-12, 1 - 1e-12)
        one, zero = np.log10(p), np.log10(1 - p)
        return sum(np.where(bit, one[i], zero[i]) for bit, i in zip(self.bits, self.leaf))


def _subtrees(frame: pd.DataFrame) -> tuple[Subtrees, GramCounts, list[np.ndarray]]:
    lists = [unpack(k) for k in frame["keys"]]
    merged = GramCounts()
    merged.parts = [(k, np.frombuffer(zlib.decompress(c), np.int64)) for k, c in zip(lists, frame["counts"])]
    merged.merge()
    return Subtrees(merged.keys, merged.counts), merged, lists


def _top_nodes(frame: pd.DataFrame) -> pd.DataFrame:
    node, a, b, below = _subtrees(frame)[0].top()
    return pd.DataFrame({"node": node, "zeros": a, "ones": b, "below": below})


def top_table(nodes: pd.DataFrame) -> np.ndarray:
    """(P of a one, weight, seen) at depth 1 (b1 << 8 | bits), then at depth 0 (65536 + bits)."""
    size = 65536 + 256
    a, b, below = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size)
    at = nodes["node"].to_numpy(np.int64)
    a[at], b[at], below[at] = nodes["zeros"], nodes["ones"], nodes["below"]
    kt = ln_kt(a, b)
    value = np.where(a + b > 0, np.logaddexp(kt, below) - np.log(2), 0)
    for x in (a, b):
        x[65536:] = x[:65536].reshape(256, 256).sum(0)
    below[65536:] = value[:65536].reshape(256, 256).sum(0)
    kt = ln_kt(a, b)
    return np.stack([(b + 0.5) / (a + b + 1.0), 1 / (1 + np.exp(np.clip(below - kt, -700, 700))), a + b])


class Lookup:
    """Numbers → values in a bucketed table; every number asked for is in it."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        """``parts`` of (numbers, values) are emptied: a block's numbers are held once more at most."""
        size = sum(len(k) for k, _ in parts)
        self.shift = np.uint64(max(8, 64 - max(1, size * 2).bit_length()))
        keys, values, at = np.empty(size, np.uint64), np.empty(size, np.float32), 0
        while parts:
            k, v = parts.pop()
            keys[at:at + len(k)], values[at:at + len(k)], at = k, v, at + len(k)
        h = self.bucket(keys).astype(np.uint32) if self.shift >= 32 else self.bucket(keys)
        order = np.argsort(h, kind="stable")
        counts = np.bincount(h, minlength=1 << (64 - int(self.shift)))
        del h
        self.start = np.cumsum(counts, dtype=np.int64)
        self.start -= counts
        del counts
        self.keys = keys[order]
        del keys
        self.values = values[order]

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.start[self.bucket(keys)]
        left = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys)
        while len(left):
            at[left] += 1
            if int(at[left].max()) >= len(self.keys) + 64:
                raise KeyError("a gram of the text was not requested by its block")
            left = left[self.keys[np.minimum(at[left], len(self.keys) - 1)] != keys[left]]
        return self.values[at]


def _score(n: int, v: int, ends: int):
    """Blocks come with their answers first, then their texts."""
    floor = np.log10(n + v + 1.0)
    end = np.log10(ends + 1.0)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, grams, words, lookup = None, [], {}, None
        for frame in frames:
            out, pending, size = [], [], 0

            def settle():
                sums = np.zeros(len(pending))
                for codes, text in gram_chunks([ws for _, _, ws in pending]) if pending else ():
                    sums += np.bincount(text, lookup(codes).astype(np.float64), minlength=len(sums))
                for (i, training, ws), s in zip(pending, sums.tolist()):
                    known = np.fromiter(map(words.__getitem__, ws), np.float64, len(ws))
                    base = float(known.sum()) + end - (len(ws) + 1) * floor
                    out.append((i, not training, len(ws) + 1, int((known > 0).sum()) + (ends > 0), n, base, s))
                pending.clear()

            for b, kind, keys, vals, i, text, training in zip(*(frame[c] for c in (
                    "block", "kind", "keys", "vals", "id", "text", "training"))):
                if b != block:
                    settle()
                    size, block, grams, words, lookup = 0, b, [], {}, None
                if kind == "gram":
                    grams.append((unpack(keys), unpack_logs(vals)))
                elif kind == "word":
                    logs = np.log10(np.frombuffer(zlib.decompress(vals), np.int64) + 1.0).tolist()
                    words.update(zip(zlib.decompress(keys).split(b" "), logs))
                else:
                    if lookup is None:
                        lookup = Lookup(grams)
                    pending.append((i, training, words_of(text)))
                    size += len(text or "")
                    if size > CHUNK:
                        settle()
                        size = 0
            settle()
            yield pd.DataFrame(out, columns=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the add-one word model's log10 probability, ``score`` the tree's. A
    null text counts as empty (one token, the end); repeated rows are scored each; without
    training rows every decision of the tree is even. An empty table gives an empty one.
    """
    spark = df.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _blocks(df, id_col, text_col)
    with batches_of(spark, BATCH_BYTES):
        requests = written(rows.mapInPandas(_requests(parts), PACKED), "requests")
    word_answers = written(requests.where("kind = 'word'").groupBy("part").applyInPandas(_word_answers, ANSWER), "words")
    totals = [np.frombuffer(r[0], np.int64) for r in word_answers.where("kind = 'total'").select("vals").collect()]
    ends = sum(int(np.frombuffer(zlib.decompress(r[0]), np.int64)[0])
               for r in requests.where("kind = 'end'").select("counts").toLocalIterator())
    n = sum(int(t[0]) for t in totals) + ends
    v = sum(int(t[1]) for t in totals) + (ends > 0)
    packed = requests.where("kind = 'gram'")
    nodes = (packed.groupBy("part").applyInPandas(_top_nodes, "node long, zeros long, ones long, below double")
             .groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")))
    top = spark.sparkContext.broadcast(top_table(nodes.toPandas()))

    def gram_answers(frame: pd.DataFrame) -> pd.DataFrame:
        trees, merged, lists = _subtrees(frame)
        value = trees.log10(top.value)
        return pd.DataFrame([(b, "gram", k, pack_logs(value[np.searchsorted(merged.keys, keys)]))
                             for b, k, keys in zip(frame["block"], frame["keys"], lists)],
                            columns=["block", "kind", "keys", "vals"])

    answers = packed.groupBy("part").applyInPandas(gram_answers, ANSWER).unionByName(word_answers.where("kind = 'word'"))
    null = lambda t: F.lit(None).cast(t)
    answers = answers.select("block", "kind", "keys", "vals", null("string").alias("id"), null("string").alias("text"),
                             null("boolean").alias("training"))
    texts = rows.select("block", F.lit("~text").alias("kind"), null("binary").alias("keys"), null("binary").alias("vals"),
                        "id", "text", "training")
    kind = df.schema[id_col].dataType
    scores = (answers.unionByName(texts).repartition(parts, "block").sortWithinPartitions("block", "kind")
              .mapInPandas(_score(n, v, ends), "id string, held_out boolean, n_tokens long, n_known long, "
                                               "train_tokens long, base_score double, score double")
              .select(F.col("id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens",
                      "base_score", "score"))
    with batches_of(spark, BATCH_BYTES):  # so written here
        return written(scores, "scores")
