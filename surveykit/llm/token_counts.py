"""Token counts of documents in flat token files, by a separator scan.

A flat token file is a run of little-endian 16-bit token ids; an end-of-document id closes
each document and there is no index. The file is read in blocks of fixed size that know
nothing of documents: each block is searched for separators with one vectorised compare,
and a prefix scan over the blocks' counts and last separators (a few numbers per block)
stitches the documents that cross blocks.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A public byte-level vocabulary; the same path on every machine.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed values of that vocabulary: its pre-tokenisation pattern and its end-of-document id.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 50256
BLOCK_TOKENS = 1 << 16
#: Token files over so many bytes are read by ranges (one binary value of Spark holds 2 GB).
WHOLE_BYTES = 1 << 30
BLOCKS = "stream string, block long, payload binary, ids array<long>"


@cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                 end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokenise and pack: each input partition becomes one flat stream, cut into blocks.

    A null text is an empty document. ``ids`` carries the ids of the documents that a
    block closes, in order, beside the payload; the scan itself reads the payload only.
    """
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode_ordinary
        stream, block = f"part-{TaskContext.get().partitionId():05d}", 0
        parts, size, closed = [], 0, []  # what isn't yet in a block; closed: (end, id)

        def cut(most: int):
            nonlocal parts, size, closed, block
            flat = np.concatenate(parts)
            rows = []
            at = 0
            while size - at >= block_tokens or (most == 0 and at < size):
                end = min(at + block_tokens, size)
                ids = [i for e, i in closed if at <= e < end]
                rows.append((stream, block, flat[at:end].astype("<u2").tobytes(), ids))
                block += 1
                at = end
            closed = [(e - at, i) for e, i in closed if e >= at]
            parts, size = [flat[at:]], size - at
            return pd.DataFrame(rows, columns=["stream", "block", "payload", "ids"])

        for frame in frames:
            for i, text in zip(frame["id"].tolist(), frame["text"]):
                tokens = encode(text) if text else []
                parts.append(np.array(tokens + [end_id], dtype=np.uint16))
                size += len(tokens) + 1
                closed.append((size - 1, None if i is None or i != i else int(i)))
                if size >= 16 * block_tokens:
                    yield cut(block_tokens)
        if size:
            yield cut(0)

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInPandas(pack, BLOCKS)


def _open(path: str):
    """A file of Spark's path column, open for reading at any place, through Arrow's file systems."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, name = fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else path)
    return system.open_input_file(name)


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS,
                     whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Blocks of the flat token files under ``path``, of any size.

    Files up to ``whole_bytes`` are read whole, through Spark's own file systems. Of larger ones
    only name and length are listed; every block is a byte range that a task reads by itself,
    spread by hash, through Arrow's file systems (local, HDFS, S3, GCS). The blocks are the same.
    Empty files have none; an odd last byte is an error of the scan.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    step = 2 * block_tokens
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))).alias("block")
    small = files.where(F.col("length") <= whole_bytes).select("path", "content", block).select(
        "path", "block", F.expr(f"substring(content, int(block * {step} + 1), {step})").alias("payload"))
    ranges = files.where(F.col("length") > whole_bytes).select("path", block).repartition("path", "block")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, blocks in frame.groupby("path")["block"]:
                with _open(name) as file:
                    for k in sorted(blocks):
                        file.seek(int(k) * step)
                        yield pd.DataFrame({"path": [name], "block": [k], "payload": [file.read(step)]})

    large = ranges.mapInPandas(read, "path string, block long, payload binary")
    return small.unionByName(large).select(F.col("path").alias("stream"), "block", "payload",
                                           F.lit(None).cast("array<long>").alias("ids"))


def scan_blocks(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """stream, block, tokens, ends (positions of separators inside the block), ids."""
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tokens = [np.frombuffer(p, dtype="<u2") for p in frame["payload"]]
            yield pd.DataFrame({
                "stream": frame["stream"], "block": frame["block"], "tokens": [len(t) for t in tokens],
                "ends": [np.flatnonzero(t == end_id).astype(np.int64) for t in tokens], "ids": frame["ids"]})

    return blocks.mapInPandas(scan, "stream string, block long, tokens long, ends array<long>, ids array<long>")


def document_counts(scanned: DataFrame) -> DataFrame:
    """One row per document: stream, ordinal, doc_id, first (token), n_tokens, closed.

    The prefix scan is a window over a stream's blocks. Tokens after a stream's last
    separator make a last document with ``closed`` false.
    """
    order = Window.partitionBy("stream").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    at = scanned.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    at = at.withColumn("docs", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    at = at.withColumn("ends", F.expr("transform(ends, e -> e + base)"))
    at = at.withColumn("prior", F.coalesce(F.last(F.expr("try_element_at(ends, -1)"), ignorenulls=True).over(before), F.lit(-1)))
    at = at.withColumn("last", F.lead("block").over(order).isNull())
    at = at.withColumn("final", F.coalesce(F.expr("try_element_at(ends, -1)"), F.col("prior")))
    each = at.select("stream", "docs", F.posexplode(F.expr("""
        concat(transform(ends, (e, i) -> struct(
                 if(i = 0, prior, ends[i - 1]) + 1 as first, e as end, true as closed,
                 if(ids is null, null, ids[i]) as id)),
               if(last and base + tokens - 1 > final,
                  array(struct(final + 1 as first, base + tokens as end, false as closed, cast(null as bigint) as id)),
                  array()))""")).alias("i", "d"))
    return each.select("stream", (F.col("docs") + F.col("i")).alias("ordinal"), F.col("d.id").alias("doc_id"),
                       F.col("d.first").alias("first"), (F.col("d.end") - F.col("d.first")).alias("n_tokens"),
                       F.col("d.closed").alias("closed"))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                 block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token counts of a table of texts, through flat blocks and the separator scan."""
    return document_counts(scan_blocks(token_blocks(df, id_col, text_col, tokenizer, END_ID, block_tokens)))
