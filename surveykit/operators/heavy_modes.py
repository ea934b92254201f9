"""Modes (A2, A4, A5) of columns with very many values, without counting every value.

Every row falls into one bucket of each of two hashes, and the buckets' totals are counted
(partial aggregation, at most 2 x buckets rows a group). The values of a group's largest
bucket are recounted: their best count is a floor for the mode's. A value can only reach the
floor if both of its buckets do, which is the certificate: rows of other buckets hold no mode
and no tie of it, and only the rest is counted value by value. Exact for any data; how much is
recounted depends on how far the mode stands out.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .describe import _pick_mode

#: Buckets of each hash and group.
BUCKETS = 1 << 12
#: Rows (a group and a bucket) up to which the buckets in question are broadcast.
BROADCAST_BUCKETS = 200_000


def heavy_mode(df: DataFrame, col: str, by: str | Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """(by..., col, n): each group's most frequent value, the smallest of equals.

    Null values and null groups are left out, as in ``mode`` and ``group_mode``; an empty table
    gives no row with groups and a null one without. Where the buckets in question are too many
    to broadcast, every value is counted.
    """
    by = [by] if isinstance(by, str) else list(by)
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))]
    rows = df.select(*keys, F.col(col).alias("_v"))
    for c in [*names, "_v"]:
        rows = rows.where(F.col(c).isNotNull())
    hashed = rows.select("*", *[F.pmod(F.xxhash64(F.lit(t), "_v"), F.lit(buckets)).cast("int").alias(f"_h{t}") for t in (0, 1)])
    totals = written(hashed.select(*names, F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col(f"_h{t}").alias("h")) for t in (0, 1)])).alias("b"))
        .groupBy(*names, "b.t", "b.h").agg(F.count("*").alias("total")), "buckets")
    largest = totals.where("t = 0").groupBy(*names).agg(F.max(F.struct("total", "h"))["h"].alias("_h0"))
    floors = written(hashed.join(largest, [*names, "_h0"]).groupBy(*names, "_v").agg(F.count("*").alias("n"))
                     .groupBy(*names).agg(F.max("n").alias("floor")), "floors")
    if names:
        enough = totals.join(floors, names).where("total >= floor")
    else:  # one floor
        enough = totals.where(F.col("total") >= F.lit(floors.first()["floor"]))
    held = written(enough.select(*names, "t", "h"), "held")
    left = hashed
    if held.count() <= BROADCAST_BUCKETS:
        for t in (0, 1):
            mine = held.where(F.col("t") == t).select(*names, F.col("h").alias(f"_h{t}"))
            left = left.join(F.broadcast(mine), [*names, f"_h{t}"], "left_semi")
    counts = left.groupBy(*names, "_v").agg(F.count("*").alias("n"))
    found = _pick_mode(counts, "_v", names)
    return found.select(*[F.col(g).alias(c) for g, c in zip(names, by)], F.col("_v").alias(col), "n")
