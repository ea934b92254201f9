"""Connected components of an edge table by repeated contraction.

Each round hooks every vertex to its smallest neighbour (if smaller), shortens the paths
by pointer jumping and relabels the edges; the edge table shrinks geometrically. Every
round is written to the shared checkpoint folder; nothing is collected.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

JUMPS = 3
#: Vertices (two longs each) up to which a round's table of parents is broadcast; beyond, it is shuffled.
BROADCAST_VERTICES = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) → (node, comp) for every vertex with an edge; comp is a vertex of the component."""
    link = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    e = written(edges.where("a <> b").select(*link("a", "b")).distinct(), "edges")
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("v"), F.least("a", "m").alias("p")), "parents")
        near = F.broadcast if parent.count() <= BROADCAST_VERTICES else lambda table: table
        for _ in range(JUMPS):
            up = near(parent.select(F.col("v").alias("p"), F.col("p").alias("pp")))
            parent = parent.join(up, "p").select("v", F.col("pp").alias("p"))
        parent = written(parent, "parents")
        if labels is None:
            labels = parent.select(F.col("v").alias("node"), F.col("p").alias("comp"))
        else:
            new = parent.select(F.col("v").alias("comp"), "p")
            labels = written(labels.join(near(new), "comp", "left").select(
                "node", F.coalesce("p", "comp").alias("comp")), "labels")
        pa, pb = parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        e = written(e.join(near(pa), "a").join(near(pb), "b").where("pa <> pb").select(*link("pa", "pb")).distinct(), "edges")
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
