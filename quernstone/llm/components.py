"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.store import durable

#: Below this many edges the minima of a step are broadcast; else they are written down and joined by a plain shuffle,
#: whose hot partitions (a node with very many neighbours) Spark can split.
BROADCAST_EDGES = 1_000_000


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node of its group.

    Edges stay distributed: a step is one grouped minimum, joined back on the node. Each step's edges are
    written to the shared folder. Loops and repeated edges are allowed; no edges give no rows.
    """
    nodes = edges.select(edges[a].alias("x"), edges[b].alias("y")).filter("x <> y")
    now = durable(nodes.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    was = None
    while (is_now := _state(now)) != was:
        was = is_now
        few = is_now[0] <= BROADCAST_EDGES
        least_of = lambda df: F.broadcast(df) if few else durable(df, "least")
        # Large star: whatever is larger than a node hangs on the least of the node and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = least_of(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large if few else durable(large.distinct(), "large")
        # Small star: a node and its lesser neighbours hang on the least of these. Edges point from a down to b.
        down = least_of(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = durable(small.filter("a <> b").distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
