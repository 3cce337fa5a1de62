"""Connected components of a link table by alternating stars, written as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, marks_of, materialize


def _write(links: DataFrame) -> DataFrame:
    """The links as a table, with their number and a sum of their hashes taken on the way."""
    return materialize(links, marks={"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))})


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)``, where component is the least node linked directly or indirectly.

    ``edges`` holds any comparable node type. Null ends link nothing, self links
    only name a node, repeated and reversed links count once. An empty table
    gives an empty result. Each round is two stars (large, small); every star
    aggregates a minimum per node before the shuffle and joins it back, so no
    neighbourhood is ever held in one task; a hot node is split by the adaptive
    skew join. Rounds are written to the shared folder.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    nodes = materialize(e.select("a").union(e.select("b")).na.drop().distinct().withColumnRenamed("a", "node"))
    e = e.na.drop().where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur = _write(e)
    for _ in range(max_rounds):
        both = cur.union(cur.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        new = _write(small.where("a <> b").distinct())
        settled = marks_of(new) == marks_of(cur)
        discard(cur)
        cur = new
        if settled:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    root = cur.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(root, nodes.node == root.a, "left").select("node", F.coalesce("root", "node").alias("component"))
