"""Consolidating pairwise matches into groups: hash-to-min over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_id
from ..session import discard, marks_of, materialize


def _write(sets: DataFrame) -> DataFrame:
    """The rows as a table, with their number and a sum of their hashes taken on the way."""
    return materialize(sets, marks={"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))})


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(member, component)`` of every vertex that is linked to another one.

    Each vertex v keeps its cluster set as rows ``(v, u)``, never as one array.
    In a round it sends the whole set to the least member and that member to all
    others, until nothing changes. The minimum is taken with a partial
    aggregation and joined back; a third of all rows may lie at one vertex (the
    least of a large component), which the adaptive skew join splits, and the
    duplicates of a round are removed by ``(v, u)``, a key without hot values.
    Null ends and self links link nothing; repeated and reversed pairs count
    once; an empty table gives an empty result.
    """
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null and v <> u")
    cur = _write(e.union(e.select("u", "v")).union(e.select("v", F.col("v").alias("u"))).union(e.select("u", F.col("u").alias("v"))).distinct())
    for _ in range(max_rounds):
        least = cur.groupBy("v").agg(F.min("u").alias("m"))
        sent = cur.join(least, "v")
        new = _write(sent.select(F.col("m").alias("v"), "u").union(sent.select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct())
        settled = marks_of(new) == marks_of(cur)
        discard(cur)
        cur = new
        if settled:
            break
    else:
        raise RuntimeError("hash-to-min did not settle; raise max_rounds")
    return cur.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "member")


def accepted_links(pairs: DataFrame, accepted: str = "match") -> DataFrame:
    """``(a, b)``: the two groups of every pair with an accepted verdict.

    Verdicts and ids are compared trimmed and in lower case; a side without a
    group is named ``doc:`` + its document, a side with neither links nothing.
    """
    def side(s: str):
        return F.coalesce(clean_id(f"{s}_group_id"), F.concat(F.lit("doc:"), clean_id(f"{s}_document_id")))

    return pairs.where(clean_id("verdict") == accepted).select(side("left").alias("a"), side("right").alias("b"))


def consolidate(pairs: DataFrame) -> DataFrame:
    """``group_id, component_id``: one identifier for every group linked to another."""
    links = accepted_links(pairs).where("a is not null and b is not null and a <> b").distinct()
    return hash_to_min(links).select(F.col("member").alias("group_id"), F.col("component").alias("component_id"))
